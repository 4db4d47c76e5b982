"""Dataset documents, the export outbox and rebuilds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from patchlore import schema
from patchlore.plans.skew import all_of, skew_join
from patchlore.session import cut

PART_ROWS = 50_000   # rows of a section in one document part
SLICE_ROWS = 5_000   # lines of one file in one slice
OUTBOX_BUCKETS = 64   # folders of an outbox
BUCKETS = 256        # folders of a dataset, whatever the number of requests
ORDER = ("ord", "pos", "line_idx", "idx")  # columns that order the list of a section


def _parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """Add ``part``: rows of a request spread by hash over as many parts as their number needs."""
    n = rows.groupBy("pr_id").agg(F.ceil(F.count("*") / F.lit(part_rows)).alias("_p"))
    d = skew_join(rows, n, ["pr_id"])
    return d.withColumn("part", F.pmod(F.col("_h"), F.col("_p"))).drop("_p", "_h")


def _section(rows: DataFrame, name: str, part_rows: int) -> DataFrame:
    fields = [f.split(":")[0] for f in _fields(schema.SECTIONS[name])]
    kind = schema.SECTIONS[name]
    have = [F.col(f) if f in rows.columns else F.lit(None).alias(f) for f in fields]
    first = F.struct(*[F.col(c) for c in ORDER if c in rows.columns and c in fields], F.lit(0))
    d = rows.select("pr_id", first.alias("_o"), F.struct(*have).alias("_row"))
    d = _parts(d.withColumn("_h", F.xxhash64("_row")), part_rows)
    return d.groupBy("pr_id", "part").agg(_sorted(F.struct("_o", "_row")).cast(kind).alias(name))


def _sorted(pair: Column) -> Column:
    """Rows of a part in the order of their first field; rows without an order by their content."""
    return F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["_row"])


def _fields(kind: str) -> list[str]:
    """Top-level field texts of an ``array<struct<…>>`` type."""
    body, depth, out, cur = kind[len("array<struct<"):-2], 0, [], ""
    for ch in body:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


def _file_section(files: DataFrame, lines: DataFrame, part_rows: int, slice_rows: int) -> DataFrame:
    row = F.struct(*[(F.col(c) if c in lines.columns else F.lit(None)).alias(c) for c in ("idx", "kind", "old", "new", "text", "band", "by", "conflict")])
    d = lines.select("pr_id", "path", F.floor((F.col("idx") - 1) / F.lit(slice_rows)).alias("_s"), row.alias("_l"))
    d = d.groupBy("pr_id", "path", "_s").agg(F.array_sort(F.collect_list("_l")).alias("lines"))
    pos = F.col("pos") if "pos" in files.columns else F.lit(None)
    d = skew_join(d, files.select("pr_id", "path", "old_path", "delta", pos.cast("long").alias("pos")), ["pr_id", "path"], "left")
    n = lines.groupBy("pr_id").agg(F.ceil(F.count("*") / F.lit(part_rows)).alias("_p"))
    d = skew_join(d, n, ["pr_id"]).withColumn("part", F.pmod(F.xxhash64("path", "_s"), F.col("_p")))
    one = F.struct(F.struct("pos", "path", "_s").alias("_o"), F.struct("path", "old_path", "delta", "pos", "lines").alias("_row"))
    return d.groupBy("pr_id", "part").agg(_sorted(one).cast(schema.SECTIONS["files"]).alias("files"))


def dataset_documents(tables: Mapping[str, DataFrame], part_rows: int = PART_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Nested documents from tables named as in ``schema.SECTIONS``, plus ``prs`` and ``diff_lines``.

    A request is one document (part 0) unless a section has more than
    ``part_rows`` rows; then it is split over more parts, so that no row of the
    result collects an unbounded group.
    """
    t = {k: v.withColumn("pr_id", F.col("pr_id").cast("string")) for k, v in tables.items()}
    parts = [_section(t[n], n, part_rows) for n in schema.SECTIONS if n != "files" and n in t]
    if "diff_lines" in t:
        parts.append(_file_section(t["files"], t["diff_lines"], part_rows, slice_rows))
    pr = [f.split(":")[0] for f in schema.PR_SECTION[len("struct<"):-1].split(",")]
    row = F.struct(*[(F.col(c) if c in t["prs"].columns else F.lit(None)).alias(c) for c in pr]).cast(schema.PR_SECTION)
    doc = t["prs"].select("pr_id", F.lit(0).cast("long").alias("part"), row.alias("pr"))
    for p in parts:
        doc = doc.join(p, ["pr_id", "part"], "full")
    return doc


def write_dataset(tables: Mapping[str, DataFrame], path: str, part_rows: int = PART_ROWS, mode: str = "overwrite",
                  slice_rows: int = SLICE_ROWS) -> None:
    """Documents in a fixed number of folders; only the requests given are replaced.

    A folder that holds one of them is written again together with the other
    requests in it. The files are compressed; the rows of a part lie together
    after the joins of its sections, so they are not shuffled again.
    """
    doc = dataset_documents(tables, part_rows, slice_rows).withColumn("bucket", F.pmod(F.crc32(F.col("pr_id").cast("binary")), F.lit(BUCKETS)).cast("int"))
    try:
        old = doc.sparkSession.read.schema(f"{schema.DOCUMENT}, bucket INT").json(path).filter(F.col("pr_id").isNotNull())
    except AnalysisException:  # a new dataset
        old = None
    if old is not None and mode == "overwrite":
        doc = cut(doc, "documents")
        others = old.join(doc.select("bucket").distinct(), "bucket", "left_semi").join(doc.select("pr_id").distinct(), "pr_id", "left_anti")
        doc = doc.unionByName(cut(others, "others"), allowMissingColumns=True)  # read before their folders are replaced
    doc.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("bucket").json(path)


def export_outbox(payload: DataFrame, replies: DataFrame, path: str) -> None:
    """Append reviews and replies still to be sent; sending them is not this engine's work.

    A reply is told by the id of its note, so two notes with one text are both
    sent; a review by its body, which lists the ids of its notes. What the
    outbox holds already is left out: a repeated run adds nothing. Rows lie in
    folders by a hash of what tells them apart, and only folders that new rows
    fall into are read.
    """
    keys = ["pr_id"]
    none = F.lit(None).cast("string")
    reviews = payload.select(*keys, F.lit("review").alias("what"), F.md5(F.col("body").cast("binary")).alias("note"), none.alias("reply_to"), "body", "comments")
    answers = replies.filter("is_reply").select(*keys, F.lit("reply").alias("what"), F.col("id").cast("string").alias("note"), F.col("reply_to").cast("string").alias("reply_to"), "body",
                                                F.lit(None).cast(payload.schema["comments"].dataType).alias("comments"))
    told = [*keys, "what", "note"]
    rows = reviews.unionByName(answers).dropDuplicates(told)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*told), F.lit(OUTBOX_BUCKETS)).cast("int"))
    try:
        held = rows.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException:  # no outbox yet
        held = None
    if held is not None:
        rows = cut(rows, "outbox-rows")
        buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most OUTBOX_BUCKETS
        same = all_of([F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in told])
        rows = cut(rows.alias("n").join(held.filter(F.col("bucket").isin(buckets)).alias("h"), same, "left_anti"), "unsent")
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def reconcile_refs(prs: DataFrame, upstream: DataFrame) -> DataFrame:
    """Branch refs from upstream where its merge commit is the local one; a mismatch keeps local and drops the refs.

    ``prs`` has (pr_id, merged_sha, …), ``upstream`` (pr_id, merge_sha, base_ref,
    head_ref, head_label). An upstream without a merge commit is trusted.
    """
    refs = ["base_ref", "head_ref", "head_label"]
    d = prs.drop(*refs).join(upstream.select("pr_id", "merge_sha", *refs), "pr_id", "left")
    other = F.coalesce(~F.col("merged_sha").startswith(F.left("merge_sha", F.lit(7))), F.lit(False))
    for r in refs:
        d = d.withColumn(r, F.when(~other, F.col(r)))
    return d.withColumn("local_only", other).drop("merge_sha")


def batch_rebuild(tables: Mapping[str, DataFrame], upstream: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Write the documents of all given requests again; other requests stay as they are."""
    write_dataset({**tables, "prs": reconcile_refs(tables["prs"], upstream)}, path, part_rows)
