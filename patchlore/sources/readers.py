"""Landed text and JSON to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore import schema
from patchlore.functions.text import pr_ref

# Which files are sources and which folders never are.
SOURCE_GLOB = "*.{ts,tsx}"
SKIPPED_FOLDERS = r"(^|/)(node_modules|\.git)/"


def read_patches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(pr_id, sha, patch); sha is empty for the patch of a whole request.

    ``parquet`` reads a landed table, ``text`` a folder ``pr_id=…/sha=…/*`` of
    one patch per file.
    """
    if fmt == "text":
        d = spark.read.text(path, wholetext=True).withColumnRenamed("value", "patch")
    else:
        d = spark.read.format(fmt).load(path)
    return d.select(F.col("pr_id").cast("string").alias("pr_id"), F.coalesce(F.col("sha").cast("string"), F.lit("")).alias("sha"), "patch")


def parse_commit_log(logs: DataFrame, log: str = "log") -> DataFrame:
    """Rows of tab separated log texts, newest first: sha, parents, author, epoch, day|ts|time, subject.

    ``logs`` has (pr_id, log). Empty rows are skipped, missing fields are empty.
    """
    rows = F.filter(F.split(F.trim(F.col(log)), "\n"), lambda x: x != "")
    d = logs.select("pr_id", F.posexplode(rows).alias("_i", "_r"))
    cells = F.split("_r", "\t")
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    date = F.split(cell(4), r"\|")
    part = lambda i: F.coalesce(F.get(date, F.lit(i)), F.lit(""))
    parents = F.filter(F.split(cell(1), " "), lambda x: x != "")
    return d.select("pr_id", cell(0).alias("sha"), parents.alias("parents"), cell(2).alias("author"),
                    F.expr("try_cast(coalesce(get(split(_r, '\\t'), 3), '') AS BIGINT)").alias("at"),
                    part(0).alias("day"), F.when(part(1).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), part(1).try_cast("timestamp_ntz")).alias("ts"),
                    part(2).alias("time"), cell(5).alias("message"), (F.col("_i").cast("long") + 1).alias("ord"))


def read_pr_refs(refs: DataFrame, ref: str = "ref") -> tuple[DataFrame, DataFrame]:
    """References to requests, and the unreadable rest with a reason, for a quarantine table."""
    d = refs.withColumn("_r", pr_ref(F.col(ref)))
    bad = d.filter(F.col("_r.number").isNull()).drop("_r").withColumn("reason", F.lit("not a reference to a request"))
    return d.filter(F.col("_r.number").isNotNull()).select(*refs.columns, "_r.*"), bad


def read_comments(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Review comments of landed API pages (pr_id, payload)."""
    d = payloads.select("pr_id", F.explode(F.from_json(payload, schema.COMMENTS_JSON)).alias("c"))
    return d.select("pr_id", "c.id", "c.path", F.coalesce("c.line", "c.original_line").alias("line"), F.col("c.created_at").alias("created"),
                    F.coalesce("c.user.login", F.lit("unknown")).alias("author"), F.coalesce("c.body", F.lit("")).alias("body"),
                    F.col("c.in_reply_to_id").alias("in_reply_to"))


def read_check_runs(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per check run of landed API pages (pr_id, payload)."""
    d = payloads.select("pr_id", F.explode(F.from_json(payload, schema.CHECK_RUNS_JSON)["check_runs"]).alias("r"))
    return d.select("pr_id", F.col("r.id").alias("run_id"), "r.name", "r.status", "r.conclusion")


def read_prs(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Merged requests, and the rejected rest with a reason. ``payloads`` has (repo, payload)."""
    d = payloads.withColumn("p", F.from_json(payload, schema.PR_JSON))
    d = d.select(
        F.concat("repo", F.lit("#"), F.col("p.number").cast("string")).alias("pr_id"), "repo", F.col("p.number").cast("string").alias("number"),
        F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.user.login").alias("author"), F.col("p.base.sha").alias("base"),
        F.col("p.head.sha").alias("head"), F.col("p.base.ref").alias("base_ref"), F.col("p.head.ref").alias("head_ref"),
        F.col("p.head.label").alias("head_label"), F.col("p.merge_commit_sha").alias("merged_sha"), payload)
    merged = F.coalesce(F.col("merged_sha") != "", F.lit(False))
    why = F.when(F.col("number").isNull(), "unreadable payload").otherwise("not merged (no merge commit)")
    return d.filter(merged).drop(payload), d.filter(~merged).select("repo", "number", why.alias("reason"), payload)


def is_source(path: Column) -> Column:
    return path.rlike(r"\.tsx?$") & ~path.rlike(SKIPPED_FOLDERS)


def source_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a landed file table that are sources."""
    return files.filter(is_source(F.col(path)))


def list_source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every source below a folder, path relative to it."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SOURCE_GLOB).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.expr(f"substring(path, locate({_quote(base + '/')}, path) + {len(base) + 1})")
    return source_files(d.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text")))


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Dataset documents (or parts of them); unreadable rows are left out."""
    d = spark.read.schema(schema.DOCUMENT + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.filter(F.col("_bad").isNull() & F.col("pr_id").isNotNull())


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of landed documents; each reads only its own section."""
    d = read_documents(spark, path).drop("_bad")
    out = {name: d.select("pr_id", F.inline(name)) for name in schema.SECTIONS if name != "files"}
    out["prs"] = d.filter(F.col("pr").isNotNull()).select("pr_id", "pr.*")
    f = d.select("pr_id", F.inline("files"))
    out["files"] = f.select("pr_id", "path", "old_path", "delta", "pos").distinct()
    out["diff_lines"] = f.select("pr_id", "path", F.inline("lines"))
    return out


def recent_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Per dataset: repo, number, title, commits, sorted distinct bands, time; newest first."""
    d = spark.read.schema(schema.DOCUMENT + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path)
    d = d.filter(F.col("_bad").isNull() & F.col("pr_id").isNotNull())
    d = d.select("pr_id", "pr", F.size(F.coalesce("commits", F.array())).alias("n"), F.col("commits.band").alias("b"),
                 F.col("_metadata.file_modification_time").alias("mtime"))
    per = d.groupBy("pr_id").agg(
        F.first("pr", ignorenulls=True).alias("pr"), F.sum("n").alias("commits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.coalesce("b", F.array().cast("array<bigint>"))))))).alias("bands"),
        F.max("mtime").alias("mtime"))
    text = lambda c: F.coalesce(F.col(f"pr.{c}"), F.lit(""))
    return per.select("pr_id", text("repo").alias("repo"), text("number").alias("number"), text("title").alias("title"), "commits", "bands", "mtime").orderBy(F.desc("mtime"), "pr_id")
