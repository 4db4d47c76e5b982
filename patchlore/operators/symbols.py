"""Symbol tables: mirrors, spans, modules and what each identifier refers to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patchlore.functions.paths import module_candidates
from patchlore.functions.text import content_hash, wordless
from patchlore.operators.exports import resolve_export
from patchlore.plans.scan import by_width, last_value, number_rows, running_max, running_sum, scan
from patchlore.plans.skew import skew_join
from patchlore.session import cut

# What ends an attached comment, and the shortest indexed name.
BLANK_LINE = r"\n[ \t]*\r?\n"
MIN_NAME = 2
OFFSET_BLOCK = 1 << 16


def collapse_mirrors(files: DataFrame, keys: Sequence[str] = ("pr_id",), path: str = "path", text: str = "text",
                     preferred: str = "preferred") -> DataFrame:
    """Path to canonical path: files equal up to import suffixes share one canonical file.

    Preferred paths win, then fewer segments, then the smaller path. Only the
    hash of a text is shuffled; a hash with very many copies is salted.
    """
    depth = F.size(F.split(path, "/"))
    hashed = files.select(*keys, path, F.struct((-F.col(preferred).cast("int")).alias("p"), depth.alias("d"), F.col(path).alias("path")).alias("_rank"),
                          content_hash(F.col(text)).alias("_hash"))
    hashed = cut(hashed, "hashed")  # texts are read and hashed once
    best = hashed.groupBy(*keys, "_hash").agg(F.min("_rank").alias("_best"))
    joined = skew_join(hashed, best, list(keys) + ["_hash"])
    return joined.select(*keys, path, F.col("_best.path").alias("canonical_path"))


def with_def_ids(defs: DataFrame, keys: Sequence[str] = ("pr_id",), width: int = OFFSET_BLOCK) -> DataFrame:
    """Drop unusable names and add ``def_id`` = file#name#kind#n, n counting per file by start."""
    ok = defs.filter((F.length("name") >= MIN_NAME) & (F.col("name") != "undefined"))
    d = number_rows(ok, list(keys) + ["file"], ["start", "end", "name", "kind"], by_width("start", width), "_n")
    parts = ["file", "name", "kind", (F.col("_n") - 1).cast("string")]
    return d.withColumn("def_id", F.concat_ws("#", *parts)).drop("_n")


def attached_start(defs: DataFrame, comments: DataFrame, keys: Sequence[str] = ("pr_id",)) -> DataFrame:
    """Add ``full``: start of the comment block attached to a declaration.

    ``comments`` holds the leading comments of a def: (keys, def_id, pos, text,
    gap), gap being the source between the comment's end and the next comment
    or the declaration. A blank line or a wordless comment ends the block.
    """
    on = list(keys) + ["def_id"]
    stops = F.col("gap").rlike(BLANK_LINE) | wordless(F.col("text"))
    barrier = comments.filter(stops).groupBy(*on).agg(F.max("pos").alias("_bar"))
    below = skew_join(comments.select(*on, "pos"), barrier, on, "left")
    below = below.filter(F.col("_bar").isNull() | (F.col("pos") > F.col("_bar")))
    first = below.groupBy(*on).agg(F.min("pos").alias("_first"))
    return defs.join(first, on, "left").withColumn("full", F.coalesce("_first", "start")).drop("_first")


def line_starts(sources: DataFrame, keys: Sequence[str] = ("pr_id", "file"), text: str = "text") -> DataFrame:
    """(keys, line, start_off) of every line of a source text (one text is one row)."""
    cells = F.posexplode(F.split(text, "\n", -1)).alias("_i", "_l")
    rows = sources.select(*keys, cells).select(*keys, "_i", (F.length("_l") + 1).cast("long").alias("_n"))
    d = scan(rows, keys, ["_i"], {"start_off": running_sum(F.col("_n"), inclusive=False)}, by_width("_i"))
    return d.select(*keys, (F.col("_i").cast("long") + 1).alias("line"), "start_off")


def offset_to_line(offsets: DataFrame, starts: DataFrame, keys: Sequence[str] = ("pr_id", "file"), offset: str = "offset",
                   width: int = OFFSET_BLOCK) -> DataFrame:
    """Add ``line``: the last line starting at or before the offset (1 if none)."""
    payload = F.struct(*[F.col(c) for c in offsets.columns if c not in keys])
    pts = offsets.select(*keys, F.col(offset).cast("long").alias("_at"), F.lit(1).alias("_pt"), F.lit(None).cast("long").alias("_ln"), payload.alias("_row"))
    ls = starts.select(*keys, F.col("start_off").cast("long").alias("_at"), F.lit(0).alias("_pt"), F.col("line").cast("long").alias("_ln"))
    both = pts.unionByName(ls, allowMissingColumns=True)
    out = scan(both, keys, ["_at", "_pt"], {"line": last_value(F.col("_ln"))}, by_width("_at", width))
    out = out.filter(F.col("_pt") == 1)
    rest = [F.col(f"_row.{c}").alias(c) for c in offsets.columns if c not in keys]
    return out.select(*keys, *rest, F.coalesce("line", F.lit(1).cast("long")).alias("line"))


def clamp_spans(spans: DataFrame, keys: Sequence[str] = ("pr_id", "file"), order: Sequence[str] = ("start_line",),
                full: str = "full_line", end: str = "end_line", width: int | None = None) -> DataFrame:
    """Add ``span_start``, ``span_end``: no line before the end of an earlier definition."""
    d = scan(spans, keys, order, {"_prev": running_max(F.col(end), inclusive=False)}, by_width(order[0], width))
    start = F.greatest(F.col(full), F.coalesce("_prev", F.lit(0)) + 1)
    return d.withColumn("span_start", F.least(start, F.col(end))).withColumn("span_end", F.col(end)).drop("_prev")


def resolve_spec(specs: DataFrame, files: DataFrame, canonical: DataFrame | None = None, keys: Sequence[str] = ("pr_id",),
                 from_file: str = "file", spec: str = "spec") -> DataFrame:
    """Add ``module``: the file a relative specifier names, null if none.

    Distinct (file, spec) pairs are resolved once. Candidates are tried in
    order; a candidate that is a collapsed mirror stands for its canonical file.
    """
    keys = list(keys)
    known = files.select(*keys, F.col("path").alias("_cand"), F.col("path").alias("_hit"))
    if canonical is not None:
        moved = canonical.filter(F.col("path") != F.col("canonical_path"))
        moved = moved.select(*keys, F.col("path").alias("_cand"), F.col("canonical_path").alias("_hit"))
        known = known.join(moved.select(*keys, "_cand"), keys + ["_cand"], "left_anti").unionByName(moved)
    todo = cut(specs.select(*keys, from_file, spec).distinct(), "specs")
    tries = todo.select(*keys, from_file, spec, F.posexplode(module_candidates(F.col(from_file), F.col(spec))).alias("_i", "_cand"))
    found = skew_join(tries, known, keys + ["_cand"]).groupBy(*keys, from_file, spec).agg(F.min_by("_hit", "_i").alias("module"))
    return specs.join(found, keys + [from_file, spec], "left")


def module_graph(imports: DataFrame, reexports: DataFrame, files: DataFrame, canonical: DataFrame | None = None,
                 keys: Sequence[str] = ("pr_id",)) -> tuple[DataFrame, DataFrame]:
    """Imports and re-exports whose specifier resolves inside the repository."""
    ok = lambda d: resolve_spec(d, files, canonical, keys).filter(F.col("module").isNotNull())
    return ok(imports), ok(reexports)


def first_defs(defs: DataFrame, keys: Sequence[str] = ("pr_id",), order: Sequence[str] | None = None) -> DataFrame:
    """First definition of a name in a file, by default the one that starts first."""
    order = order or (("start", "def_id") if "start" in defs.columns else ("def_id",))
    pick = F.min(F.struct(*order, F.col("def_id").alias("_id"))).alias("p")
    return defs.groupBy(*keys, "file", "name").agg(pick).select(*keys, "file", "name", F.col("p._id").alias("def_id"))


def resolve_uses(uses: DataFrame, defs: DataFrame, imports: DataFrame, reexports: DataFrame, keys: Sequence[str] = ("pr_id",),
                 order: Sequence[str] | None = None, default_name: Column | None = None) -> DataFrame:
    """Add ``def_id`` and ``rule`` (local, import, namespace, unique; null if unresolved).

    Rules apply in that order; an import that names nothing, or a member access
    in a file with namespace imports, stops the search. Distinct (file, name,
    is_prop) are resolved once and joined back to the use rows.
    """
    keys = list(keys)
    use_keys = keys + ["file", "name", "is_prop"]
    todo = cut(uses.select(*use_keys).distinct(), "todo")
    # imports of a file in order; the first one of a local name counts
    imp = cut(imports.select(*keys, "file", "pos", "local_name", "imported", "module", "kind"), "imports")
    pick = F.min(F.struct("pos", "kind", "module", "imported")).alias("i")
    first_imp = imp.groupBy(*keys, "file", F.col("local_name").alias("name")).agg(pick).select(
        *keys, "file", "name", F.col("i.kind").alias("kind"), F.col("i.module").alias("module"), F.col("i.imported").alias("imported"))
    spaces = imp.filter(F.col("kind") == "namespace").select(*keys, "file", F.col("module").alias("ns_module"), F.col("pos").alias("ns_pos")).distinct()
    has_ns = spaces.select(*keys, "file").distinct().withColumn("_ns", F.lit(True))

    local = first_defs(defs, keys, order).withColumnRenamed("def_id", "d_local")
    tops = cut(first_defs(defs.filter(F.col("top_level")), keys, order), "tops")
    unique = defs.groupBy(*keys, "name").agg(F.count("*").alias("_n"), F.min("def_id").alias("d_unique")).filter(F.col("_n") == 1).drop("_n")

    step = skew_join(todo, local, keys + ["file", "name"], "left")
    step = skew_join(step, first_imp, keys + ["file", "name"], "left")
    step = cut(skew_join(step, has_ns, keys + ["file"], "left"), "step")
    by_import = F.col("d_local").isNull() & F.col("kind").isNotNull()
    by_space = F.col("d_local").isNull() & F.col("kind").isNull() & F.col("is_prop") & F.col("_ns")

    default = F.lit("default") if default_name is None else default_name
    target = F.when(F.col("kind") == "named", F.col("imported")).when(F.col("kind") == "default", default)
    asked = step.filter(by_import & F.col("kind").isin("named", "default")).select(*keys, "module", target.alias("name"))
    # a member whose name no module exports cannot resolve: dropped before it meets every namespace
    renamed = reexports.filter(F.col("exported") != "*").select(*keys, F.col("exported").try_cast(tops.schema["name"].dataType).alias("name"))
    exportable = tops.select(*keys, "name").unionByName(renamed).distinct()
    asking = skew_join(step.filter(by_space).select(*use_keys), exportable, keys + ["name"], "left_semi")
    members = cut(skew_join(asking, spaces, keys + ["file"]), "members")
    asked = asked.unionByName(members.select(*keys, F.col("ns_module").alias("module"), "name")).distinct()
    exports = cut(resolve_export(asked, tops, reexports, keys), "exports")

    exp = exports.select(*keys, "module", F.col("name").alias("_target"), F.col("def_id").alias("d_export"))
    base = step.withColumn("_target", target)
    step = skew_join(base, exp, keys + ["module", "_target"], "left")
    modloc = tops.select(*keys, F.col("file").alias("module"), "name", F.col("def_id").alias("d_module"))
    step = skew_join(step, modloc, keys + ["module", "name"], "left")
    ns_hit = skew_join(members, exports.select(*keys, F.col("module").alias("ns_module"), "name", F.col("def_id").alias("d")), keys + ["ns_module", "name"])
    ns_best = ns_hit.groupBy(*use_keys).agg(F.min_by("d", "ns_pos").alias("d_space"))
    step = step.join(ns_best, use_keys, "left")
    step = skew_join(step, unique, keys + ["name"], "left")

    d_imp = F.coalesce(F.col("d_export"), F.when(F.col("kind") == "default", F.col("d_module")))
    rest = F.col("d_local").isNull() & ~by_import & ~F.coalesce(by_space, F.lit(False))
    out = step.select(
        *use_keys,
        F.when(F.col("d_local").isNotNull(), F.col("d_local")).when(by_import, d_imp)
        .when(by_space, F.col("d_space")).otherwise(F.col("d_unique")).alias("def_id"),
        F.when(F.col("d_local").isNotNull(), "local").when(by_import & d_imp.isNotNull(), "import")
        .when(by_space & F.col("d_space").isNotNull(), "namespace").when(rest & F.col("d_unique").isNotNull(), "unique").alias("rule"))
    return skew_join(uses, out, use_keys, "left")


def ref_counts(resolved: DataFrame, keys: Sequence[str] = ("pr_id",)) -> DataFrame:
    """Uses per definition; the declaration's own identifier is one of them."""
    return resolved.filter(F.col("def_id").isNotNull()).groupBy(*keys, "def_id").agg(F.count("*").alias("refs"))
