"""Patch text to line rows, and facts about those lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from patchlore.functions.text import delta_label, insignificant
from patchlore.plans.scan import by_width, last_value, scan

# Patterns of the unified diff format.
FILE_HEADER = r"^diff --git a/(.+?) b/(.+)$"
HUNK_HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"

PATCH_KEYS = ("pr_id", "sha")


def patch_rows(patches: DataFrame, keys: Sequence[str] = PATCH_KEYS, patch: str = "patch") -> DataFrame:
    """One row per line of a patch's files with its file, hunk state and old/new numbers.

    A patch falls apart into its files inside the row; the windows then run over
    one file each, and share one shuffle and one sort.
    """
    keys = list(keys)
    files = F.split(F.concat(F.lit("\n"), F.col(patch)), r"\n(?=diff --git)", -1)  # the first part is what precedes any file
    per_file = patches.select(*keys, F.posexplode(files).alias("_f", "_text")).filter(F.col("_f") > 0)
    rows = per_file.select(*keys, F.col("_f").cast("long").alias("file_seq"), F.posexplode(F.split("_text", "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("is_file", F.col("raw").startswith("diff --git"))
    rows = rows.withColumn("is_hunk", ~F.col("is_file") & F.col("raw").rlike(HUNK_HEADER))
    w = Window.partitionBy(*keys, "file_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.col("is_file"), False).when(F.col("is_hunk"), True)
    rows = rows.withColumn("in_hunk", F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(False)))
    sign = F.substring("raw", 1, 1)
    header = F.col("is_file") | F.col("is_hunk") | (~F.col("in_hunk") & F.col("raw").rlike(r"^(\+\+\+|---) "))
    kind = F.when(sign == "+", "add").when(sign == "-", "del").when(sign == " ", "ctx")
    rows = rows.withColumn("kind", F.when(~header, kind))
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0).cast("long")).over(w)
    rows = rows.withColumns({"n_old": count("del", "ctx"), "n_new": count("add", "ctx"), "n_line": count("add", "del", "ctx")})
    hunk_at = lambda i: F.regexp_extract("raw", HUNK_HEADER, i).cast("long")
    base = lambda i, n: F.coalesce(F.last(F.when(F.col("is_hunk"), hunk_at(i) - F.col(n)), ignorenulls=True).over(w), -F.col(n))
    first = F.last(F.when(F.col("is_file"), F.col("n_line")), ignorenulls=True).over(w)
    return rows.withColumns({
        "old": F.when(F.col("kind").isin("del", "ctx"), base(1, "n_old") + F.col("n_old") - 1),
        "new": F.when(F.col("kind").isin("add", "ctx"), base(2, "n_new") + F.col("n_new") - 1),
        "idx": F.when(F.col("kind").isNotNull(), F.col("n_line") - first),
        "path": F.last(F.when(F.col("is_file"), F.when(F.col("raw").rlike(FILE_HEADER), F.regexp_extract("raw", FILE_HEADER, 2))
                              .otherwise(F.col("raw"))), ignorenulls=True).over(w),
    }).drop("n_old", "n_new", "n_line")


def diff_lines(rows: DataFrame, keys: Sequence[str] = PATCH_KEYS) -> DataFrame:
    """(keys, file_seq, path, idx, kind, old, new, text) of the rows that are diff lines."""
    lines = rows.filter(F.col("kind").isNotNull())
    return lines.select(*keys, "file_seq", "path", "idx", "kind", "old", "new",
                        F.col("raw").substr(F.lit(2), F.length("raw")).alias("text"))


def parse_unified_diff(patches: DataFrame, keys: Sequence[str] = PATCH_KEYS, patch: str = "patch") -> DataFrame:
    return diff_lines(patch_rows(patches, keys, patch), keys)


def diff_files(rows: DataFrame, keys: Sequence[str] = PATCH_KEYS) -> DataFrame:
    """One row per file of a patch: path, old_path (renames), status and delta label."""
    head = F.col("kind").isNull() & (F.col("file_seq") > 0)
    said = lambda s: F.coalesce(F.max(head & F.col("raw").startswith(s)), F.lit(False))
    grouped = rows.filter(F.col("file_seq") > 0).groupBy(*keys, "file_seq").agg(
        F.first("path").alias("path"),
        F.max(F.when(head & F.col("raw").startswith("rename from "), F.col("raw").substr(F.lit(13), F.length("raw")))).alias("old_path"),
        said("new file").alias("is_new"), said("deleted file").alias("is_deleted"),
        F.count_if(F.col("kind") == "add").alias("add"), F.count_if(F.col("kind") == "del").alias("del"))
    delta = F.when(F.col("is_deleted"), "deleted").when(F.col("is_new"), "new").otherwise(delta_label(F.col("add"), F.col("del")))
    return grouped.withColumn("delta", delta)


def rename_map(files: DataFrame, keys: Sequence[str] = PATCH_KEYS) -> DataFrame:
    return files.filter(F.col("old_path").isNotNull()).select(*keys, "path", "old_path")


def changed_paths(files: DataFrame, keys: Sequence[str] = PATCH_KEYS) -> DataFrame:
    return files.select(*keys, "path").distinct()


def base_paths(files: DataFrame, keys: Sequence[str] = PATCH_KEYS) -> DataFrame:
    """Base-side path of every file that exists on both sides."""
    both = files.filter(~F.col("is_new") & ~F.col("is_deleted"))
    return both.select(*keys, F.coalesce("old_path", "path").alias("path")).distinct()


def delta_counts(lines: DataFrame, keys: Sequence[str] = ("pr_id", "path"), kind: str = "kind") -> DataFrame:
    return lines.groupBy(*keys).agg(F.count_if(F.col(kind) == "add").alias("add"), F.count_if(F.col(kind) == "del").alias("del"))


def with_head_line(lines: DataFrame, keys: Sequence[str] = ("pr_id", "path"), idx: str = "idx", new: str = "new",
                   width: int | None = None) -> DataFrame:
    """Add ``head_line``: own new number, or for a removed line the one above it (at least 1)."""
    out = scan(lines, keys, [idx], {"_above": last_value(F.col(new))}, by_width(idx, width))
    one = F.lit(1).cast("long")
    return out.withColumn("head_line", F.coalesce(F.col(new).cast("long"), F.greatest(one, F.coalesce(F.col("_above").cast("long"), one)))).drop("_above")


def changed_head_lines(lines: DataFrame, keys: Sequence[str] = ("pr_id", "path"), idx: str = "idx", kind: str = "kind",
                       new: str = "new", text: str = "text", width: int | None = None) -> DataFrame:
    """Distinct (keys, head_line) touched by significant added or removed lines."""
    marked = lines.select(*keys, idx, new, ((F.col(kind) != "ctx") & ~insignificant(F.col(text))).alias("_hit"))
    placed = with_head_line(marked, keys, idx, new, width)
    return placed.filter("_hit").select(*keys, "head_line").distinct()
