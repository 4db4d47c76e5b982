"""Reports over components, authors, files and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from patchlore.functions.text import base_name, is_merge_message, parent_dir
from patchlore.operators.graph import first_of, names_and_rest
from patchlore.plans.scan import by_width, number_rows
from patchlore.plans.skew import skew_join
from patchlore.session import cut

# List lengths and the conclusions that do not fail a check.
DETAIL_COMMITS = 5
CONTEXT_NAMES = 3
FAILING_NAMES = 3
PASSING = ["success", "neutral", "skipped"]

PR = ("pr_id",)


def _real(commits: DataFrame) -> DataFrame:
    return commits.filter(~is_merge_message(F.col("message")))


def component_commits(touches: DataFrame, commits: DataFrame, members: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Distinct (keys, comp_id, sha) of non-merge commits touching a component, with the commit's columns.

    Touches shrink to (component, commit) pairs before they meet the commits.
    """
    keys = list(keys)
    pairs = skew_join(touches, members.select(*keys, "comp_id", "entry_id"), keys + ["entry_id"])
    pairs = pairs.select(*keys, "comp_id", "sha").distinct()
    return pairs.join(_real(commits), keys + ["sha"])


def contribution_matrix(comp_commits: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, comp_id, author, commits, newest_band)."""
    return comp_commits.groupBy(*keys, "comp_id", "author").agg(F.count("*").alias("commits"), F.max("band").alias("newest_band"))


def contribution_pivot(matrix: DataFrame, authors: Sequence[str], keys: Sequence[str] = PR) -> DataFrame:
    """Components by the given authors, one column each (null: no commit)."""
    return matrix.groupBy(*keys, "comp_id").pivot("author", list(authors)).agg(F.sum("commits"))


def matrix_detail(comp_commits: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Five newest commits of each cell, with ``more``, the number left out."""
    keys = list(keys)
    cell = keys + ["comp_id", "author"]
    n = comp_commits.groupBy(*cell).agg(F.count("*").alias("_n"))
    top = first_of(comp_commits, cell, [F.desc("ts"), F.asc("ord")], DETAIL_COMMITS)
    d = top.join(n, cell)
    return d.withColumn("more", F.greatest(F.col("_n") - DETAIL_COMMITS, F.lit(0))).drop("_n")


def author_totals(commits: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    return _real(commits).groupBy(*keys, "author").agg(F.count("*").alias("commits"))


def overview(commits: DataFrame, components: DataFrame, threads: DataFrame, lines: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """One row per group: commits, contributors, components, entries with threads, merge-resolution lines."""
    keys = list(keys)
    d = _real(commits).groupBy(*keys).agg(F.count("*").alias("commits"), F.count_distinct("author").alias("contributors"))
    parts = [components.groupBy(*keys).agg(F.count_distinct("comp_id").alias("components")),
             threads.filter(F.col("entry_id").isNotNull()).groupBy(*keys).agg(F.count_distinct("entry_id").alias("entries_with_threads")),
             lines.groupBy(*keys).agg(F.count_if("conflict").alias("conflict_lines"))]
    for p in parts:
        d = d.join(p, keys, "left")
    return d.na.fill(0, ["components", "entries_with_threads", "conflict_lines"])


def feed_entries(touches: DataFrame, members: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, sha, comp_id, entry_id, pos): entries of each component a commit touches."""
    return skew_join(touches, members.select(*keys, "comp_id", "entry_id", "pos"), list(keys) + ["entry_id"])


def feeds(entries: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, sha, comp_id, entries, first_entry) from ``feed_entries``."""
    return entries.groupBy(*keys, "sha", "comp_id").agg(F.count("*").alias("entries"), F.min_by("entry_id", "pos").alias("first_entry"))


def file_tree(files: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Directories and files with depth, subtree totals and ``sort_key`` (dirs before files, by name, per level).

    ``files`` has (keys, path, add, del). A path yields one row per parent
    directory; totals combine map-side, so a root directory is no hot key.
    """
    keys = list(keys)
    parts = F.split("path", "/")
    depth = F.size(parts)
    tag = lambda arr, last: F.transform(arr, lambda x, i: F.concat(F.when(F.lit(last) & (i == F.size(arr) - 1), "1").otherwise("0"), x))
    levels = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
    dirs = files.withColumn("_n", F.explode(levels))
    head = F.slice(parts, F.lit(1), F.col("_n"))
    dirs = dirs.groupBy(*keys, F.array_join(head, "/").alias("node")).agg(F.sum("add").alias("add"), F.sum("del").alias("del"), F.count("*").alias("files"))
    segs = F.split("node", "/")
    dirs = dirs.select(*keys, "node", F.lit(True).alias("is_dir"), (F.size(segs) - 1).alias("depth"), "add", "del", "files", tag(segs, False).alias("sort_key"))
    leaves = files.select(*keys, F.col("path").alias("node"), F.lit(False).alias("is_dir"), (depth - 1).alias("depth"), F.col("add").cast("long").alias("add"),
                          F.col("del").cast("long").alias("del"), F.lit(1).cast("long").alias("files"), tag(parts, True).alias("sort_key"))
    return dirs.unionByName(leaves)


def dir_groups(files: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Files and lines per parent directory (``/`` for the root)."""
    folder = parent_dir(F.col("path"))
    return files.groupBy(*keys, F.when(folder == "", "/").otherwise(folder).alias("dir")).agg(
        F.count("*").alias("files"), F.sum("add").alias("add"), F.sum("del").alias("del"))


def component_rail(walk: DataFrame, context: DataFrame, marks: DataFrame, reviewers: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(reviewer, keys, comp_id, stops, read, unchanged) for every reviewer of the group."""
    keys = list(keys)
    stops = walk.groupBy(*keys, "comp_id").agg(F.count("*").alias("stops"))
    other = context.groupBy(*keys, "comp_id").agg(F.count("*").alias("unchanged"))
    sizes = stops.join(other, keys + ["comp_id"], "full").na.fill(0, ["stops", "unchanged"])
    ticked = walk.select(*keys, "comp_id", "id").join(marks.filter("read").select("reviewer", *keys, "id"), keys + ["id"])
    ticked = ticked.groupBy("reviewer", *keys, "comp_id").agg(F.count("*").alias("read"))
    every = skew_join(sizes, reviewers.select("reviewer", *keys).distinct(), keys)
    d = every.join(ticked, ["reviewer", *keys, "comp_id"], "left").na.fill(0, ["read"])
    return d.select("reviewer", *keys, "comp_id", "stops", "read", "unchanged")


def component_totals(file_deltas: DataFrame, entry_paths: DataFrame, members: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Added and removed lines over the whole of each file a component's entries touch."""
    keys = list(keys)
    pairs = skew_join(entry_paths.select(*keys, "entry_id", "path").distinct(), members.select(*keys, "comp_id", "entry_id"), keys + ["entry_id"])
    pairs = pairs.select(*keys, "comp_id", "path").distinct()
    return pairs.join(file_deltas, keys + ["path"]).groupBy(*keys, "comp_id").agg(
        F.count("*").alias("files"), F.sum("add").alias("add"), F.sum("del").alias("del"))


def file_objects(entry_lines: DataFrame, home: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, entry_id, comp_id, add, del): entries in a file; ``home`` gives an entry's component."""
    keys = list(keys)
    d = entry_lines.groupBy(*keys, "path", "entry_id").agg(F.count_if(F.col("kind") == "add").alias("add"), F.count_if(F.col("kind") == "del").alias("del"))
    return d.join(home.select(*keys, "entry_id", "comp_id"), keys + ["entry_id"], "left")


def context_group(context: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Per component: unchanged entries, first three file names in page order, number of other names.

    ``context`` has (keys, comp_id, entry_id, pos, file).
    """
    keys = list(keys)
    group = keys + ["comp_id"]
    objects = context.groupBy(*group).agg(F.count("*").alias("objects"))
    names = context.groupBy(*group, base_name(F.col("file")).alias("name")).agg(F.min("pos").alias("_at"))
    d = names_and_rest(names, group, ["_at", "name"], CONTEXT_NAMES)
    return objects.join(d, group).select(*group, "objects", "names", F.greatest(F.col("total") - CONTEXT_NAMES, F.lit(0)).alias("more_files"))


def commit_dots(touched: DataFrame, keys: Sequence[str] = PR, order: str = "ord", width: int | None = None) -> DataFrame:
    """(keys, entry_id, pos, band): bands of the commits that wrote an entry, in page order."""
    keys = list(keys)
    d = number_rows(cut(touched, "touched").select(*keys, "entry_id", order, "band"), keys + ["entry_id"], [order], by_width(order, width), "pos")
    return d.select(*keys, "entry_id", "pos", "band")


def check_snapshot(runs: DataFrame, keys: Sequence[str] = PR, name: str = "name", order: str = "run_id") -> DataFrame:
    """Per group: totals, state and first three failing names; a group without runs has no row.

    A completed run without a conclusion fails.
    """
    keys = list(keys)
    done = F.col("status") == "completed"
    fails = done & ~F.coalesce(F.col("conclusion").isin(PASSING), F.lit(False))
    d = runs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(fails).alias("failing"), F.count_if(~done).alias("running"))
    bad = first_of(runs.filter(fails).select(*keys, order, name), keys, [F.col(order)], FAILING_NAMES)
    names = bad.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("n")))).alias("_f"))
    names = names.select(*keys, F.transform("_f", lambda x: x["n"]).alias("names"))
    state = F.when(F.col("failing") > 0, "failing").when(F.col("running") > 0, "running").otherwise("passing")
    d = d.withColumn("state", state).join(names, keys, "left")
    return d.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
