"""Who wrote each changed line, which entry owns it, and the threads on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlore.functions.text import parent_dir
from patchlore.operators.diff import with_head_line
from patchlore.operators.history import attribute_tracked
from patchlore.operators.identity import at_head
from patchlore.plans.intervals import LINE_BIN, points_in_spans
from patchlore.plans.scan import by_width, islands, last_value, number_rows, scan
from patchlore.plans.skew import all_of, hot_keys, skew_join
from patchlore.session import cut

# What makes a test file, kinds no test exercises, and the sentences of the facts.
TEST_PATH = "test|spec"
UNTESTABLE_KINDS = ["typeAlias", "interface"]
NO_TEST_FACT = "no direct test references"
REFERENCES_FACT = " references at head"
TEST_FACT = "covered by test"
LEFTOVER_CONTEXT = 2

SENT_RENAMES = 1 << 19  # renames that are broadcast at most; more are shuffled, with the lines

PR = ("pr_id",)


def _match_nth(lines: DataFrame, written: DataFrame, keys: list[str], newest_first: bool) -> DataFrame:
    """(keys, path, idx, by): n-th line of a text in a file to the n-th commit line of that text.

    Both sides are shuffled once, by file and text, numbered there and met there. A text
    can only fill many rows in a file that has many: those files are counted, and theirs
    are numbered in blocks.
    """
    file = keys + ["path"]
    same = file + ["_h"]
    known = all_of([F.col(c).isNotNull() for c in same])  # a null equals no other
    lines, written = lines.filter(known), written.filter(known)
    hot = F.broadcast(hot_keys(lines.select(*file).unionByName(written.select(*file)), file).drop("_fan"))
    few = [d.join(hot, file, "left_anti") for d in (lines, written)]
    many = [d.join(hot, file, "left_semi") for d in (lines, written)]

    want = few[0].select(*same, "idx", F.lit(True).alias("_want"))
    both = want.unionByName(few[1].select(*same, "ord", "line_idx", "sha", F.lit(False).alias("_want")), allowMissingColumns=True)
    order = [F.col(c).asc() if newest_first else F.col(c).desc() for c in ("ord", "line_idx")]
    nth = F.row_number().over(Window.partitionBy(*same, "_want").orderBy("idx", *order))  # idx is null in all lines of commits
    met = both.repartition(*same).withColumn("_nth", nth).groupBy(*same, "_nth").agg(
        F.max("idx").alias("idx"), F.max("sha").alias("by"), F.count("*").alias("_n"))
    met = met.filter("_n = 2").select(*file, "idx", "by")

    want = number_rows(many[0], same, ["idx"], by_width("idx"), "_nth")
    # one text may fill a large part of a much edited file: then each commit is a block of its own
    have = number_rows(many[1], same, ["ord", "line_idx"], F.col("ord"), "_nth", reverse=not newest_first, split_hot_only=True)
    have = have.select(*same, "_nth", F.col("sha").alias("by"))
    return met.unionByName(want.join(have, same + ["_nth"]).select(*file, "idx", "by"))


def _hashed(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind with ``_h``, which is equal for equal texts only: a text of up to 15 bytes itself, of others 16 bytes."""
    text = F.col("text").cast("binary")
    return df.filter(F.col("kind") == kind).withColumn("_h", F.when(F.octet_length(text) < 16, text).otherwise(F.unhex(F.md5(text))))


def _current_paths(written: DataFrame, renames: DataFrame | None, keys: list[str]) -> DataFrame:
    """Lines under the path their file has at the newest commit.

    ``renames`` (keys, path, old_path, ord) are applied in time, see ``identity``;
    without ``ord`` each is newer than every line.
    """
    if renames is None:
        return written
    if "ord" in renames.columns:
        return at_head(written, renames, keys)
    r = cut(renames.select(*keys, F.col("old_path").alias("path"), F.col("path").alias("_new")), "renames")
    if r.count() <= SENT_RENAMES:
        r = F.broadcast(r)
    return skew_join(written, r, keys + ["path"], "left").withColumn("path", F.coalesce("_new", "path")).drop("_new")


def attribute_additions(lines: DataFrame, written: DataFrame, blame: DataFrame | None = None, keys: Sequence[str] = PR,
                        renames: DataFrame | None = None) -> DataFrame:
    """(keys, path, idx, by) of added lines: blame first, else the newest commit adding the same text.

    ``lines`` has (keys, path, idx, kind, new, text); ``written`` the lines of
    each commit's own diff (keys, path, sha, ord, line_idx, kind, text), ord 1
    being the newest commit; ``blame`` has (keys, path, line, sha). Equal texts
    are paired by occurrence. Long texts are compared by hash and not
    shuffled.
    """
    keys = list(keys)
    adds = _hashed(lines, "add").select(*keys, "path", "idx", "new", "_h")
    known = None
    if blame is not None:
        b = blame.select(*keys, "path", F.col("line").alias("new"), F.col("sha").alias("by"))
        adds = cut(adds.join(b, keys + ["path", "new"], "left"), "adds")
        known = adds.filter(F.col("by").isNotNull()).select(*keys, "path", "idx", "by")
        adds = adds.filter(F.col("by").isNull()).drop("by")
    made = _current_paths(_hashed(written, "add").drop("text", "kind"), renames, keys)
    found = _match_nth(adds.drop("new"), made, keys, newest_first=True)
    return found if known is None else known.unionByName(found)


def attribute_deletions(lines: DataFrame, written: DataFrame, renames: DataFrame | None = None, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, idx, by) of removed lines: the earliest commit whose own diff removes that text.
    """
    keys = list(keys)
    gone = _current_paths(_hashed(written, "del").drop("text", "kind"), renames, keys)
    dels = _hashed(lines, "del").select(*keys, "path", "idx", "_h")
    return _match_nth(dels, gone, keys, newest_first=False)


def attribute_lines(lines: DataFrame, written: DataFrame, commits: DataFrame, blame: DataFrame | None = None,
                    renames: DataFrame | None = None, keys: Sequence[str] = PR, tracked: bool = False) -> DataFrame:
    """Add ``by`` to every changed line; lines no commit explains go to the newest commit.

    With ``tracked`` lines are followed by their numbers through the commits, see
    ``history``; ``written`` then needs ``old`` and ``new``, texts and ``blame`` are not read.
    """
    keys = list(keys)
    if tracked:
        by = attribute_tracked(lines, written, commits, keys, renames)
    else:
        by = attribute_additions(lines, written, blame, keys, renames).unionByName(attribute_deletions(lines, written, renames, keys))
    head = commits.groupBy(*keys).agg(F.min_by("sha", "ord").alias("_head")) if keys else commits.agg(F.min_by("sha", "ord").alias("_head"))
    changed = F.coalesce(F.col("kind") != "ctx", F.lit(False))
    found = lines.filter(changed).join(by, keys + ["path", "idx"], "left")  # other lines have no commit and are not shuffled
    d = found.unionByName(lines.filter(~changed).withColumn("by", F.lit(None).cast(found.schema["by"].dataType)))
    if keys:
        d = skew_join(d, head, keys, "left")
        fallback = F.col("_head")
    else:
        fallback = head.scalar()
    return cut(d.withColumn("by", F.when(F.col("kind") != "ctx", F.coalesce("by", fallback))).drop("_head"), "attributed")


def stamp_lines(lines: DataFrame, commits: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Add ``band`` and ``conflict``: a line first written by a merge has no band.

    ``commits`` has (keys, sha, band, parents); two parents make a merge.
    """
    c = commits.select(*keys, F.col("sha").alias("by"), F.col("band").alias("_band"), (F.size("parents") >= 2).alias("_merge"))
    # rows without a commit, often half of all, would meet in one partition
    known = skew_join(lines.filter(F.col("by").isNotNull()), c, list(keys) + ["by"], "left")
    d = known.unionByName(lines.filter(F.col("by").isNull()), allowMissingColumns=True)
    merge = F.coalesce("_merge", F.lit(False))
    return d.withColumn("conflict", merge).withColumn("band", F.when(~merge, F.col("_band"))).drop("_band", "_merge")


def slice_by_span(lines: DataFrame, spans: DataFrame, keys: Sequence[str] = ("pr_id", "path"), idx: str = "idx", new: str = "new",
                  def_id: str = "def_id", width: int = LINE_BIN) -> DataFrame:
    """(keys, idx, entry_id): each diff row to the one span its head line falls in (later start wins)."""
    rows = with_head_line(lines.select(*keys, idx, new), keys, idx, new)
    spans = spans.select(*keys, "span_start", "span_end", def_id)
    hit = points_in_spans(rows, spans, keys, "head_line", "span_start", "span_end", width)
    best = F.max_by(def_id, F.struct("span_start", def_id)).alias("entry_id")
    return hit.groupBy(*keys, idx).agg(best)


def touches(entry_lines: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Distinct (commit, entry): a changed line of the entry is by that commit."""
    return entry_lines.filter(F.col("by").isNotNull()).select(*keys, F.col("by").alias("sha"), "entry_id").distinct()


def trace_facts(entries: DataFrame, uses: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, entry_id, relation, file, negative): reference count, covering test files, or their absence.

    ``uses`` has (keys, def_id, file), one row per use.
    """
    keys = list(keys)
    e = entries.select(*keys, "entry_id")
    per_file = uses.groupBy(*keys, F.col("def_id").alias("entry_id"), "file").agg(F.count("*").alias("n"))
    per_file = cut(skew_join(per_file, e, keys + ["entry_id"], "left_semi"), "used")
    refs = per_file.groupBy(*keys, "entry_id").agg(F.sum("n").alias("n"))
    refs = refs.select(*keys, "entry_id", F.concat(F.col("n").cast("string"), F.lit(REFERENCES_FACT)).alias("relation"),
                       F.lit(None).cast("string").alias("file"), F.lit(False).alias("negative"))
    tests = per_file.filter(F.col("file").rlike(TEST_PATH))
    cover = tests.select(*keys, "entry_id", F.lit(TEST_FACT).alias("relation"), "file", F.lit(False).alias("negative"))
    none = e.join(tests.select(*keys, "entry_id").distinct(), keys + ["entry_id"], "left_anti")
    none = none.select(*keys, "entry_id", F.lit(NO_TEST_FACT).alias("relation"), F.lit(None).cast("string").alias("file"), F.lit(True).alias("negative"))
    return refs.unionByName(cover).unionByName(none)


def untested(entries: DataFrame, facts: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Changed entries, types aside, that no test references."""
    flagged = facts.filter(F.col("relation") == NO_TEST_FACT).select(*keys, "entry_id").distinct()
    ours = entries.filter(F.col("seed") & ~F.col("kind").isin(UNTESTABLE_KINDS))
    return ours.join(flagged, list(keys) + ["entry_id"], "left_semi")


def build_threads(comments: DataFrame, keys: Sequence[str] = PR, created: Column | None = None) -> DataFrame:
    """Comments with ``thread_id`` and ``pos``: the root at 0, its replies in time order from 1.

    ``created`` (epoch seconds) orders replies; a reply to an unknown root is dropped.
    """
    keys = list(keys)
    at = F.unix_timestamp(F.try_to_timestamp(F.col("created").cast("string"))) if created is None else created
    c = comments.withColumn("_at", at.cast("long"))
    roots = c.filter(F.col("in_reply_to").isNull()).withColumn("thread_id", F.col("id")).withColumn("pos", F.lit(0).cast("long"))
    replies = c.filter(F.col("in_reply_to").isNotNull()).withColumn("thread_id", F.col("in_reply_to"))
    replies = skew_join(replies, roots.select(*keys, "thread_id"), keys + ["thread_id"], "left_semi")
    replies = number_rows(replies, keys + ["thread_id"], ["_at", "id"], F.floor(F.col("_at") / 3600), "pos", split_hot_only=True)
    return roots.unionByName(replies.select(*roots.columns)).drop("_at")


def assign_threads(roots: DataFrame, line_owners: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Add ``entry_id``: owner of the anchored line, null for a thread that belongs to its file only.

    ``roots`` has (keys, path, line), ``line_owners`` (keys, path, new, entry_id).
    """
    own = line_owners.filter(F.col("new").isNotNull()).select(*keys, "path", F.col("new").alias("line"), "entry_id")
    return skew_join(roots, own, list(keys) + ["path", "line"], "left")


def stale_threads(threads: DataFrame, versions: DataFrame, keys: Sequence[str] = ("pr_id", "path", "line")) -> DataFrame:
    """Threads whose line was rewritten later: before, after, and the rewrite's sha and time.

    ``threads`` has (keys, thread_id, created), ``versions`` (keys, at, sha,
    text), times in epoch microseconds. ``before`` is the last version at or
    before the comment (null if none), ``after`` the newest one.
    """
    keys = list(keys)
    v = versions.select(*keys, "at", F.lit(0).alias("_is"), F.lit(None).cast(threads.schema["thread_id"].dataType).alias("thread_id"),
                        F.struct("text").alias("_v"))
    t = threads.select(*keys, F.col("created").alias("at"), F.lit(1).alias("_is"), "thread_id", F.lit(None).cast("struct<text:string>").alias("_v"))
    both = v.unionByName(t)
    hour = F.floor(F.col("at") / F.lit(3_600_000_000))
    seen = scan(both, keys, ["at", "_is"], {"_before": last_value(F.col("_v"))}, hour, split_hot_only=True)
    seen = seen.filter(F.col("_is") == 1).select(*keys, "thread_id", F.col("at").alias("created"), F.col("_before.text").alias("before"))
    now = versions.groupBy(*keys).agg(F.max(F.struct("at", "sha", "text")).alias("_now"))
    d = skew_join(seen, now, keys).filter(F.col("_now.at") > F.col("created"))
    return d.select(*keys, "thread_id", "created", "before", F.col("_now.text").alias("after"),
                    F.col("_now.sha").alias("sha"), F.col("_now.at").alias("at"))


def thread_state(placed: Column, created: Column, writer_at: Column) -> Column:
    """``stale`` if the row's writer is later, ``gone`` if not placed; null without a time to judge by."""
    return (F.when(created.isNull(), F.lit(None).cast("string")).when(~placed, "gone").when(writer_at > created, "stale"))


def extra_files(facts: DataFrame, entry_paths: DataFrame, files: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Files a fact names that own no entry."""
    named = facts.filter(F.col("file").isNotNull()).select(*keys, F.col("file").alias("path")).distinct()
    d = files.join(named, list(keys) + ["path"], "left_semi")
    return d.join(entry_paths.select(*keys, "path").distinct(), list(keys) + ["path"], "left_anti")


def _side(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long"))


def leftover_lines(lines: DataFrame, entry_lines: DataFrame, members: DataFrame, keys: Sequence[str] = PR, old: str = "old",
                   new: str = "new") -> DataFrame:
    """(keys, comp_id, path, idx, kind): changed lines, in files a component's entries touch, that none of them claims."""
    keys = list(keys)
    m = members.select(*keys, "comp_id", "entry_id")
    claimed = skew_join(entry_lines, m, keys + ["entry_id"])
    claimed = cut(claimed.select(*keys, "comp_id", "path", "kind", _side(old).alias("_o"), _side(new).alias("_n")).distinct(), "claimed")
    paths = claimed.select(*keys, "comp_id", "path").distinct()
    changed = lines.filter(F.col("kind") != "ctx").select(*keys, "path", "idx", "kind", _side(old).alias("_o"), _side(new).alias("_n"))
    # the components that claim a line are put beside it, so that a row per line and component is never shuffled
    line = keys + ["path", "kind", "_o", "_n"]
    d = changed.join(claimed.groupBy(*line).agg(F.collect_set("comp_id").alias("_by")), line, "left")
    d = skew_join(d, paths, keys + ["path"]).filter(~F.coalesce(F.array_contains("_by", F.col("comp_id")), F.lit(False)))
    return d.select(*keys, "comp_id", "path", "idx", "kind")


def context_window(leftover: DataFrame, lines: DataFrame, keys: Sequence[str] = PR, span: int = LEFTOVER_CONTEXT) -> DataFrame:
    """Rows of the file within two rows of a leftover line, per component.

    Each leftover row asks for its five row numbers, so the file is joined by
    row number instead of scanned by a window.
    """
    keys = list(keys)
    asked = F.explode(F.sequence(F.col("idx") - span, F.col("idx") + span)).alias("idx")
    want = leftover.select(*keys, "comp_id", "path", asked).distinct()
    return want.join(lines, keys + ["path", "idx"])


def owner_of_lines(entry_lines: DataFrame, keys: Sequence[str] = PR, order: str = "entry_ord", old: str = "old", new: str = "new") -> DataFrame:
    """(keys, path, kind, old, new, owner): the last entry claiming a line."""
    return entry_lines.groupBy(*keys, "path", "kind", old, new).agg(F.max_by("entry_id", order).alias("owner"))


def owner_runs(owned: DataFrame, keys: Sequence[str] = ("pr_id", "path"), idx: str = "idx", owner: str = "owner",
               width: int | None = None) -> DataFrame:
    """Maximal runs of rows with one owner (null: no entry), in row order."""
    d = islands(owned.select(*keys, idx, owner), keys, [idx], F.col(owner), by_width(idx, width))
    return d.groupBy(*keys, "run").agg(F.first(owner).alias(owner), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"),
                                       F.count("*").alias("rows"))


def component_stats(entry_lines: DataFrame, members: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Per component: entries, folders, changed lines and the stats text."""
    keys = list(keys)
    m = members.select(*keys, "comp_id", "entry_id")
    sizes = m.groupBy(*keys, "comp_id").agg(F.count_distinct("entry_id").alias("objects"))
    per = entry_lines.groupBy(*keys, "entry_id", "path").agg(F.count_if(F.col("kind") != "ctx").alias("n"))
    d = per.join(m, keys + ["entry_id"]).groupBy(*keys, "comp_id").agg(
        F.count_distinct(parent_dir(F.col("path").cast("string"))).alias("folders"), F.sum("n").alias("changed_lines"))
    d = sizes.join(d, keys + ["comp_id"], "left").na.fill(0, ["folders", "changed_lines"])
    plural = lambda c, w: F.concat(F.col(c).cast("string"), F.lit(f" {w}"), F.when(F.col(c) == 1, "").otherwise("s"))
    return d.withColumn("stats", F.concat(plural("objects", "object"), F.lit(" · "), plural("folders", "folder")))


def initial_component(stats: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Component with the biggest change, the first of equals."""
    best = F.min(F.struct((-F.col("changed_lines")).alias("n"), "comp_id")).alias("p")
    d = stats.groupBy(*keys).agg(best) if keys else stats.agg(best)
    return d.select(*keys, F.col("p.comp_id").alias("comp_id"))


def changed_files(files: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Changed files in path order (binary order)."""
    return files.select(*keys, "path").distinct().orderBy(*keys, "path")


def file_stats(lines: DataFrame, entry_first_file: DataFrame, keys: Sequence[str] = PR, band: str = "band") -> DataFrame:
    """Per file: added and removed lines, its bands, and the number of entries it is the first file of."""
    keys = list(keys)
    d = lines.groupBy(*keys, "path").agg(F.count_if(F.col("kind") == "add").alias("add"), F.count_if(F.col("kind") == "del").alias("del"),
                                         F.array_sort(F.collect_set(band)).alias("bands"))
    objects = entry_first_file.groupBy(*keys, "path").agg(F.count("*").alias("objects"))
    return d.join(objects, keys + ["path"], "left").na.fill(0, ["objects"])
