"""Lines followed through commits: where a line is at the newest commit, or which commit removed it.

A commit changes a file in two half-steps: it takes lines out, then puts lines in. Each
is a map from line numbers to line numbers, kept as ranges that share one shift; a number
in no range is removed. Maps of neighbouring half-steps are composed in pairs, pairs of
pairs, and so on, so a line passes all commits of its file in as many steps as their
number has binary digits. One level of maps has no more ranges than there are changed
lines and half-steps, because composing only cuts ranges where either map has a border.
Both composing and looking up are ordered scans per file and block, see ``plans.scan``.
Files with at most ``REPLAY_ROWS`` changed and asked lines need none of these rounds: their
lines are grouped by file once and each file is replayed, commit by commit, where they lie.

``ord`` counts commits from 1, the newest, as in ``identity``; any order numbers will
do. History is taken as linear in that order. Rows without a path, key, order or line
number, or with a line below 1, are left out; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from patchlore.operators.identity import at_head
from patchlore.plans.scan import by_width, group_sum, last_value, row_before, running_sum, scan
from patchlore.plans.skew import skew_join
from patchlore.session import cut

PR = ("pr_id",)
ORD_BLOCK = 1 << 16
REPLAY_ROWS = 20_000  # a file with more changed and asked lines is not replayed in one task
END = 1 << 62  # upper end of a range without one; as an order number, before the oldest commit


def _moved(line: Column, shift: Column) -> Column:
    return F.when(line >= END, F.lit(END)).otherwise(line + shift)


def _usable(df: DataFrame, file: list[str]) -> DataFrame:
    ok = F.col("line") >= 1
    for c in file:
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok)


def line_changes(written: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, ord, kind, line) of each commit's own diff: the new number of added, the old number of removed lines."""
    line = F.when(F.col("kind") == "add", F.col("new")).otherwise(F.col("old")).cast("long")
    changed = written.filter(F.col("kind").isin("add", "del") & F.col("ord").isNotNull())
    return _usable(changed.select(*keys, "path", "ord", "kind", line.alias("line")), [*keys, "path"]).distinct()


def _commit_steps(changes: DataFrame, file: list[str]) -> DataFrame:
    """(file, ord, step): the commits of each file from 0, the oldest."""
    had = changes.select(*file, "ord").distinct()
    one = F.lit(1).cast("long")
    numbered = scan(had, file, ["ord"], {"step": running_sum(one), "steps": group_sum(one)}, by_width("ord", ORD_BLOCK), reverse=True, split_hot_only=True)
    return cut(numbered.withColumn("step", F.col("step") - 1), "commit-steps")


def _half_steps(changes: DataFrame, steps: DataFrame, file: list[str]) -> DataFrame:
    """(file, block, last, lo, hi, shift) of every half-step; block 2n takes out the lines of commit n, 2n + 1 puts lines in."""
    put_in = (F.col("kind") == "add").cast("long")
    d = skew_join(changes, steps, file + ["ord"]).select(*file, (F.col("step") * 2 + put_in).alias("block"), "steps", "line")
    zero = F.lit(0).cast("long")
    marks = steps.select(*file, F.explode(F.array(F.col("step") * 2, F.col("step") * 2 + 1)).alias("block"), "steps", zero.alias("line"))
    one = F.lit(1).cast("long")
    s = scan(d.unionByName(marks), file + ["block"], ["line"],
             {"_next": row_before(F.col("line")), "_after": running_sum(one, inclusive=False), "_all_rows": group_sum(one)}, by_width("line"), reverse=True)
    n = F.col("_all_rows") - F.col("_after") - 1  # lines of the half-step up to this one
    out = F.col("block") % 2 == 0
    lo = F.when(out, F.col("line")).otherwise(F.col("line") - n) + 1
    hi = F.coalesce(F.when(out, F.col("_next") - 1).otherwise(F.col("_next") - n - 1), F.lit(END))
    ranges = s.select(*file, "block", (F.col("steps") * 2 - 1).alias("last"), lo.alias("lo"), hi.alias("hi"), F.when(out, -n).otherwise(n).alias("shift"))
    return ranges.filter("lo <= hi")


def _composed(maps: DataFrame, file: list[str], level: int) -> DataFrame:
    """Maps of blocks twice as long: each pair's left map, then its right one."""
    left = F.col("block") % 2 == 0
    alone = left & (F.col("block") == F.shiftright("last", level))
    pair = F.shiftright("block", 1).alias("block")
    border = maps.filter(~alone).select(
        *file, pair, "last", F.when(left, F.col("lo") + F.col("shift")).otherwise(F.col("lo")).alias("pos"), left.alias("_left"),
        F.when(left, F.struct(_moved(F.col("hi"), F.col("shift")).alias("hi"), "shift")).alias("_l"), F.when(~left, F.struct("hi", "shift")).alias("_r"))
    met = scan(border, file + ["block"], ["pos", "_left"], {"_a": last_value(F.col("_l")), "_b": last_value(F.col("_r"))}, by_width("pos"))
    # a range of both begins where the later of two overlapping ranges does, in the numbers between the two maps
    end = F.least("_a.hi", "_b.hi")
    both = met.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (end >= F.col("pos")))
    back = -F.col("_a.shift")
    joint = both.select(*file, "block", "last", (F.col("pos") + back).alias("lo"), _moved(end, back).alias("hi"), (F.col("_a.shift") + F.col("_b.shift")).alias("shift"))
    return joint.unionByName(maps.filter(alone).select(*file, pair, "last", "lo", "hi", "shift"))


def _through(lines: DataFrame, maps: DataFrame, file: list[str], level: int) -> DataFrame:
    """``lines`` with ``_shift``: what the block that begins at their version adds to their number, null where it removes them."""
    asked = lines.withColumns({"block": F.shiftright("at", level), "_q": F.lit(1)})
    ranges = maps.select(*file, "block", F.col("lo").alias("pos"), F.lit(0).alias("_q"), F.struct("hi", "shift").alias("_m"))
    met = scan(asked.unionByName(ranges, allowMissingColumns=True), file + ["block"], ["pos", "_q"], {"_in": last_value(F.col("_m"))}, by_width("pos"))
    shift = F.when(F.col("_in.hi") >= F.col("pos"), F.col("_in.shift"))
    return met.filter("_q = 1").select(*lines.columns, shift.alias("_shift"))


def _advance(lines: DataFrame, maps: DataFrame, file: list[str], level: int, going: Column, stop: int) -> DataFrame:
    """Take the ``going`` lines through one block; ``dead`` becomes ``stop`` for those that it removes, the others keep it."""
    met = _through(lines.filter(going), maps, file, level)
    lives = F.col("_shift").isNotNull()
    size = F.lit(1 << level).cast("long")
    met = met.withColumns({"pos": F.col("pos") + F.coalesce("_shift", F.lit(0)), "at": F.col("at") + F.when(lives, size).otherwise(0),
                           "dead": F.when(F.col("dead").isNotNull() | ~lives, F.lit(stop))}).drop("_shift")
    return cut(met.unionByName(lines.filter(~going)), "followed")


def _versions(asked: DataFrame, steps: DataFrame, file: list[str]) -> DataFrame:
    """``asked`` with ``at``, the half-step that comes after its commit, and ``last``, its file's last one."""
    at = F.coalesce(F.col("ord").cast("long"), F.lit(END))
    q = asked.select(*file, "ord", "line", at.alias("_o"), F.lit(0).cast("long").alias("_step"))
    s = steps.select(*file, F.col("ord").cast("long").alias("_o"), F.lit(1).cast("long").alias("_step"))
    # order runs backwards: at one commit the step comes before the question
    placed = scan(q.unionByName(s, allowMissingColumns=True), file, ["_o", "_step"],
                  {"_n": running_sum(F.col("_step")), "_steps": group_sum(F.col("_step"))}, by_width("_o", ORD_BLOCK), reverse=True, split_hot_only=True)
    return placed.filter("_step = 0").select(*file, "ord", "line", F.col("line").alias("pos"), (F.col("_n") * 2).alias("at"),
                                             (F.col("_steps") * 2 - 1).alias("last"), F.lit(None).cast("int").alias("dead"))


def _replay(asked: DataFrame, changes: DataFrame, file: list[str]) -> DataFrame:
    """``follow_lines`` for files that fit a task, in one shuffle by file. Its functions are nested, so that tasks need not import this package."""
    kind = F.when(F.col("kind") == "add", 1).otherwise(0).cast("long")
    rows = changes.select(*file, "ord", kind.alias("_kind"), "line").unionByName(asked.select(*file, "ord", F.lit(2).cast("long").alias("_kind"), "line"))
    rows = rows.withColumn("_o", F.coalesce(F.col("ord").cast("long"), F.lit(END)))
    named = rows.select(*file, "ord", "line", F.col("line").alias("end_ord"), F.col("line").alias("end_line"))
    schema = StructType([StructField(f.name, f.dataType) for f in named.schema])

    def replayed(ords: np.ndarray, kinds: np.ndarray, numbers: np.ndarray, at: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end_ord, end_line) of each asked line of one file: its number is taken from commit to commit, oldest first, ``END`` if it stays.

        ``kinds`` is 0 for lines taken out and 1 for those put in; changes and asked lines come in any order.
        """
        changed = np.unique(np.stack([-ords, kinds, numbers], axis=1), axis=0)
        step, put_in, number = changed.T.copy()
        borders = np.flatnonzero(np.diff(step, prepend=END) | np.diff(put_in, prepend=END))  # where each half-step begins
        size = np.diff(borders, append=len(step))
        number -= put_in * (np.arange(len(step)) - np.repeat(borders, size) + 1)  # lines put in come after so many others of their commit
        begin = np.argsort(-at, kind="stable")  # a line is there from the first commit after its own
        there = np.searchsorted(-at[begin], step[borders], "left")
        end_ord, end_line = np.full(len(at), END, dtype=np.int64), line.copy()
        who, pos, met = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        for i, n, new, known, c in zip(borders.tolist(), size.tolist(), put_in[borders].tolist(), there.tolist(), step[borders].tolist(), strict=True):
            if known > met:
                who, pos, met = np.concatenate([who, begin[met:known]]), np.concatenate([pos, line[begin[met:known]]]), known
            half = number[i:i + n]
            before = half.searchsorted(pos)
            if new:
                pos = pos + before
                continue
            gone = half.take(before, mode="clip") == pos
            if gone.any():
                end_ord[who[gone]], end_line[who[gone]] = -c, pos[gone]
                who, pos, before = who[~gone], pos[~gone], before[~gone]
            pos = pos - before
        end_line[who] = pos
        return end_ord, end_line

    def one(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy() for c in ("_o", "_kind", "line")]
        ords, kinds, line = columns
        is_asked = kinds == 2
        row = np.flatnonzero(is_asked)
        _, first = np.unique(np.stack([ords[row], line[row]], axis=1), axis=0, return_index=True)
        row = row[first]
        end_ord, end_line = replayed(ords[~is_asked], kinds[~is_asked], line[~is_asked], ords[row], line[row])
        out = group.take(pa.array(row)).select([*file, "ord", "line"])
        return out.append_column("end_ord", pa.array(end_ord, mask=end_ord == END)).append_column("end_line", pa.array(end_line))

    ended = rows.groupBy(*file).applyInArrow(one, schema)
    return ended.select(*file, F.col("ord").cast(asked.schema["ord"].dataType).alias("ord"), "line", F.col("end_ord").cast(changes.schema["ord"].dataType).alias("end_ord"), "end_line")


def follow_lines(asked: DataFrame, changes: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, ord, line, end_ord, end_line): what becomes of line ``line`` as it is after commit ``ord``.

    A null ``ord`` asks for the version before all commits. ``end_ord`` is the
    commit that removes the line and ``end_line`` its number just before; if none
    does, ``end_ord`` is null and ``end_line`` the number at the newest commit.
    ``changes`` comes from ``line_changes``; ``ord`` may be a commit that leaves
    the file alone.
    """
    file = [*keys, "path"]
    changes = changes.select(*file, "ord", "kind", "line")
    asked = _usable(asked.select(*file, F.col("ord"), F.col("line").cast("long").alias("line")), file)
    most = int(changes.sparkSession.conf.get("patchlore.replay.rows", str(REPLAY_ROWS)))
    sizes = changes.select(*file).unionByName(asked.select(*file)).groupBy(*file).agg(F.count("*").alias("_n"))
    long_files = cut(sizes.filter(F.col("_n") > most).select(*file), "long-files")
    if long_files.isEmpty():
        return _replay(asked, changes, file)
    short = _replay(asked.join(long_files, file, "left_anti"), changes.join(long_files, file, "left_anti"), file)
    return short.unionByName(_doubled(asked.join(long_files, file, "left_semi"), changes.join(long_files, file, "left_semi"), file))


def _doubled(asked: DataFrame, changes: DataFrame, file: list[str]) -> DataFrame:
    """``follow_lines`` for files of any length, in rounds that double the number of commits passed."""
    changes = cut(changes.distinct(), "line-changes")
    steps = _commit_steps(changes, file)
    longest = steps.agg(F.max("steps")).first()[0] or 0
    lines = cut(_versions(asked.distinct(), steps, file), "followed")
    top = (2 * longest).bit_length()
    levels: dict[int, DataFrame] = {}
    maps = _half_steps(changes, steps, file)
    for level in range(1, top + 1 if longest else 1):
        maps = levels[level] = cut(_composed(maps, file, level - 1), "line-maps")
        starts = (F.shiftright("at", level) % 2 == 1) | F.lit(level == top)
        lines = _advance(lines, maps, file, level, F.col("dead").isNull() & (F.col("at") <= F.col("last")) & starts, level)
    for level in range(top - 1, 0, -1):  # a line lost in a block is lost in one of its halves
        lines = _advance(lines, levels[level], file, level, F.coalesce(F.col("dead") == level + 1, F.lit(False)), level)
    gone = steps.select(*file, F.col("step").alias("_step"), F.col("ord").alias("end_ord"))
    lines = lines.withColumn("_step", F.when(F.col("dead").isNotNull(), F.shiftright("at", 1)))
    return skew_join(lines, gone, file + ["_step"], "left").select(*file, "ord", "line", "end_ord", F.col("pos").alias("end_line"))


def track_lines(changes: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """``follow_lines`` of every line that a commit adds."""
    return follow_lines(changes.filter("kind = 'add'"), changes, keys)


def head_blame(tracked: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, line, ord): the commit that wrote each line of the newest version; lines older than all commits have no row."""
    return tracked.filter("end_ord IS NULL").select(*keys, "path", F.col("end_line").alias("line"), "ord")


def removed_origins(tracked: DataFrame, changes: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, ord, line, from_ord, from_line): where each removed line was written, null if before all commits."""
    file = [*keys, "path"]
    gone = tracked.filter("end_ord IS NOT NULL").select(*file, F.col("end_ord").alias("ord"), F.col("end_line").alias("line"),
                                                        F.col("ord").alias("from_ord"), F.col("line").alias("from_line"))
    return skew_join(changes.filter("kind = 'del'").drop("kind"), gone, file + ["ord", "line"], "left")


def attribute_tracked(lines: DataFrame, written: DataFrame, commits: DataFrame, keys: Sequence[str] = PR, renames: DataFrame | None = None) -> DataFrame:
    """(keys, path, idx, by) of changed lines: the commit that wrote an added line, or removed one of the base version.

    ``lines`` is the diff from the base to the newest commit (keys, path, idx,
    kind, old, new), ``written`` each commit's own diff (keys, path, ord, kind,
    old, new), ``commits`` gives (keys, ord, sha), ``renames`` is as in
    ``identity``. Lines that the commits' diffs do not explain have no row.
    """
    keys = list(keys)
    file = [*keys, "path"]
    changes = cut(line_changes(written if renames is None else at_head(written, renames, keys), keys), "line-changes")
    base = lines.filter("kind = 'del'").select(*file, F.lit(None).cast(dict(changes.dtypes)["ord"]).alias("ord"), F.col("old").cast("long").alias("line"))
    asked = changes.filter("kind = 'add'").select(*file, "ord", "line").unionByName(base)
    ended = cut(follow_lines(asked, changes, keys), "followed")
    kept = head_blame(ended.filter("ord IS NOT NULL"), keys).withColumn("kind", F.lit("add"))
    lost = ended.filter("ord IS NULL AND end_ord IS NOT NULL").select(*file, "line", F.col("end_ord").alias("ord"), F.lit("del").alias("kind"))
    number = F.when(F.col("kind") == "add", F.col("new")).otherwise(F.col("old")).cast("long")
    changed = lines.filter(F.col("kind").isin("add", "del")).select(*file, "idx", "kind", number.alias("line"))
    met = skew_join(changed, kept.unionByName(lost), file + ["kind", "line"])
    sha = commits.select(*keys, "ord", F.col("sha").alias("by"))
    return skew_join(met, sha, keys + ["ord"]).select(*file, "idx", "by")
