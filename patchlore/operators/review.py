"""Review state that ages with the code, thread placement and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patchlore.functions.text import anchor_line, anchor_path, base_name, is_merge_message
from patchlore.plans.intervals import points_in_spans
from patchlore.plans.scan import by_width, number_rows, running_max, scan
from patchlore.plans.skew import skew_join
from patchlore.session import cut

# Share of known commits below which a branch counts as rewritten,
# and the name of the stamp that lists exported thread ids.
REWRITTEN_SHARE = 0.3
STAMP = "review-threads"
REST = "rest:"
PART_ROWS = 1000  # comments in one payload row; a larger review becomes several

PR = ("pr_id",)
WHO = ("reviewer", "pr_id")


def reviewable_ids(entries: DataFrame, leftovers: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, id): changed entries, and ``rest:<component>`` where a component has leftover lines."""
    changed = entries.filter("seed").select(*keys, F.col("entry_id").cast("string").alias("id"))
    rest = leftovers.select(*keys, F.concat(F.lit(REST), F.col("comp_id").cast("string")).alias("id")).distinct()
    return changed.unionByName(rest)


def mark_reviewed(marks: DataFrame, commits: DataFrame, ids: DataFrame, keys: Sequence[str] = PR) -> tuple[DataFrame, DataFrame]:
    """New state of each (reviewer, group) in ``marks``: seen commits and read ids, one row each.

    State is kept as rows, not as arrays, so a group of any size fits.
    """
    real = commits.filter(~is_merge_message(F.col("message")))
    who = marks.select("reviewer", *keys, "reviewed_at")
    if not keys:
        raise ValueError("review state needs a group key")
    seen = skew_join(real.select(*keys, "sha"), who, list(keys))
    read = skew_join(ids, who, list(keys))
    return seen.select("reviewer", *keys, "sha"), read.select("reviewer", *keys, "id")


def written_counts(id_lines: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, id, by, lines, adds): changed lines per reviewable id and commit, combined map-side."""
    d = id_lines.filter((F.col("kind") != "ctx") & F.col("by").isNotNull())
    return cut(d.groupBy(*keys, "id", "by").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "add").alias("adds")), "counts")


def _unseen(counts: DataFrame, states: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of commits each reviewer of a group has not seen."""
    d = skew_join(counts, states, keys)
    known = seen.select("reviewer", *keys, F.col("sha").alias("by"))
    return skew_join(d, known, ["reviewer", *keys, "by"], "left_anti")


def new_since_checkpoint(ids: DataFrame, counts: DataFrame, states: DataFrame, seen: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(reviewer, keys, id, fresh): changed lines by unseen commits; 0 without a checkpoint.

    ``states`` has (reviewer, keys, reviewed_at); 0 or null means never checkpointed.
    """
    keys = list(keys)
    marked = states.filter(F.coalesce("reviewed_at", F.lit(0)) > 0).select("reviewer", *keys)
    fresh = _unseen(counts, marked, seen, keys).groupBy("reviewer", *keys, "id").agg(F.sum("lines").alias("fresh"))
    every = skew_join(ids, states.select("reviewer", *keys, "reviewed_at"), keys)
    d = every.join(fresh, ["reviewer", *keys, "id"], "left")
    return d.select("reviewer", *keys, "id", "reviewed_at", F.coalesce("fresh", F.lit(0)).alias("fresh"))


def is_read(fresh: DataFrame, read: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Add ``read``: ticked, and either never checkpointed or untouched since."""
    on = ["reviewer", *keys, "id"]
    d = fresh.join(read.select(*on).distinct().withColumn("_t", F.lit(True)), on, "left")
    ticked = F.coalesce("_t", F.lit(False))
    held = (F.coalesce("reviewed_at", F.lit(0)) == 0) | (F.col("fresh") == 0)
    return d.withColumn("read", ticked & held).drop("_t")


def read_state(log: DataFrame, marked: DataFrame, keys: Sequence[str] = WHO) -> DataFrame:
    """(keys, id, read) after a log of toggle, mark and reset actions.

    Toggles count from the last mark or reset of their group: an odd number
    flips what that action set. ``log`` has (keys, at, action, id), times unique
    per group; ``marked`` has (keys, id, at), the ids a mark at ``at`` ticked.
    """
    keys = list(keys)
    last = log.filter(F.col("action") != "toggle").groupBy(*keys).agg(F.max(F.struct("at", "action")).alias("_l"))
    toggles = skew_join(log.filter(F.col("action") == "toggle"), last, keys, "left")
    live = toggles.filter(F.col("_l").isNull() | (F.col("at") > F.col("_l.at")))
    odd = live.groupBy(*keys, "id").agg((F.count("*") % 2 == 1).alias("_odd"))
    base = skew_join(marked, last.filter(F.col("_l.action") == "mark"), keys).filter(F.col("at") == F.col("_l.at"))
    base = base.select(*keys, "id").distinct().withColumn("_base", F.lit(True))
    d = odd.join(base, keys + ["id"], "full")
    flag = F.coalesce("_odd", F.lit(False)) != F.coalesce("_base", F.lit(False))
    return d.select(*keys, "id", flag.alias("read"))


def new_line_count(counts: DataFrame, states: DataFrame, seen: DataFrame, keys: Sequence[str] = PR, per_id: bool = True) -> DataFrame:
    """Added lines by unseen commits per entry or per group (every one when nothing was seen)."""
    keys = list(keys)
    d = _unseen(counts.filter(F.col("adds") > 0), states.select("reviewer", *keys), seen, keys)
    group = ["reviewer", *keys] + (["id"] if per_id else [])
    return d.groupBy(*group).agg(F.sum("adds").alias("new_lines"))


def branch_rewritten(states: DataFrame, seen: DataFrame, commits: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(reviewer, keys, seen, known, rewritten): most of the seen commits are gone from the branch."""
    keys = list(keys)
    now = commits.filter(~is_merge_message(F.col("message"))).select(*keys, "sha", F.lit(1).alias("_k"))
    d = skew_join(seen.select("reviewer", *keys, "sha"), now, keys + ["sha"], "left")
    per = d.groupBy("reviewer", *keys).agg(F.count("*").alias("seen"), F.count("_k").alias("known"))
    out = states.select("reviewer", *keys).join(per, ["reviewer", *keys], "left").na.fill(0, ["seen", "known"])
    return out.withColumn("rewritten", (F.col("seen") > 0) & (F.try_divide("known", "seen") < REWRITTEN_SHARE))


def review_summary(reviewers: DataFrame, states: DataFrame, seen: DataFrame, read: DataFrame, commits: DataFrame, ids: DataFrame,
                   counts: DataFrame, entry_counts: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """One row per (reviewer, group): status and its numbers.

    ``reviewers`` lists the pairs wanted; those without a state are ``none``.
    ``counts`` covers reviewable ids, ``entry_counts`` all entries.
    """
    keys = list(keys)
    on = ["reviewer", *keys]
    real = commits.filter(~is_merge_message(F.col("message")))
    totals = real.groupBy(*keys).agg(F.count("*").alias("commits"))
    n_ids = ids.groupBy(*keys).agg(F.count("*").alias("ids"))
    fresh = new_since_checkpoint(ids, counts, states, seen, keys)
    marks = is_read(fresh, read, keys).groupBy(*on).agg(F.count_if(~F.col("read")).alias("unread"), F.count_if(F.col("fresh") > 0).alias("back"))
    seen = seen.select(*on, "sha").distinct()
    lines = new_line_count(entry_counts, states, seen, keys, per_id=False)
    d = reviewers.select(*on).join(totals, keys).join(n_ids, keys, "left")
    d = d.join(branch_rewritten(states, seen, commits, keys), on, "left")
    d = d.join(marks, on, "left").join(lines, on, "left")
    # commits not seen are all commits but the seen ones still on the branch: no reviewer meets every commit
    d = d.withColumn("_has", F.col("seen").isNotNull()).withColumn("since", F.when(F.col("_has"), F.col("commits") - F.col("known"))).na.fill(0, ["ids", "unread", "back", "since", "new_lines", "seen", "known"])
    status = (F.when(~F.col("_has"), "none").when(F.col("rewritten"), "rewritten").when(F.col("since") > 0, "new")
              .when(F.col("unread") > 0, "unread").otherwise("read"))
    return d.select(*on, "commits", "ids", status.alias("status"), "unread", "back", "since", "new_lines")


def walk_order(members: DataFrame, entries: DataFrame, weights: DataFrame, leftovers: DataFrame, keys: Sequence[str] = PR,
               width: int | None = None) -> DataFrame:
    """(keys, comp_id, id, pos): changed entries by size of change, then the leftovers stop.

    ``members`` has the page position ``pos``; ``weights`` (keys, entry_id, weight).
    """
    keys = list(keys)
    ours = members.join(entries.filter("seed").select(*keys, "entry_id"), keys + ["entry_id"])
    ours = ours.join(weights, keys + ["entry_id"], "left")
    ours = ours.select(*keys, "comp_id", F.col("entry_id").cast("string").alias("id"), F.lit(0).alias("_rest"),
                       (-F.coalesce("weight", F.lit(0))).cast("long").alias("_light"), F.col("pos").cast("long").alias("_at"))
    rest = leftovers.select(*keys, "comp_id").distinct().select(
        *keys, "comp_id", F.concat(F.lit(REST), F.col("comp_id").cast("string")).alias("id"), F.lit(1).alias("_rest"),
        F.lit(0).cast("long").alias("_light"), F.lit(0).cast("long").alias("_at"))
    rows = cut(ours.unionByName(rest), "stops")
    block = F.col("_rest") * F.lit(1 << 50) + F.col("_light")
    d = number_rows(rows, keys + ["comp_id"], ["_rest", "_light", "_at", "id"], block, "pos", split_hot_only=True)
    return d.select(*keys, "comp_id", "id", "pos")


def context_entries(members: DataFrame, entries: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Entries of a component that did not change."""
    return members.join(entries.filter(~F.col("seed")).select(*keys, "entry_id"), list(keys) + ["entry_id"])


def next_unread(walk: DataFrame, marks: DataFrame, cursors: DataFrame, keys: Sequence[str] = ("pr_id", "comp_id")) -> DataFrame:
    """(reviewer, keys, next_id): first unread stop after the reviewer's position, wrapping around.

    ``walk`` has (keys, id, pos), ``marks`` (reviewer, keys, id, read), ``cursors``
    (reviewer, keys, at), the position of the current stop (0 before the first).
    """
    keys = list(keys)
    on = ["reviewer", *keys]
    total = walk.groupBy(*keys).agg(F.max("pos").alias("_n"))
    stops = skew_join(walk, cursors.join(total, keys), keys)
    unread = stops.join(marks.filter("read").select(*on, "id"), on + ["id"], "left_anti")
    ahead = F.pmod(F.col("pos") - F.col("at") - 1, F.col("_n"))
    return unread.groupBy(*on).agg(F.min_by("id", ahead).alias("next_id"))


def drafts_at(lines: DataFrame, drafts: DataFrame, keys: Sequence[str] = ("pr_id", "path"), old: str = "old", new: str = "new") -> DataFrame:
    """Non-reply notes on their diff rows: removed rows take LEFT notes by old number, others RIGHT by new."""
    left = F.col("kind") == "del"
    rows = lines.withColumn("side", F.when(left, "LEFT").otherwise("RIGHT")).withColumn("line", F.when(left, F.col(old)).otherwise(F.col(new)))
    notes = drafts.filter(F.col("reply_to").isNull())
    return skew_join(notes, rows.select(*keys, "side", "line", "idx"), list(keys) + ["side", "line"])


def place_threads(rows: DataFrame, threads: DataFrame, keys: Sequence[str] = ("pr_id", "path"), idx: str = "idx", old: str = "old",
                  new: str = "new") -> DataFrame:
    """Threads with ``idx``, the first row whose line reaches their anchor; null if none does.

    A row takes the anchors above the highest line before it, up to its own
    line, so placing is an interval join over the rows that raise the maximum.
    """
    keys = list(keys)
    d = rows.select(*keys, idx, F.coalesce(new, old).cast("long").alias("_line"))
    d = scan(d, keys, [idx], {"_top": running_max(F.col("_line"), inclusive=False)}, by_width(idx))
    d = d.withColumn("_from", F.coalesce("_top", F.lit(-1).cast("long")) + 1)
    climbs = d.filter(F.col("_line") >= F.col("_from")).select(*keys, F.col(idx).alias("idx"), "_from", "_line")
    spots = threads.select(*keys, "line").distinct()
    hit = points_in_spans(spots, climbs, keys, "line", "_from", "_line").select(*keys, "line", "idx")
    return skew_join(threads, hit, keys + ["line"], "left")


def place_threads_exact(rows: DataFrame, threads: DataFrame, keys: Sequence[str] = ("pr_id", "path"), idx: str = "idx",
                        old: str = "old", new: str = "new") -> DataFrame:
    """Threads with ``idx``, the first row numbered exactly like their anchor; null if stranded."""
    keys = list(keys)
    at = rows.select(*keys, idx, F.coalesce(new, old).alias("line")).groupBy(*keys, "line").agg(F.min(idx).alias("idx"))
    return skew_join(threads, at, keys + ["line"], "left")


def thread_participants(messages: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, thread_id, author, first_pos): everyone in a thread, by first appearance."""
    return messages.groupBy(*keys, "thread_id", "author").agg(F.min("pos").alias("first_pos"))


def thread_summary(messages: DataFrame, pending: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, thread_id, messages, participants): pending reply drafts count as messages."""
    keys = list(keys)
    per = messages.groupBy(*keys, "thread_id").agg(F.count("*").alias("_m"))
    people = thread_participants(messages, keys).groupBy(*keys, "thread_id").agg(F.count("*").alias("participants"))
    mine = pending.filter(F.col("reply_to").isNotNull()).groupBy(*keys, F.col("reply_to").alias("thread_id")).agg(F.count("*").alias("_d"))
    d = per.join(people, keys + ["thread_id"]).join(mine, keys + ["thread_id"], "left")
    return d.select(*keys, "thread_id", (F.col("_m") + F.coalesce("_d", F.lit(0))).alias("messages"), "participants")


def threads_per_entry(assigned: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    return assigned.filter(F.col("entry_id").isNotNull()).groupBy(*keys, "entry_id").agg(F.count("*").alias("threads"))


def collect_threads(drafts: DataFrame, threads: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Everything an export lists, with ``pos``: own notes (unsent first, then by time), then known threads.

    ``drafts`` has (keys, id, path, line, side, body, author, created, reply_to,
    reply_to_author, exported_at), ``threads`` (keys, ord, id, anchor, author, body).
    """
    keys = list(keys)
    spot = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"))
    reply = F.concat(F.lit("reply to "), F.coalesce("reply_to_author", F.lit("thread")), F.lit(" · "), base_name(F.col("path")),
                     F.lit(":"), F.col("line").cast("string"))
    sent = F.col("exported_at").isNotNull()
    mine = drafts.select(
        *keys, F.col("id").cast("string").alias("id"), "path", F.col("line").cast("long").alias("line"), "side", "body", "author",
        F.when(F.col("reply_to").isNotNull(), reply).otherwise(F.concat(spot, F.when(F.col("side") == "LEFT", " (removed)").otherwise(""))).alias("anchor"),
        F.col("reply_to").cast("string").alias("reply_to"), F.lit(True).alias("mine"), sent.alias("sent"),
        F.unix_micros(F.try_to_timestamp(F.col("created").cast("string"))).alias("_at"))
    theirs = threads.select(
        *keys, F.coalesce(F.col("id").cast("string"), "anchor", F.lit("")).alias("id"), anchor_path(F.coalesce("anchor", F.lit(""))).alias("path"),
        F.when(anchor_line(F.col("anchor")) > 0, anchor_line(F.col("anchor"))).alias("line"), F.lit("RIGHT").alias("side"), "body", "author",
        F.coalesce("anchor", F.lit("")).alias("anchor"), F.lit(None).cast("string").alias("reply_to"), F.lit(False).alias("mine"),
        F.lit(True).alias("sent"), F.col("ord").cast("long").alias("_at"))
    d = mine.unionByName(theirs).withColumn("_sec", F.when(~F.col("mine"), 2).when(F.col("sent"), 1).otherwise(0))
    # a second of own notes or one thread is a block; a missing time sorts first within its section
    at = F.floor(F.col("_at") / F.when(F.col("mine"), F.lit(1_000_000)).otherwise(F.lit(1)))
    block = F.col("_sec") * F.lit(1 << 50) + F.coalesce(at, F.lit(-(1 << 49)))
    return number_rows(d, keys, ["_sec", "_at", "id"], block, "pos", split_hot_only=True).drop("_sec", "_at")


def export_markdown(items: DataFrame, replies: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, pos, part, reply_pos, line): the markdown as rows; sort by these columns to print it.

    Part 0 is the anchor line, 1 the body, 2 a reply, 3 the blank line after an item.
    """
    keys = list(keys)
    head = F.concat(F.lit("**"), F.when(F.col("anchor") == "", "(no anchor)").otherwise(F.col("anchor")), F.lit(" — "), F.col("author"), F.lit("**"))
    cells = F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(1).alias("part"), F.col("body").alias("line")),
                    F.struct(F.lit(3).alias("part"), F.lit("").alias("line")))
    own = items.select(*keys, "pos", F.explode(cells).alias("c")).select(*keys, "pos", "c.part", F.lit(0).cast("long").alias("reply_pos"), "c.line")
    said = replies.select(*keys, F.col("thread_id").cast("string").alias("id"), F.col("pos").cast("long").alias("reply_pos"),
                          F.concat(F.lit("> "), "author", F.lit(": "), "body").alias("line"))
    back = skew_join(said, items.select(*keys, "id", "pos"), keys + ["id"])
    return own.unionByName(back.select(*keys, "pos", F.lit(2).alias("part"), "reply_pos", "line"))


def exported_ids(bodies: DataFrame, keys: Sequence[str] = PR, body: str = "body", stamp: str = STAMP) -> DataFrame:
    """(keys, id): distinct ids stamped in earlier review bodies (the dashes closing the comment are no id)."""
    listed = F.regexp_extract(F.coalesce(body, F.lit("")), f"{stamp}:([^\\n>]*)", 1)
    listed = F.regexp_replace(listed, r"\s*--\s*$", "")
    ids = bodies.select(*keys, F.explode(F.split(listed, ",")).alias("id"))
    return ids.select(*keys, F.trim("id").alias("id")).filter(F.col("id") != "").distinct()


def unsent_items(items: DataFrame, exported: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Items not exported before, with ``is_reply``: replies go to their thread, the rest into a review."""
    d = items.withColumn("id", F.col("id").cast("string")).join(exported, list(keys) + ["id"], "left_anti")
    return d.withColumn("is_reply", F.col("reply_to").isNotNull())


def review_payload(unsent: DataFrame, keys: Sequence[str] = PR, stamp: str = STAMP, part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, part, body, comments): what to post, at most ``part_rows`` comments per row.

    A group without a fresh comment posts no review. A group larger than one
    part posts several, so none is ever cut short; the ids of its replies are
    dealt over the stamps of these parts in turn.
    """
    keys = list(keys)
    d = unsent.withColumn("_rep", F.col("is_reply").cast("int"))
    d = number_rows(d, keys + ["_rep"], ["pos"], by_width("pos"), "_n")
    fresh_parts = unsent.filter(~F.col("is_reply")).groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(part_rows)).alias("_parts"))
    d = skew_join(d, fresh_parts, keys)
    d = d.withColumn("part", F.when(F.col("is_reply"), F.pmod(F.col("_n") - 1, F.col("_parts"))).otherwise(F.floor((F.col("_n") - 1) / F.lit(part_rows))))
    fresh = F.struct(F.col("_n").alias("n"), "path", F.when(F.col("side") == "LEFT", "LEFT").otherwise("RIGHT").alias("side"), "line", "body")
    per = d.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_reply"), fresh))).alias("comments"),
        F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_ids"), F.count_if(~F.col("is_reply")).alias("n"))
    ids = F.array_join(F.transform("_ids", lambda x: x["id"]), ",")
    note = F.concat(F.lit("Review notes — "), F.col("n").cast("string"), F.lit(" comment"), F.when(F.col("n") == 1, "").otherwise("s"),
                    F.lit(f"\n<!-- {stamp}: "), ids, F.lit(" -->"))
    comments = F.transform("comments", lambda x: F.struct(x["path"].alias("path"), x["side"].alias("side"), x["line"].alias("line"), x["body"].alias("body")))
    return per.select(*keys, "part", "n", note.alias("body"), comments.alias("comments"))


def posted_counts(unsent: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    return unsent.groupBy(*keys).agg(F.count_if("is_reply").alias("replies"), F.count_if(~F.col("is_reply")).alias("fresh"))


def mark_exported(drafts: DataFrame, picked: DataFrame, now: Column, keys: Sequence[str] = PR) -> DataFrame:
    """Drafts with ``exported_at`` set for picked ids that had none."""
    p = picked.select(*keys, "id").distinct().withColumn("_p", F.lit(True))
    d = drafts.join(p, list(keys) + ["id"], "left")
    stamp = F.when(F.col("_p") & F.col("exported_at").isNull(), now).otherwise(F.col("exported_at"))
    return d.withColumn("exported_at", stamp).drop("_p")
