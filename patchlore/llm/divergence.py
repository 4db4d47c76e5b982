"""How far the sources of a language diverge in their words (operator 12).

Terms are counted per (language, source) group. A group prices its vocabulary
against every other group of its language (part ``pair``) and against the whole
language (part ``term``) by f = floor((p - q)^2 / q), where p and q are exact
integer probabilities in billionths with one added to every count.

p depends only on a group and a count, its level, so the sum of f over all
terms of two groups needs only their joint table: how many terms have level a in
one and level b in the other. With one indicator column per (group, level) over
the terms, M, all joint tables of a language are M' M. Terms are dealt into
blocks and groups into blocks of columns; a task multiplies one block of terms
for one pair of group blocks, splitting the terms once more so that no product
has more than ``COLUMNS`` columns a side, prices the joint tables and adds them up.
A product counts at most ``TERMS_PER_BLOCK`` terms, so 32-bit floats hold it
exactly; prices are 64-bit integers: the sum of p over the terms is at most
10^9 + V, so sums of f stay below (10^9 + V)^2 + 10^9 + V < 2^63 for V < 2 * 10^9.

Defined results: null text, lang and source read as ''; an empty text counts
for its group and has no terms; a language without a kept term prices every
pair 0 and has no ``term`` rows; repeated rows count as documents of their own;
equal values rank by the UTF-8 order of the item; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patchlore.llm.registry import query, ship, table
from patchlore.session import cut

MIN_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
TERMS_PER_BLOCK = 8192
GROUPS_PER_BLOCK = 256
COLUMNS = 2048           # indicator columns on a side of one product
ENTRIES = 300_000        # counted terms a task holds before it hands them on
SLICE = 100_000          # words of a very long text counted at a time
TERM = re.compile(rb"[a-z\x80-\xff]+")  # in lower-cased UTF-8: ASCII letters and everything beyond ASCII


def words(text: bytes) -> Iterator[list[bytes]]:
    found = (m.group() for m in TERM.finditer(text.lower())) if len(text) > 8 * SLICE else iter(TERM.findall(text.lower()))
    while part := list(islice(found, SLICE)):
        yield part


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang_, source_), (n, in_docs) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * size, pa.string()), pa.array([source_] * size, pa.string()), terms,
                     pa.array(list(n.values()), pa.int64()), pa.array([in_docs[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            held.clear()

        entries = 0
        for b in batches:
            for lang_, source_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, in_docs = held.setdefault((lang_, source_), (Counter(), Counter()))
                entries -= len(n)
                once: set[bytes] = set()
                for part in words(data):
                    n.update(part)
                    once.update(part)
                in_docs.update(once)
                entries += len(n)
                if entries > ENTRIES:
                    yield from hand_on()
                    entries = 0
        yield from hand_on()

    ship(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """p of a count in billionths, at least 1; decimal arithmetic, so that no product overflows."""
    return F.expr(f"1 + (cast({SCALE} * cast({n} + 1 as decimal(20,0)) as decimal(38,0)) div cast({total} + {terms} as decimal(20,0)))")


def indicators(counts: np.ndarray, totals: list[int], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot columns of (terms x groups) counts: the 0/1 matrix, and the group and probability of each column."""
    flags, owner, price = [], [], []
    for g, total in enumerate(totals):
        levels, at = np.unique(counts[:, g], return_inverse=True)
        flags.append(np.equal(at[:, None], np.arange(len(levels))[None, :]))
        owner.append(np.full(len(levels), g))
        price += [1 + SCALE * (int(c) + 1) // (total + terms) for c in levels]
    return np.concatenate(flags, axis=1).astype(np.float32), np.concatenate(owner), np.array(price, dtype=np.int64)


def column_count(counts: np.ndarray) -> int:
    ordered = np.sort(counts, axis=0)
    return counts.shape[1] + int((ordered[1:] != ordered[:-1]).sum())


def joint_prices(left: np.ndarray, right: np.ndarray, left_totals: list[int], right_totals: list[int], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f over the given terms: of every left group against every right one, and the other way round."""
    there = np.zeros((len(left_totals), len(right_totals)), dtype=np.int64)
    back = there.T.copy()
    spans = [(0, len(left))] if left.size and right.size else []  # a block of groups may be empty
    while spans:
        lo, hi = spans.pop()
        if hi - lo > 1 and max(column_count(left[lo:hi]), column_count(right[lo:hi])) > COLUMNS:
            spans += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            continue
        a, a_of, p = indicators(left[lo:hi], left_totals, terms)
        b, b_of, q = indicators(right[lo:hi], right_totals, terms)
        joint = a.T @ b                                  # every joint table of these terms
        i, j = np.nonzero(joint)
        cells, gap = joint[i, j].astype(np.int64), (p[i] - q[j]) ** 2
        np.add.at(there, (a_of[i], b_of[j]), cells * (gap // q[j]))
        np.add.at(back, (b_of[j], a_of[i]), cells * (gap // p[i]))
    return there, back


def price_block(block: pa.Table) -> pa.Table:
    """Prices of one block of terms for one pair of group blocks; rows without a term list the groups."""
    lang = block.column("lang")[0].as_py()
    diagonal = block.column("left_block")[0].as_py() == block.column("right_block")[0].as_py()
    listed = block.filter(pc.is_null(block.column("term")))
    terms, here = listed.column("terms")[0].as_py(), listed.column("here")[0].as_py()
    rows = block.filter(pc.is_valid(block.column("term")))
    code = rows.column("term").combine_chunks().dictionary_encode()
    index, seen = code.indices.to_numpy(), len(code.dictionary)
    n = rows.column("n").to_numpy()
    order = np.empty(seen, dtype=np.int64)               # frequent terms, which have many levels, side by side
    order[np.argsort(np.bincount(index, weights=n, minlength=seen), kind="stable")] = np.arange(seen)
    sides = []
    for side in (0, 1) if not diagonal else (0,):
        mine = listed.filter(pc.equal(listed.column("side"), side))
        names = mine.column("source").to_pylist()
        at = {s: i for i, s in enumerate(names)}
        own = rows.column("side").to_numpy() == side
        column = np.array([at[s] for s in rows.column("source").filter(pa.array(own)).to_pylist()], dtype=np.int64)
        counts = np.zeros((seen, len(names)), dtype=np.int64)
        counts[order[index[own]], column] = n[own]
        sides.append((names, counts, mine.column("total").to_pylist()))
    (left, a, a_totals), (right, b, b_totals) = sides[0], sides[-1]
    there, back = joint_prices(a, b, a_totals, b_totals, terms)
    if here > seen:                                      # terms of the block that none of these groups has: level 0 against level 0
        rest = np.zeros((1, len(left)), np.int64), np.zeros((1, len(right)), np.int64)
        more, more_back = joint_prices(*rest, a_totals, b_totals, terms)
        there, back = there + more * (here - seen), back + more_back * (here - seen)
    made = [(g, h, there[i, j]) for i, g in enumerate(left) for j, h in enumerate(right) if not (diagonal and i == j)]
    if not diagonal:
        made += [(h, g, back[j, i]) for i, g in enumerate(left) for j, h in enumerate(right)]
    return pa.table({"lang": pa.array([lang] * len(made), pa.string()), "source": pa.array([m[0] for m in made], pa.string()),
                     "item": pa.array([m[1] for m in made], pa.string()), "value": pa.array([int(m[2]) for m in made], pa.int64())})


def pair_values(counts: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two groups of a language.

    ``counts`` (lang, source, term, n) holds kept terms, ``groups`` (lang, source,
    total, terms) every group and ``kept`` (lang, term) the vocabulary.
    """
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
    langs = cut(langs.select("lang", F.ceil(F.col("sources") / GROUPS_PER_BLOCK).cast("long").alias("sides"),
                             F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS_PER_BLOCK)).cast("long").alias("blocks")), "langs")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    own = F.pmod(F.xxhash64("source"), F.col("sides")).alias("own")
    here = kept.join(langs, "lang").groupBy("lang", block).agg(F.count("*").alias("here"))
    every = groups.join(langs, "lang").select("lang", "source", "total", "terms", "sides", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    every = every.join(here, ["lang", "block"], "left").withColumn("here", F.coalesce("here", F.lit(0).cast("long")))
    cells = counts.join(langs, "lang").select("lang", "source", "term", "n", "sides", own, block)
    both = cells.unionByName(every, allowMissingColumns=True)
    other = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    first = F.col("own") <= F.col("other")
    dealt = other.select("lang", "block", F.least("own", "other").alias("left_block"), F.greatest("own", "other").alias("right_block"),
                         F.when(first, 0).otherwise(1).alias("side"), "source", "term", "n", "total", "terms", "here")
    priced = dealt.groupBy("lang", "block", "left_block", "right_block").applyInArrow(price_block, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", ranks: int = TERM_RANKS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of groups, and the terms that set a group apart from its language."""
    counted = cut(term_counts(docs, text, lang, source), "term-counts")
    vocabulary = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    kept = cut(vocabulary.select("lang", "term", "lang_n"), "vocabulary")
    counts = cut(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = found.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = cut(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")

    pairs = pair_values(counts.select("lang", "source", "term", "n"), groups.drop("lang_total"), kept.select("lang", "term"))
    p, q = F.col("p"), F.col("q")
    priced = counts.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "terms")).withColumn("q", probability("lang_n", "lang_total", "terms"))
    terms = priced.filter(p > q).select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= ranks)
    all_pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    out = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for d, part in ((all_pairs, "pair"), (best, "term"))]
    return out[0].unionByName(out[1])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // (g.total + l.v) AS p,
        1 + {SCALE} * CAST(k.n + 1 AS HUGEINT) // (l.total + l.v) AS q
      FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""


@query("op12_source_divergence", SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
