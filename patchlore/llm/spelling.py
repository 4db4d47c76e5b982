"""Grouping of spelling variants: frequent words one edit apart (operator 13).

Words are counted over all texts; frequent ones are joined where they differ by
one inserted, deleted or replaced code point. Signatures are asymmetric. A word
of length L contributes two disjoint chunks of q = L // 2 code points, at 0 and
at q; its partner, as long or one longer, contributes its positional grams of
length q. One edit touches at most one of two disjoint chunks, so the other is a
gram of the partner, moved by at most one place: both join on (L, chunk number,
string), only grams within one place of the chunk being sent, and every pair
found is verified by its edit distance. Long chunks keep the groups of the join
small; a group is never listed against itself in one task, since the join
streams it and splits large ones.

Each word points to its ``form``, the near word of largest count if that is at
least ``RATIO`` times its own; counts grow along a path of forms, so it has an
end, the ``root``, which is found by pointer doubling.

Seeded slips: a word whose crc32 with its document's id is divisible by
``SLIP`` loses one code point, as the contract of the query asks; ``slip=None``
counts words as they are.

Defined results: null and empty texts have no words; a null id is read as the
empty text in the hash; repeated rows count again; ties of counts go to the
smaller word in code-point order; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.llm.registry import query, ship, table
from patchlore.session import cut

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
SLIP = 199
ENTRIES = 300_000       # distinct words a task holds before it hands them on
SLICE = 100_000         # words of a very long text counted at a time
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def runs(text: str) -> Iterator[Counter]:
    """Lower-cased words of a text and their counts, in slices; only A-Z change case."""
    low = text.encode().lower().decode()
    found = (m.group() for m in RUN.finditer(low)) if len(low) > 8 * SLICE else iter(RUN.findall(low))
    while part := list(islice(found, SLICE)):
        yield Counter(part)


def slipped(word: str, seed: int, slip: int) -> str:
    """The word, or the word without one code point if its hash says so; ``seed`` is the crc32 of the id and a colon."""
    h = zlib.crc32(word.encode(), seed)
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slip: int | None = SLIP,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for id_, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                seed = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for part in runs(body):
                    for word, n in part.items():
                        if slip is not None:
                            word = slipped(word, seed, slip)
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) > ENTRIES:
                    yield hand_on()
        yield hand_on()

    ship(docs.sparkSession)
    read = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def chunks(words: DataFrame) -> DataFrame:
    """(of, part, piece, word): two disjoint chunks of every word, ``of`` being its length."""
    q = F.expr("length(word) div 2")
    both = F.array(F.struct(F.lit(0).alias("part"), F.substring("word", F.lit(1), q).alias("piece")),
                   F.struct(F.lit(1).alias("part"), F.substring("word", q + 1, q).alias("piece")))
    return words.select(F.length("word").alias("of"), F.explode(both).alias("c"), F.col("word")).select("of", "c.part", "c.piece", "word")


def grams(words: DataFrame, min_length: int) -> DataFrame:
    """(of, part, piece, word): positional grams that a chunk of a word as long, or one shorter, can meet within one place."""
    def at(of: Column) -> Column:
        q = F.floor(of / 2).cast("int")
        starts = F.array(*[F.struct(F.lit(part).alias("part"), (start + shift).alias("start"))
                           for part, start in ((0, F.lit(0)), (1, q)) for shift in (-1, 0, 1)])
        fit = F.filter(starts, lambda s: (s["start"] >= 0) & (s["start"] + q <= F.length("word")))
        return F.transform(fit, lambda s: F.struct(of.cast("int").alias("of"), s["part"].alias("part"), F.substring(F.col("word"), s["start"] + 1, q).alias("piece")))

    size = F.length("word")
    sent = F.when(size > min_length, F.concat(at(size), at(size - 1))).otherwise(at(size))
    return words.select(F.explode(F.array_distinct(sent)).alias("g"), "word").select("g.of", "g.part", "g.piece", F.col("word").alias("other"))


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, other) of every two words one edit apart, each pair once; ``words`` holds distinct words of at least ``min_length``."""
    met = chunks(words).join(grams(words, min_length), ["of", "part", "piece"])
    # of two words of one length the smaller contributes the chunks
    once = met.filter((F.length("other") > F.col("of")) | (F.col("word") < F.col("other")))
    return once.filter(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): the end of each path, reached by doubling the steps."""
    at = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return at


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slip: int | None = SLIP,
             min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every frequent word."""
    if min_length < 2:
        raise ValueError("a word needs two chunks")
    words = cut(word_counts(docs, text, doc_id, slip, min_length, min_count), "words")
    pairs = cut(near_pairs(words.select("word"), min_length), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    near = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    follows = form_n >= ratio * F.col("n")
    found = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            F.when(follows, F.col("best.form")).alias("form"), F.when(follows, form_n).alias("form_n")), "variants")
    roots = follow(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
