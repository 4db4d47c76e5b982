"""Quality rules as one projection (operator 5).

A table of thresholds is compiled into Spark column expressions. Everything is
computed from the row's own text, so the plan is scan, projection, output: no
shuffle, no user function.

Defined results: a null text counts as the empty text; an empty text has no
words and fails the base rules; ties and repeated rows are judged one by one;
columns of the input other than id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.llm.registry import query, table

# Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3

# Frequent function words of the languages the rules know.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he this are or from at which but have an had they you were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son aux d'une".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws})


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``top / bottom`` lies in [low, high]; a text without ``bottom`` passes."""
    name: str
    top: str
    bottom: str
    low: float | None
    high: float | None


RULES = [
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 0.5),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column) -> Column:
    """Words covered by a window of three that the text holds at least twice.

    Window hashes (64 bit) are sorted with their positions; equal neighbours are
    repeats. That is n log n for any text, also one that repeats one word.
    """
    def covered(found: Column) -> Column:
        at = F.filter(F.transform(found, lambda e, i: F.when((e["h"] == F.get(found, i + 1)["h"]) | (e["h"] == F.get(found, i - 1)["h"]), e["at"])), lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(*[p + k for k in range(WINDOW)])))))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")))
        return F.when(F.size(w) >= WINDOW, let(F.sort_array(hashed), covered)).otherwise(0)

    return let(words, windows)


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.length(without(s, SPACES)) > 0)

    def of_words(w: Column) -> Column:
        stop = F.size(F.filter(w, lambda x: F.lower(x).isin(ALL_STOP_WORDS)))
        return F.struct(F.size(w).cast("long").alias("n_words"), stop.cast("long").alias("n_stop_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(s: Column) -> Column:
        return F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))

    return {
        "_w": let(words, of_words),
        "_l": let(lines, of_lines),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compile_rules(rules: list[Rule]) -> Column:
    """All thresholds as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.top).cast("double"), F.col(r.bottom).cast("double")
        if r.low is not None:
            ok = ok & (top >= F.lit(r.low) * bottom)
        if r.high is not None:
            ok = ok & (top <= F.lit(r.high) * bottom)
    return ok


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per row of ``docs``: id, the counts, ``base_failed``, ``kept`` and what each rule found."""
    rules = RULES if rules is None else rules
    got = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in measures(F.col(text_col)).items()])
    flat = got.select("doc_id", "_w.*", "_l.*", "word_chars", "n_symbols")
    return flat.select("*", base_failed().alias("base_failed"), (~base_failed() & compile_rules(rules)).alias("kept"))


_words = ", ".join("'" + w.replace("'", "''") + "'" for w in ALL_STOP_WORDS)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) t),
r AS (SELECT rid, i FROM p QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) o GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_words}))) AS n_stop
      FROM w LEFT JOIN c ON w.rid = c.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= CAST(0.3 AS DOUBLE) * n_words
       AND n_stop >= CAST(0.05 AS DOUBLE) * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM b
"""


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
