"""Site-relative line dedup (operator 7).

For each host, the pages that contain a line are divided by the pages of the
host; lines above a boilerplate ratio are dropped from every page of that host.
A page counts once by content: an exact copy of a page is the same page, so a
group of copies does not turn its own article into boilerplate.

``op7_line_dedup`` and its SQL use RATIO and MIN_PAGES; the pipeline uses
REPEATED, which was chosen from measured line frequencies (README).

Defined results: null text stays null; empty and blank lines are never counted
or dropped; a null host is a host of its own whose lines are all kept; repeated
rows are repeated in the output; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.llm.quality import let
from patchlore.llm.registry import beside, query, table
from patchlore.session import cut

RATIO = 0.1           # a line on more than this share of the host's pages is boilerplate
MIN_PAGES = 5         # and on at least so many pages
ROWS_PER_TASK = 50_000
BLANKS = " \t\r"
SHORT_WORDS, SHORT_CHARS = 3, 30   # a line of at most so many words and fewer characters is short


@dataclass(frozen=True)
class Rule:
    """Boilerplate is on more than ``ratio`` of the host's pages and on at least ``pages`` of them; short lines, which texts share by chance, by numbers of their own."""
    ratio: float
    pages: int
    short_ratio: float | None = None   # None: short lines as all others
    short_pages: int | None = None

    @property
    def tells_short(self) -> bool:
        return self.short_ratio is not None or self.short_pages is not None

    def least_pages(self) -> Column:
        return F.lit(self.pages) if self.short_pages is None else F.when(F.col("_short"), self.short_pages).otherwise(self.pages)

    def least_share(self) -> Column:
        return F.lit(self.ratio) if self.short_ratio is None else F.when(F.col("_short"), self.short_ratio).otherwise(self.ratio)


# Three pages, so that small hosts lose clear repeats too; two pages that share a line may as well be two versions of one page.
REPEATED = Rule(0.01, 3, 0.02, 5)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hash(line: Column) -> Column:
    """Hash of a trimmed line, null for a blank one."""
    return F.when(F.length(trimmed(line)) > 0, F.xxhash64(trimmed(line)))


def short_line(line: Column) -> Column:
    own = trimmed(line)
    return (F.length(own) < SHORT_CHARS) & (F.substring_index(own, " ", SHORT_WORDS) == own)


def page_lines(docs: DataFrame, host: str, text: str, tells_short: bool = False) -> DataFrame:
    """One row per non-blank line: host, page content key, line hash, is it short."""
    split = docs.filter(F.col(host).isNotNull()).select(F.col(host).alias("_host"), F.xxhash64(text).alias("_page"), F.explode(F.split(F.col(text), "\n", -1)).alias("_line"))
    short = short_line(F.col("_line")) if tells_short else F.lit(False)
    return split.select("_host", "_page", line_hash(F.col("_line")).alias("_h"), short.alias("_short")).filter(F.col("_h").isNotNull())


def line_frequencies(docs: DataFrame, host: str, text: str, rule: Rule) -> DataFrame:
    """(_host, _h, _short, pages, host_pages) of the lines on at least the rule's number of pages of their host."""
    per_page = page_lines(docs, host, text, rule.tells_short).distinct()
    counts = cut(per_page.groupBy("_host", "_h", "_short").agg(F.count("*").alias("pages")).filter(F.col("pages") >= rule.least_pages()), "line-counts")
    totals = docs.filter(F.col(host).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(host).alias("_host")).agg(F.countDistinct(F.xxhash64(text)).alias("host_pages"))
    fan = fan_of(counts, "_host")
    return counts.withColumn("_salt", F.pmod(F.col("_h"), F.lit(fan))).join(copies(totals, fan), ["_host", "_salt"]).drop("_salt")


def fan_of(df: DataFrame, key: str) -> int:
    """Pieces a key's rows are split into, from the row count of the heaviest key."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return 1 + int(most) // ROWS_PER_TASK


def copies(df: DataFrame, fan: int) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))))


def boilerplate(docs: DataFrame, rule: Rule, host: str = "source", text: str = "text") -> DataFrame:
    """(_host, _bad): the line hashes above the ratio. A host has at most lines per page / ratio of them, however many pages it has."""
    over = line_frequencies(docs, host, text, rule).filter(F.col("pages") > rule.least_share() * F.col("host_pages"))
    return over.groupBy("_host").agg(F.collect_set("_h").alias("_bad"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, rule: Rule | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``docs`` with cleaned text and a column ``lines_dropped``; by ``rule``, or else by one ratio and number of pages for all lines.

    Lines are counted on the pages ``counted``, by default all of ``docs``; with
    one page of each group of near copies there, copies do not turn what they
    share into boilerplate.

    The written table of hosts is joined to the pages: Spark broadcasts it while
    its files are small and otherwise shuffles by host, hot hosts in pieces.
    """
    bad = cut(boilerplate(docs if counted is None else counted, rule or Rule(ratio, min_pages), host, text), "boilerplate")
    fan = fan_of(docs.filter(F.col(host).isNotNull()), host)
    salted = beside(docs, _host=F.col(host), _salt=F.pmod(F.xxhash64(text, host), F.lit(fan)), _lines=F.split(F.col(text), "\n", -1))
    joined = salted.join(copies(bad, fan), ["_host", "_salt"], "left")

    def clean(at: Column) -> Column:
        hashes = F.transform(at, line_hash)
        return let(F.array_intersect(hashes, F.col("_bad")), lambda hit: F.when(F.size(hit) > 0, F.filter(at, lambda x: ~F.coalesce(F.array_contains(hit, line_hash(x)), F.lit(False)))))

    found = joined.withColumn("_rest", F.when(F.col("_bad").isNotNull() & F.col("_lines").isNotNull(), let(F.col("_lines"), clean)))
    new = F.when(F.col("_rest").isNull(), F.col("row").getField(text)).otherwise(F.array_join("_rest", "\n"))
    dropped = F.when(F.col("_rest").isNull(), 0).otherwise(F.size("_lines") - F.size("_rest")).cast("long")
    out = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != "lines_dropped"]
    return found.select(*out, dropped.alias("lines_dropped"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, text, i, string_split(text, chr(10))[i] AS line
      FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL) t),
n AS (SELECT rid, source, text, i, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
f AS (SELECT source, k, count(DISTINCT text) AS pages FROM n WHERE k <> '' AND source IS NOT NULL GROUP BY source, k),
t AS (SELECT source, count(DISTINCT text) AS host_pages FROM d WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT f.source, f.k FROM f JOIN t ON f.source = t.source WHERE pages >= {MIN_PAGES} AND pages > CAST({RATIO} AS DOUBLE) * host_pages),
o AS (SELECT n.rid, string_agg(line, chr(10) ORDER BY i) FILTER (b.k IS NULL) AS text, count(b.k) AS lines_dropped
      FROM n LEFT JOIN b ON n.source = b.source AND n.k = b.k GROUP BY n.rid)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(o.lines_dropped, 0) AS lines_dropped
FROM d LEFT JOIN o ON d.rid = o.rid
"""


@query("op7_line_dedup", SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_dropped")
