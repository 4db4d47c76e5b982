"""Point-in-interval joins on an equi key plus a bin of the position.

The bin keeps the join an equi join (no nested loop) and spreads one large file
over as many tasks as it has bins. Bins are hierarchical: a span is put into bins
of its own size class, each four times as wide as the class before, so it covers
one bin or two, however long it is. A point asks once per class that occurs,
usually one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LINE_BIN = 64
CHAR_BIN = 4096
GROWTH_BITS = 2      # a class is 4 times as wide as the one before
MOST_CLASSES = 20    # and the widest holds any longer span, in several bins


def bin_width(size_class: Column, width: int) -> Column:
    return F.lit(width).cast("long") * F.pow(F.lit(float(1 << GROWTH_BITS)), size_class).cast("long")


def bin_spans(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Spans with ``_class`` and one row per ``_bin`` they cover; empty ones go. Any class gives right results, this one at most two rows."""
    length = (F.col(end) - F.col(start) + 1).cast("double")
    size_class = F.ceil(F.log2(length / width) / GROWTH_BITS).cast("int")
    ok = spans.filter(F.col(start) <= F.col(end)).withColumn("_class", F.least(F.greatest(size_class, F.lit(0)), F.lit(MOST_CLASSES)))
    wide = bin_width(F.col("_class"), width)
    return ok.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(end) / wide))))


def bin_points(points: DataFrame, binned: DataFrame, at: str, width: int) -> DataFrame:
    """Points with their ``_bin`` in every ``_class`` that the spans have (at most ``MOST_CLASSES`` + 1)."""
    classes = binned.agg(F.collect_set("_class").alias("c")).scalar()
    asked = points.withColumn("_class", F.explode(classes))
    return asked.withColumn("_bin", F.floor(F.col(at) / bin_width(F.col("_class"), width)))


def _meeting(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> tuple[DataFrame, DataFrame, list[Column]]:
    binned = bin_spans(spans, start, end, width)
    p, s = bin_points(points, binned, at, width).alias("p"), binned.alias("s")
    cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_class", "_bin"]]
    return p, s, [*cond, F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))]


def points_in_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int = LINE_BIN) -> DataFrame:
    """Join each point with every span of its key that contains it (ends inclusive)."""
    p, s, cond = _meeting(points, spans, keys, at, start, end, width)
    taken = set(points.columns)
    return p.join(s, cond).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in taken])


def spans_hit(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int = LINE_BIN) -> DataFrame:
    """Spans containing at least one point (semi join from the span side)."""
    p, s, cond = _meeting(points.select(*keys, at).distinct(), spans, keys, at, start, end, width)
    return s.join(p, cond, "left_semi").select(*spans.columns).distinct()
