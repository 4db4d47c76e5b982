"""Time expressions: staleness and range labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_stale_writer(writer_at: Column, created: Column) -> Column:
    """Writer (epoch seconds) later than the comment (ISO text or timestamp); else false."""
    made = F.try_to_timestamp(created.cast("string")).cast("double")
    return F.coalesce(writer_at.cast("double") > made, F.lit(False))


def _day(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def when_label(ts: Column) -> Column:
    return F.concat(_day(ts), F.lit(" · "), _clock(ts))


def when_range(start: Column, end: Column) -> Column:
    """One stamp within a minute, ``a–b`` within a day, else ``A → B``."""
    same_day = F.to_date(start) == F.to_date(end)
    same_minute = F.date_trunc("minute", start) == F.date_trunc("minute", end)
    across = F.concat(_day(start), F.lit(" "), _clock(start), F.lit(" → "), _day(end), F.lit(" "), _clock(end))
    return (F.when(same_minute, when_label(start))
            .when(same_day, F.concat(when_label(start), F.lit("–"), _clock(end)))
            .otherwise(across))
