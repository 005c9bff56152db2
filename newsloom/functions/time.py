"""Time columns. Timestamps are UTC; days of readers are JST (UTC+9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JST = "+09:00"


def effective(published: Column, fetched: Column) -> Column:
    """When an article counts as out: published, else fetched."""
    return F.coalesce(published, fetched)


def jst_day(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, JST))


def jst_text(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, JST), "yyyy-MM-dd HH:mm")


def jst_midnight(day: Column) -> Column:
    """The instant at which a day begins for readers."""
    return F.to_utc_timestamp(day.cast("timestamp"), JST)


def period(text: Column) -> tuple[Column, Column]:
    """[from, until) in UTC of a year, month or day that a reader typed."""
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    first = F.try_to_date(full, "yyyy-MM-dd")
    after = F.when(F.length(text) == 4, F.add_months(first, 12)).when(F.length(text) == 7, F.add_months(first, 1)).otherwise(F.date_add(first, 1))
    return jst_midnight(first), jst_midnight(after)


def backoff_hours(attempts: Column, most: int = 168) -> Column:
    """Hours until the next try: 1, 2, 4 ... up to a week."""
    return F.least(F.call_function("shiftleft", F.lit(1), F.greatest(F.least(attempts - 1, F.lit(16)), F.lit(0))), F.lit(most))
