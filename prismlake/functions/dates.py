"""Periods as half-open ranges of time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(preset: str, now: datetime, year: int | None = None, since: datetime | None = None, until: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """[start, end) of `this month`, `this year`, `year` (needs one) or `range` (either end may be open)."""
    if preset == "this month":
        start = datetime(now.year, now.month, 1)
        return start, datetime(now.year + now.month // 12, now.month % 12 + 1, 1)
    if preset in ("this year", "year"):
        first = now.year if preset == "this year" else year
        if first is None:
            raise ValueError("a year is needed")
        return datetime(first, 1, 1), datetime(first + 1, 1, 1)
    if preset == "range":
        return since, until
    raise ValueError(f"no such period: {preset}")


def month_of(c: Column) -> Column:
    """The month a time falls in, as its first day."""
    return F.trunc(c.cast("date"), "month")


def span_label(first: Column, last: Column) -> Column:
    """`Jan 2024` for one month, `2024` for one year, else `2023–2024`; null if either is."""
    year = lambda c: F.year(c).cast("string")
    one = F.when(F.date_format(first, "yyyy-MM") == F.date_format(last, "yyyy-MM"), F.date_format(first, "LLL yyyy"))
    return F.when(first.isNotNull() & last.isNotNull(), F.coalesce(one, F.when(F.year(first) == F.year(last), year(first)), F.concat_ws("–", year(first), year(last))))
