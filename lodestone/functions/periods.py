"""Calendar periods as two date columns, both null when unknown."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {
    "date": (r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd", "day"),
    "month": (r"\A[0-9]{4}-[0-9]{2}\z", "yyyy-MM", "month"),
    "year": (r"\A[0-9]{4}\z", "yyyy", "year"),
    "compact_date": (r"\A[0-9]{8}\z", "yyyyMMdd", "day"),
    "compact_month": (r"\A[0-9]{6}\z", "yyyyMM", "month"),
}


def parse_period(value: Column, kind: str) -> tuple[Column, Column]:
    """First and last day of a text; null and "" are unknown, malformed text fails the query."""
    shape, pattern, unit = FORMATS[kind]
    known = value.isNotNull() & (value != "")
    first = F.to_date(F.try_to_timestamp(value, F.lit(pattern)))
    well = value.rlike(shape) & first.isNotNull() & (F.date_format(first, pattern) == value)
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), value)).cast("date")
    first = F.when(~known, None).when(well, first).otherwise(bad)
    last = {"day": first, "month": F.last_day(first), "year": F.make_date(F.year(first), F.lit(12), F.lit(31))}[unit]
    return first, last


def intersect(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> tuple[Column, Column]:
    """The common period; unknown absorbs (Spark's greatest and least would skip nulls). Empty where first > last."""
    known = first_a.isNotNull() & last_a.isNotNull() & first_b.isNotNull() & last_b.isNotNull()
    return F.when(known, F.greatest(first_a, first_b)), F.when(known, F.least(last_a, last_b))


def overlaps(first: Column, last: Column) -> Column:
    """True where a period is known and not empty."""
    return F.coalesce(first <= last, F.lit(False))


def window(first: str, last: str) -> tuple[datetime.date, datetime.date]:
    """An ordered inclusive pair of dates."""
    a, b = datetime.date.fromisoformat(first), datetime.date.fromisoformat(last)
    if a > b:
        raise ValueError("the window ends before it begins")
    return a, b
