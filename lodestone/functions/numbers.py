"""Exact numbers: conversion of text to decimals, null-propagating sums, canonical printing (F1-F6), coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"\A-?[0-9]+(\.[0-9]+)?\z"
GROUPED = r"\A-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?\z"
EARTH_RADIUS_M = 6371008.8
#: Java's \s with Unicode, so U+3000 is white space too.
OUTER_BLANKS = r"(?U)\A\s+|\s+\z"


def trimmed(value: Column) -> Column:
    """Text without outer white space of any script."""
    return F.regexp_replace(value, OUTER_BLANKS, "")


def to_decimal(value: Column, grouped: bool = False, scale: int = 6, trim: bool = False, null_tokens: Sequence[str] = (), strict: bool = True) -> Column:
    """Text to an exact decimal (F1, F2, F3): null tokens give null; other malformed text fails the query, or null if not strict."""
    text = trimmed(value) if trim else value
    if null_tokens:
        text = F.when(text.isin(*null_tokens), None).otherwise(text)
    # digits that the scale has no place for are refused, not rounded
    well = text.rlike(GROUPED if grouped else PLAIN) & (F.octet_length(text) <= 256) & ~text.rlike(rf"\.[0-9]{{{scale}}}0*[1-9]")
    number = F.replace(text, F.lit(","), F.lit("")).cast(f"decimal(38,{scale})")
    bad = F.raise_error(F.concat(F.lit("not a decimal: "), text)).cast(f"decimal(38,{scale})") if strict else F.lit(None).cast(f"decimal(38,{scale})")
    return F.when(text.isNull(), None).when(well, number).otherwise(bad)


def sum_fields(columns: Sequence[Column]) -> Column:
    """The sum of 2 to 32 columns, null if any is null, never a partial total."""
    if not 2 <= len(columns) <= 32:
        raise ValueError("sum_fields takes 2 to 32 columns")
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def canonical(number: Column) -> Column:
    """A decimal's shortest text: no trailing zeros, no negative zero."""
    text = number.cast("string")
    short = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+\z", "")).otherwise(text)
    return F.when(number == 0, "0").otherwise(short)


def coordinate(value: Column, limit: float) -> Column:
    """Decimal degrees within the limit; anything else fails the query."""
    well = value.rlike(r"\A-?[0-9]{1,3}(\.[0-9]+)?\z")
    number = F.when(well, value.cast("double"))
    return F.when(number.between(-limit, limit), number).otherwise(F.raise_error(F.concat(F.lit("bad coordinate: "), F.coalesce(value, F.lit("null")))).cast("double"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))
