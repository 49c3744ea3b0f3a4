"""The accounting of a comparison of two sources, and whether a disclosure covers it.

Every row of both sources and every check of every matched pair is counted under exactly one metric, so what a report leaves out shows.
Keys that are missing, malformed or repeated are unresolved; a check that can't be made (an operand that is no number) is invalid, one with
a null operand missing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_decimal, trimmed

METRICS = ("left_rows", "right_rows", "matched_pairs", "left_only", "right_only", "left_unresolved", "right_unresolved", "checks", "comparisons", "equal", "different", "missing", "invalid")
STATUSES = ("equal", "different", "missing", "invalid")
MOST_KEY = 2048


@dataclass(frozen=True)
class Key:
    """A part of a key: its text as it is, trimmed, or the digits in parentheses at its end (so many)."""

    column: str
    rule: str = "exact"  # exact, trim, digits
    digits: int = 0

    def parts(self) -> tuple[Column, Column]:
        """(value, issue): issue is missing_key or invalid_key, or null."""
        text = F.col(f"`{self.column}`").cast("string")
        blank = text.isNull() | (trimmed(text) == "")
        long = F.octet_length(text) > MOST_KEY
        if self.rule == "digits":
            value = F.nullif(F.regexp_extract(text, rf"\(([0-9]{{{self.digits}}})\)\z", 1), F.lit(""))
            bad = value.isNull() | long
        elif self.rule in ("exact", "trim"):
            value, bad = trimmed(text) if self.rule == "trim" else text, long
        else:
            raise ValueError(f"no rule {self.rule}")
        return value, F.when(blank & ~F.coalesce(long, F.lit(False)), "missing_key").when(bad, "invalid_key")


@dataclass(frozen=True)
class Check:
    """One number of each side: text operands are parsed exactly (grouped digits if said), others are decimals already."""

    name: str
    left: str
    right: str
    grouped: bool = False
    scale: int = 6


def _operand(df: DataFrame, name: str, check: Check) -> Column:
    """(value, invalid) of an operand."""
    value = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() != "string":
        number = value.cast(f"decimal(38,{check.scale})")
        if df.schema[name].dataType.typeName() in ("float", "double"):
            raise ValueError(f"{name} isn't exact: convert it first")
        return F.struct(number.alias("value"), F.lit(False).alias("invalid"))
    number = to_decimal(value, check.grouped, check.scale, strict=False)
    return F.struct(number.alias("value"), (value.isNotNull() & number.isNull()).alias("invalid"))


def _side(df: DataFrame, keys: Sequence[Key], checks: Sequence[Check], side: str) -> DataFrame:
    """(key, issue, operands) of a source's rows."""
    parts = [k.parts() for k in keys]
    issue = F.coalesce(*(i for _, i in parts))
    names = [getattr(c, side) for c in checks]
    return df.select(F.when(issue.isNull(), F.array(*(v for v, _ in parts))).alias("key"), issue.alias("issue"), F.array(*(_operand(df, n, c) for n, c in zip(names, checks))).alias(side))


def compare(left: DataFrame, right: DataFrame, left_keys: Sequence[Key], right_keys: Sequence[Key], checks: Sequence[Check]) -> DataFrame:
    """(kind, key, check, left_value, right_value, left_members, right_members): one row for each unresolved key, each key of one side,
    each matched key, and each check of a matched key. Keys with an issue come as one row by side and issue, with their number.

    Each side is aggregated by key before the join, so a key that repeats, however often, is one row of it and never pairs."""
    if not checks or len({c.name for c in checks}) != len(checks) or not 1 <= len(left_keys) == len(right_keys) <= 8:
        raise ValueError("checks need names of their own; both sides need the same 1 to 8 key parts")
    sides = {"left": _side(left, left_keys, checks, "left"), "right": _side(right, right_keys, checks, "right")}
    one = {n: s.where("issue is null").groupBy("key").agg(F.count("*").alias(f"{n}_members"), F.any_value(n).alias(n)) for n, s in sides.items()}
    both = one["left"].join(one["right"], "key", "full_outer").na.fill(0, ["left_members", "right_members"])
    l, r = F.col("left_members"), F.col("right_members")
    kind = F.when((l > 1) | (r > 1), "ambiguous_key").when(r == 0, "left_only").when(l == 0, "right_only").otherwise("matched")
    number = "decimal(38,18)"
    each = F.transform(F.sequence(F.lit(0), F.lit(len(checks) - 1)), lambda i: F.struct(F.get(F.array(*(F.lit(c.name) for c in checks)), i).alias("check"), F.get("left", i).alias("a"), F.get("right", i).alias("b")))
    status = F.when(F.col("c.a.invalid") | F.col("c.b.invalid"), "invalid").when(F.col("c.a.value").isNull() | F.col("c.b.value").isNull(), "missing").when(F.col("c.a.value") == F.col("c.b.value"), "equal").otherwise("different")
    none = F.lit(None)
    keyed = both.withColumn("kind", kind)
    # a key's own row carries no check; the rows of its checks carry no members, so that no row is counted twice
    keys = keyed.select("kind", "key", none.cast("string").alias("check"), none.cast(number).alias("left_value"), none.cast(number).alias("right_value"), "left_members", "right_members")
    found = keyed.where("kind = 'matched'").select("key", F.explode(each).alias("c"))
    zero = F.lit(0).cast("long")
    found = found.select(status.alias("kind"), "key", "c.check", F.col("c.a.value").cast(number).alias("left_value"), F.col("c.b.value").cast(number).alias("right_value"), zero.alias("left_members"), zero.alias("right_members"))
    out = keys.unionByName(found)
    for n, s in sides.items():
        members = {f"{n}_members": F.count("*").alias(f"{n}_members"), f"{'right' if n == 'left' else 'left'}_members": F.lit(0).cast("long").alias(f"{'right' if n == 'left' else 'left'}_members")}
        bad = s.where("issue is not null").groupBy("issue").agg(*members.values())
        out = out.unionByName(bad.select(F.concat(F.lit(f"{n}_"), "issue").alias("kind"), none.cast("array<string>").alias("key"), none.cast("string").alias("check"), none.cast(number).alias("left_value"), none.cast(number).alias("right_value"), "left_members", "right_members"))
    return out


def by_check(report: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, equal, different, missing, invalid); a check of no pair has a row of zeros."""
    names = report.sparkSession.createDataFrame([(c.name,) for c in checks], "check string")
    counts = report.where("check is not null").groupBy("check").agg(*(F.count_if(F.col("kind") == s).alias(s) for s in STATUSES))
    return names.join(counts, "check", "left").na.fill(0, list(STATUSES))


def summary(report: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(ordinal, metric, value): the thirteen metrics, in one pass over the report."""
    kind, zero = F.col("kind"), F.lit(0).cast("long")
    total = lambda c, *kinds: F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col(c))), zero)
    made = [
        F.coalesce(F.sum("left_members"), zero), F.coalesce(F.sum("right_members"), zero), F.count_if(kind == "matched"), F.count_if(kind == "left_only"), F.count_if(kind == "right_only"),
        total("left_members", "ambiguous_key", "left_missing_key", "left_invalid_key"), total("right_members", "ambiguous_key", "right_missing_key", "right_invalid_key"),
        F.lit(len(checks)).cast("long"), F.count("check"), *(F.count_if(kind == s) for s in STATUSES),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("metric"), c.alias("value")) for i, (m, c) in enumerate(zip(METRICS, made), 1)))
    return report.agg(rows.alias("m")).select(F.inline("m"))


def coverage(disclosed: DataFrame) -> DataFrame:
    """(comparison, target, complete, lacking): whether cells (comparison, target, ordinal, field) disclosed to a target, in whatever
    packets, cover the metric and the value of all thirteen rows (E7). Sets of cells are bits, merged by one aggregate; other rows and
    fields of a report don't count."""
    ordinal = F.col("ordinal").cast("int")
    inside = ordinal.between(1, len(METRICS)) & F.col("field").isin("metric", "value")
    bit = F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), 2 * (ordinal - 1) + F.when(F.col("field") == "value", 1).otherwise(0))).otherwise(F.lit(0).cast("long"))
    seen = disclosed.groupBy("comparison", "target").agg(F.bit_or(bit).alias("_seen"))
    lacking = F.array_compact(F.array(*(F.when(F.col("_seen").bitwiseAND(F.lit(3 << 2 * i).cast("long")) != (3 << 2 * i), F.lit(m)) for i, m in enumerate(METRICS))))
    return seen.select("comparison", "target", (F.col("_seen") == (1 << 2 * len(METRICS)) - 1).alias("complete"), lacking.alias("lacking"))
