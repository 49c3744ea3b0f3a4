"""Guarded aggregation: count and exact sum, fan-out guard, reduction before a join, profiles and audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import GROUPED, PLAIN, trimmed


@dataclass
class Measure:
    """count (of rows, or of a column's non-null values) or sum of a numeric column, under a name."""

    name: str
    op: str
    column: str | None = None
    origin: str | None = None  # the record-position column of the value's source; guards a sum against fan-out
    scale: int | None = None  # decimal places of the sum; the column's own unless given


def own_scale(kind: T.DataType) -> int:
    if isinstance(kind, T.DecimalType):
        return kind.scale
    if isinstance(kind, T.IntegralType):
        return 0
    raise ValueError(f"{kind.simpleString()} has no exact scale: convert it, or say which")


def guarded_sum(df: DataFrame, name: str, scale: int | None = None, origin: Column | None = None) -> Column:
    """An exact sum that fails on null (R4), on a value with more decimal places, and on a record that counts twice."""
    value, kind = F.col(name), df.schema[name].dataType
    scale = own_scale(kind) if scale is None else scale
    number = value.cast(f"decimal(38,{scale})")
    lost = F.raise_error(F.concat(F.lit(f"over {scale} decimal places: "), value.cast("string"))).cast(f"decimal(38,{scale})")
    number = F.when(value.isNull(), F.raise_error(F.lit("sum over a null value")).cast(f"decimal(38,{scale})")).when(number.cast(kind) == value, number).otherwise(lost)
    total = F.sum(number).cast(f"decimal(38,{scale})")
    if origin is None:
        return total
    return F.when(F.count(origin) != F.count_distinct(origin), F.raise_error(F.lit("a source record counts twice in one group")).cast(f"decimal(38,{scale})")).otherwise(total)


def aggregate(df: DataFrame, group_by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Groups, the null group kept (R3); no keys make one global row."""
    names = [*group_by, *(m.name for m in measures)]
    if not measures or len(set(names)) != len(names):
        raise ValueError("aggregates need names of their own")
    made = []
    for m in measures:
        if m.op == "count":
            made.append((F.count(F.col(m.column)) if m.column else F.count("*")).alias(m.name))
        elif m.op == "sum":
            if isinstance(df.schema[m.column].dataType, T.StringType):
                raise ValueError(f"{m.column} is text: convert it first")
            made.append(guarded_sum(df, m.column, m.scale, F.col(m.origin) if m.origin else None).alias(m.name))
        else:
            raise ValueError(f"no aggregate {m.op}")
    return df.groupBy(*group_by).agg(*made)


def fan_out(df: DataFrame, group_by: Sequence[str], origin: str) -> DataFrame:
    """The groups in which a source record occurs more than once (A4)."""
    return df.groupBy(*group_by).agg(F.count(origin).alias("rows"), F.count_distinct(origin).alias("records")).where("rows != records")


def reduce_source(df: DataFrame, group_by: Sequence[str], measures: Sequence[Measure], period: tuple[str, str] | None = None) -> DataFrame:
    """One source aggregated before it is joined: the measures, the number of members and the period they all share, which is
    unknown if any member's is (A5, A6)."""
    if not group_by or not 1 <= len(measures) <= 8:
        raise ValueError("a reduction has groups and 1 to 8 measures")
    extra = [F.count("*").alias("members")]
    if period:
        known = F.count_if(F.col(period[0]).isNull() | F.col(period[1]).isNull()) == 0
        extra += [F.when(known, F.max(period[0])).alias(period[0]), F.when(known, F.min(period[1])).alias(period[1])]
    made = [(F.count(m.column or F.lit(1)) if m.op == "count" else guarded_sum(df, m.column, m.scale)).alias(m.name) for m in measures]
    return df.groupBy(*group_by).agg(*made, *extra)


def at_most(df: DataFrame, n: int) -> DataFrame:
    """The rows, or an error when there are more: over-limit results are never cut."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"over {n} rows")
    return df


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the join is empty")
    return df


def profile_columns(df: DataFrame) -> DataFrame:
    """A row of shape statistics for each column, in one pass (A8). `kinds` are those that its values come in."""
    rows = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = c if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")
        flat = trimmed(text)
        filled = text.isNotNull() & (flat != "")
        size = F.size(F.split(flat, r"(?U)\s+"))
        small = filled & (F.octet_length(text) <= 256)
        kind = F.lit({"string": "text", "boolean": "truth", "date": "time", "timestamp": "time", "array": "list", "map": "object", "struct": "object", "binary": "bytes"}.get(f.dataType.typeName(), "number"))
        if isinstance(f.dataType, T.StringType):
            kind = F.when(flat == "", "blank").when(small & flat.rlike(PLAIN), "number").when(small & flat.rlike(GROUPED), "grouped number").otherwise("text")
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.count_if(c.isNull()).alias("nulls"), F.count(text).alias("strings"), F.count_if(text.isNotNull() & (text != flat)).alias("trimmed"),
            F.count_if(text.isNotNull() & (flat == "")).alias("blank"), F.min(F.when(filled, size)).alias("min_tokens"), F.max(F.when(filled, size)).alias("max_tokens"),
            F.count_if(small & flat.rlike(PLAIN)).alias("decimal"), F.count_if(small & flat.rlike(GROUPED)).alias("grouped"),
            F.array_sort(F.collect_set(F.when(c.isNull(), "null").otherwise(kind))).alias("kinds"),  # one of ten names
        ))
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def profile_json(df: DataFrame, column: str, path: str, samples: int = 50) -> DataFrame:
    """Count, nulls, distinct, duplicates and the first sample values at a path of a JSON column (A10)."""
    found = df.select(F.get_json_object(column, f"$.{path}").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    counts = found.agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"))
    counts = counts.withColumn("duplicates", F.col("count") - F.col("distinct"))
    return counts.join(found.where(known).select("value").orderBy("value").limit(samples).agg(F.array_sort(F.collect_list("value")).alias("values")))


def value_counts(df: DataFrame, column: str, empty: str = "unknown") -> DataFrame:
    """Rows by value, blank and null under one name."""
    return df.groupBy(F.coalesce(F.nullif(trimmed(F.col(column).cast("string")), F.lit("")), F.lit(empty)).alias(column)).agg(F.count("*").alias("rows"))


def first_of_each(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def contiguous(df: DataFrame, position: str) -> DataFrame:
    """Whether positions run without a gap or a repeat."""
    return df.agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("rows"), ((F.max(position) - F.min(position) + 1 == F.count_distinct(position)) & (F.count("*") == F.count_distinct(position))).alias("complete"))


def digest(df: DataFrame) -> DataFrame:
    """A digest of a table that doesn't depend on the order of its rows: row hashes are added up exactly."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).alias("sum"))


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed): conditions that every row must meet."""
    tests = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias("passed")) for n, c in checks.items()))
    return df.agg(tests.alias("t")).select(F.explode("t").alias("t")).select("t.*")
