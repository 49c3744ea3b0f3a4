"""Nested JSON as VARIANT, walked level by level by one chain of generators: no Python, no shuffle, one read of the texts (A10).

A level replaces each object or list by its members; scalars pass through. How many levels there are comes from the data: a level is added
while any row still holds an object or a list with members, which a job of one row's limit finds out.

Defined results: null texts have no leaves; text that isn't JSON, or a key that comes twice in an object, fails the query, and so do more
than MOST_LEVELS levels; numbers count as values, so 1.50 and 1.5 are one; empty objects and lists aren't leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FIELDS, MOST_NAME, MOST_VALUES, MOST_PATHS, MOST_LEVELS = 8, 80, 50, 8, 32


def _level(nodes: DataFrame) -> DataFrame:
    """The members of objects and lists in their place; other rows as they are, marked as done."""
    inside = nodes.alias("n").lateralJoin(nodes.sparkSession.tvf.variant_explode_outer(F.col("n._v").outer()).alias("m"))
    keys = F.when(F.col("m.key").isNotNull(), F.array_append("n._keys", F.col("m.key"))).otherwise(F.col("n._keys"))
    open_ = F.col("m.pos").isNotNull()
    rest = [F.col(f"n.{c}") for c in nodes.columns if c not in ("_keys", "_v", "_open")]
    return inside.select(*rest, keys.alias("_keys"), F.when(open_, F.col("m.value")).otherwise(F.col("n._v")).alias("_v"), open_.alias("_open"))


def leaves(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., keys, kind, value): the scalars of JSON texts, by the keys on the way to them; places in lists aren't part of it.

    `kind` is the scalar's type (VOID for a JSON null, whose value is null); `value` is its text."""
    nodes = df.select(*keep, F.array().cast("array<string>").alias("_keys"), F.parse_json(column).alias("_v"), F.lit(True).alias("_open"))
    nodes = _level(nodes)
    for _ in range(MOST_LEVELS):
        if nodes.where("_open").isEmpty():
            kind = F.schema_of_variant("_v")
            found = nodes.select(*keep, F.col("_keys").alias("keys"), kind.alias("kind"), F.try_variant_get("_v", "$", "string").alias("value"))
            return found.where(F.col("kind").isNotNull() & ~F.startswith("kind", F.lit("OBJECT<")) & ~F.startswith("kind", F.lit("ARRAY<")))
        nodes = _level(nodes)
    raise ValueError(f"over {MOST_LEVELS} levels")


def selectors(fields: Sequence[str]) -> list[str]:
    """Trimmed names of leaves or dotted ends of paths, each once whatever its case (1 to 8)."""
    first: dict[str, str] = {}
    for f in fields:
        first.setdefault(f.strip().lower(), f.strip())
    named = list(first.values())
    if not 1 <= len(named) <= MOST_FIELDS or any(not 1 <= len(f) <= MOST_NAME for f in named):
        raise ValueError(f"1 to {MOST_FIELDS} fields of 1 to {MOST_NAME} characters")
    return named


def profile_fields(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """A row for each selector (A10): field, matched, ambiguous, path_count, paths, count, nulls, distinct, duplicates, values, more_values.

    A selector without a dot is a leaf's name at any depth, one with a dot is a path or its end; case doesn't matter. Where leaves of
    several paths match, the selector is ambiguous: its paths are told (the first MOST_PATHS), and its counts are 0, since values of
    unrelated fields must not be counted together. Values are the smallest MOST_VALUES."""
    named = selectors(fields)
    path, last = F.lower(F.array_join("keys", ".")), F.lower(F.element_at("keys", -1))
    hits = [F.when((path == f.lower()) | F.endswith(path, F.lit(f".{f.lower()}")) if "." in f else last == f.lower(), F.lit(i)) for i, f in enumerate(named)]
    some = leaves(df, column).where(F.size("keys") > 0)
    some = some.select(F.explode(F.array_compact(F.array(*hits))).alias("i"), F.array_join("keys", ".").alias("path"), "value")
    some = some.groupBy("i", "path", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    by_path = some.groupBy("i", "path").agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"))
    first_paths = by_path.withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy("path"))).where(F.col("_n") <= MOST_PATHS)
    paths = first_paths.groupBy("i").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    counts = by_path.groupBy("i").agg(F.count("*").alias("path_count"), F.sum("count").alias("count"), F.sum("nulls").alias("nulls"), F.sum("distinct").alias("distinct"))
    # the limit of a window's rank is applied before its shuffle too
    first_values = some.where(known).select("i", "path", "value").withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy("value", "path"))).where(F.col("_n") <= MOST_VALUES)
    values = first_values.groupBy("i").agg(F.array_sort(F.collect_list("value")).alias("values"))
    asked = df.sparkSession.createDataFrame(list(enumerate(named)), "i int, field string")
    out = asked.join(counts, "i", "left").join(paths, "i", "left").join(values, "i", "left")
    one = F.col("path_count") == 1
    number = lambda c: F.when(one, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<string>")
    out = out.withColumn("path_count", F.coalesce("path_count", F.lit(0))).select(
        "field", (F.col("path_count") > 0).alias("matched"), (F.col("path_count") > 1).alias("ambiguous"), "path_count", F.coalesce("paths", none).alias("paths"),
        number("count"), number("nulls"), number("distinct"), F.when(one, F.coalesce("values", none)).otherwise(none).alias("values"),
    )
    return out.withColumn("duplicates", F.col("count") - F.col("distinct")).withColumn("more_values", F.col("distinct") > MOST_VALUES)
