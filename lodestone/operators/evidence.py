"""Evidence about a result: which records it used, single cells and their addresses, revisions, state changes, usage
(P15, A18, A22, J17-J19, K7, E4, E6, F18, F23, F25, F32, W4)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import digest


def cells(df: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """(record, field, value): a table cell by cell; a null value stays a row, so null and missing differ."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(F.col(record).alias("record"), F.explode(pairs).alias("c")).select("record", "c.field", "c.value")


def select_evidence(df: DataFrame, record: str, positions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The cells of chosen records (a frame of positions) and 1 to 8 fields."""
    if not 1 <= len(fields) <= 8:
        raise ValueError("1 to 8 fields")
    return cells(df.join(positions.select(record).distinct(), record, "left_semi"), record, fields)


def same_cells(disclosed: DataFrame, retained: DataFrame) -> DataFrame:
    """(record, field, value, agrees): disclosed cells by address against the retained ones; null where there is none."""
    kept = retained.select("record", "field", F.col("value").alias("_kept"), F.lit(True).alias("_there"))
    both = disclosed.join(kept, ["record", "field"], "left")
    return both.select("record", "field", "value", F.when(F.col("_there"), F.col("value").eqNullSafe(F.col("_kept"))).alias("agrees"))


def used_records(joined: DataFrame, positions: Sequence[str]) -> DataFrame:
    """(source, record): every record that takes part in a joined relation, by its position column."""
    each = F.array(*(F.struct(F.lit(p).alias("source"), F.col(p).cast("long").alias("record")) for p in positions))
    return joined.select(F.explode(each).alias("u")).select("u.source", "u.record").where("record is not null").distinct()


def same_revision(packets: DataFrame, taking_part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packets whose source revision (asset, content hash, contract hash) takes part."""
    return packets.join(taking_part.select(*keys).distinct(), list(keys), "left_semi")


def bridges(selected: DataFrame, pool: DataFrame, anchors: DataFrame, most: int = 3) -> DataFrame:
    """(anchor_pk, pk, role, position): selections (pk, role, position) that the pool holds, one for each role, not the anchor itself."""
    seen = selected.join(pool.select("pk").distinct(), "pk", "left_semi")
    one = seen.withColumn("_n", F.row_number().over(Window.partitionBy("role").orderBy("position", "pk"))).where("_n = 1").drop("_n")
    # the first anchor that isn't the selection itself: one of the first two
    nearest = anchors.groupBy(F.col("pk").alias("anchor_pk")).agg(F.min("position").alias("_at")).orderBy("_at", "anchor_pk").limit(2)
    with_anchor = one.crossJoin(F.broadcast(nearest)).where("anchor_pk != pk")
    first = with_anchor.withColumn("_n", F.row_number().over(Window.partitionBy("pk", "role").orderBy("_at", "anchor_pk"))).where("_n = 1")
    return first.orderBy("position", "pk").limit(most).select("anchor_pk", "pk", "role", "position")


def usage(calls: DataFrame, call: str, amount: str) -> DataFrame:
    """Calls, reported amounts and calls that report none, by kind of call."""
    return calls.groupBy(call).agg(F.count("*").alias("calls"), F.coalesce(F.sum(amount), F.lit(0)).alias("amount"), F.count_if(F.col(amount).isNull()).alias("unreported"))


def canonical_list(values: Column) -> Column:
    """Trimmed, sorted, each once, blanks dropped."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")))


def replayed(first: DataFrame, again: DataFrame) -> bool:
    """Whether a plan that is run again gives the same rows."""
    return digest(first).first() == digest(again).first()


def scalar_text(value: Column) -> Column:
    """A value's canonical text: whole doubles without a point, booleans in lower case."""
    text = value.cast("string")
    return F.regexp_replace(text, r"\A(-?[0-9]+)\.0\z", "$1")


def path_matches(path: Column, selector: str) -> Column:
    """Whether a dotted path is what a selector names: its leaf, or the whole path or a suffix of it."""
    low, wanted = F.lower(path), selector.lower()
    if "." in selector:
        return (low == wanted) | F.endswith(low, F.lit("." + wanted))
    return F.element_at(F.split(low, r"\."), -1) == wanted


def approval(label: Column) -> tuple[Column, Column]:
    """The two parts of a label like "development: automatic / production: reviewed" (F18)."""
    part = lambda i: F.nullif(F.trim(F.regexp_replace(F.split_part(label, F.lit("/"), F.lit(i)), r"\A[^:]*:", "")), F.lit(""))
    return part(1), part(2)


#: What a kind of edge needs checked before it counts.
CHECKS = {"entity": ["same key meaning", "key overlap"], "spatial": ["same coordinate system"], "temporal": ["same period unit"], "proxy": ["stated transform"]}


def checklist(kinds: Column) -> Column:
    """The checks that an edge's kinds ask for, each once (F32)."""
    asked = [F.when(F.array_contains(kinds, k), F.array(*map(F.lit, checks))).otherwise(F.array().cast("array<string>")) for k, checks in CHECKS.items()]
    return F.array_distinct(F.concat(*asked))


def first_exact_per_axis(hits: DataFrame) -> DataFrame:
    """(axis, pk): axes in order each take their earliest exact hit that no earlier axis has taken (W4). Axes are at most eight."""
    axes = sorted(r.axis for r in hits.select("axis").distinct().limit(9).collect())
    if len(axes) > 8:
        raise ValueError("over 8 axes")
    taken = None
    for axis in axes:
        free = hits.where((F.col("axis") == axis) & F.col("exact"))
        if taken is not None:
            free = free.join(taken.select("pk"), "pk", "left_anti")
        one = free.orderBy("rank", "pk").limit(1).select("axis", "pk")
        taken = one if taken is None else taken.unionByName(one)
    return taken if taken is not None else hits.select("axis", "pk").limit(0)


def json_changes(before, after, path: str = "") -> list[dict]:
    """The add, remove and replace steps from one JSON value to another (K7)."""
    if isinstance(before, dict) and isinstance(after, dict):
        steps = []
        for k in sorted({*before, *after}):
            at = f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
            if k not in after:
                steps.append({"op": "remove", "path": at})
            elif k not in before:
                steps.append({"op": "add", "path": at, "value": after[k]})
            else:
                steps += json_changes(before[k], after[k], at)
        return steps
    return [] if before == after and type(before) is type(after) else [{"op": "replace", "path": path, "value": after}]


def state_delta(states: DataFrame, before: str, after: str, out: str = "delta") -> DataFrame:
    """Adds the steps between two JSON columns, as JSON (K7)."""

    @F.pandas_udf("string")
    def delta(a, b):
        return a.combine(b, lambda x, y: json.dumps(json_changes(json.loads(x), json.loads(y)), ensure_ascii=False))

    return states.withColumn(out, delta(before, after))
