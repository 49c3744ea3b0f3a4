"""Append-only records with content-made ids, receipts that expire, replay protection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_id(records: DataFrame, fields: Sequence[str], prefix: str = "r-") -> DataFrame:
    """Adds the id: the beginning of the SHA-256 of the fields as JSON, so equal records have equal ids."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return records.withColumn("id", F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 24)))


def append(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """The records that the ledger doesn't hold yet, each once (K6)."""
    return records.dropDuplicates(["id"]).join(ledger.select("id"), "id", "left_anti")


def latest(ledger: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """The newest record of each key, ties by id."""
    order = Window.partitionBy(*key).orderBy(F.desc(at), "id")
    return ledger.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def consistent_sample(overlap: Column, left_distinct: Column, right_distinct: Column, joined: Column, most_left: Column, most_right: Column) -> Column:
    """Whether the counts of a verified sample can be true together."""
    return (overlap <= left_distinct) & (overlap <= right_distinct) & (joined >= overlap) & (joined <= overlap * most_left * most_right)


def live_receipts(events: DataFrame, key: str, at: str, minutes: int = 15) -> DataFrame:
    """Events with whether an earlier one of the same key still counts (within so many minutes before it; X2)."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    return events.withColumn("live", F.coalesce(F.col(at) <= before + F.make_dt_interval(mins=F.lit(minutes)), F.lit(False)))


def once(actions: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """The first action of each digest; replays are dropped."""
    return actions.withColumn("_n", F.row_number().over(Window.partitionBy(digest).orderBy(*order))).where("_n = 1").drop("_n")


def audit_counts(planned: DataFrame, loaded: DataFrame, key: str, valid: Column) -> DataFrame:
    """Planned, loaded, missing and invalid rows."""
    return planned.select(key).join(loaded.withColumn("_valid", valid).withColumn("_there", F.lit(True)), key, "left").agg(
        F.count("*").alias("planned"), F.count("_there").alias("loaded"), F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if(F.col("_there") & ~F.coalesce("_valid", F.lit(False))).alias("invalid")
    )
