"""Building and keeping a catalogue: keyed merge, incremental reuse, coverage guard, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Better service kinds win a merge.
SERVICE_RANK = {"REST": 3, "LINK": 2, "FILE": 1, "STD": 1}


def service_rank(kind: Column) -> Column:
    rank = F.lit(0)
    for name, n in SERVICE_RANK.items():
        rank = F.when(F.upper(kind) == name, n).otherwise(rank)
    return rank


def _first_filled(column: str) -> Column:
    filled = F.trim(F.coalesce(F.col(column), F.lit(""))) != ""
    return F.min_by(column, F.when(filled, F.col("source_order")))


def merge(*sources: DataFrame) -> DataFrame:
    """One row per pk from several sources, earlier ones first (A14, U1): first filled title, org and category, the longest
    description (of equally long ones the first), greatest counts and date, best service kind, union of formats."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_order", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    text = F.coalesce("description", F.lit(""))
    formats = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("formats", lambda x: F.upper(F.trim(x)))))))
    return rows.groupBy("pk").agg(
        _first_filled("title").alias("title"), _first_filled("org").alias("org"), _first_filled("category").alias("category"),
        F.max_by("description", F.struct(F.length(text), -F.col("source_order"))).alias("description"),
        F.max("apply_count").alias("apply_count"), F.max("view_count").alias("view_count"), F.max("modified_at").alias("modified_at"),
        F.max_by("svc_type", F.struct(service_rank(F.col("svc_type")), -F.col("source_order"))).alias("svc_type"), formats.alias("formats"),
    )


def reuse(index: DataFrame, documents: DataFrame, recipe: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept index rows, documents to embed): vectors whose key, document hash and recipe columns (as the model and how texts are put
    together) haven't changed are kept (J16)."""
    same = ["pk", "doc_hash", *recipe]
    return index.join(documents.select(*same), same, "left_semi"), documents.join(index.select(*same), same, "left_anti")


def document_hash(*columns: str) -> Column:
    """Hash of the text that is embedded."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in columns)), 256)


def publisher_counts(entries: DataFrame, limit: int = 20) -> DataFrame:
    """Entries and demand by organisation, greatest first, ties by name."""
    grouped = entries.groupBy("org").agg(F.count("*").alias("entries"), F.sum("apply_count").alias("demand"))
    return grouped.orderBy(F.desc("entries"), F.desc("demand"), "org").limit(limit)


def coverage(entries: DataFrame) -> DataFrame:
    """Entries, REST and file entries, and entries with a filled description, in one pass."""
    return entries.agg(F.count("*").alias("entries"), F.count_if(F.col("svc_type") == "REST").alias("api"), F.count_if(F.col("svc_type") == "FILE").alias("file"), F.count_if(F.coalesce(F.length("description"), F.lit(0)) > 0).alias("described"))


def keeps_old(old: DataFrame, new: DataFrame) -> bool:
    """Whether a new snapshot covers under 90 % of the old one in any count, so that the old one stays."""
    a, b = old.first(), new.first()
    return any(b[c] * 10 < a[c] * 9 for c in old.columns)


def stale(synced_at: Column, now: Column, days: int = 14) -> Column:
    """Whether a snapshot is older than so many days."""
    return synced_at < now - F.make_dt_interval(F.lit(days))
