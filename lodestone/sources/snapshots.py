"""Catalogue snapshots and pages, workbook layouts."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deleted, listed, loose_integer
from ..functions.vectors import valid
from .tables import _REL, _X, _read, xlsx_cells

ENTRY = "pk string, title string, org string, category string, description string, apply_count long, view_count long, modified_at string, svc_type string, formats array<string>"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines, plain or gzip; a malformed line fails, as does a missing or repeated key."""
    entries = spark.read.schema(ENTRY).json(path, mode="FAILFAST")
    state = entries.agg(F.count("*").alias("n"), F.count_distinct("pk").alias("keys"), F.count_if(F.trim(F.coalesce("pk", F.lit(""))) == "").alias("blank")).first()
    if state.n != state.keys or state.blank:
        raise ValueError("keys must be there, once each")
    return entries


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The items of page files {page, total, items: [...]} once all pages are there and the total agrees."""
    pages = spark.read.schema(f"page int, total long, items array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").json(path, mode="FAILFAST", multiLine=True)
    state = pages.agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"), F.min("page").alias("first"), F.max("page").alias("last"), F.count_distinct("total").alias("totals"), F.max("total").alias("total"), F.sum(F.size("items")).alias("items")).first()
    if not state.n or state.n != state.pages or state.first != 1 or state.last != state.n or state.totals != 1 or state.total != state.items:
        raise ValueError("pages are missing or don't add up")
    return pages.select(F.explode("items").alias("e")).select("e.*")


def monthly_entries(rows: DataFrame) -> DataFrame:
    """Entries from the all-text rows of a monthly list (S23): counts with commas, formats in one cell, deleted rows dropped."""
    kept = rows.where(~deleted(F.col("deleted")))
    return kept.select("pk", "title", "org", "category", "description", loose_integer(F.col("apply_count")).alias("apply_count"), loose_integer(F.col("view_count")).alias("view_count"), "modified_at", F.upper("svc_type").alias("svc_type"), listed(F.col("formats")).alias("formats"))


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """A vector index (pk, doc_hash, vec) whose every vector is valid, or an error."""
    index = spark.read.schema("pk string, doc_hash string, vec array<float>").parquet(path)
    if not index.where(~valid(F.col("vec"), dimension)).isEmpty():
        raise ValueError(f"a vector isn't {dimension} finite components")
    return index


def edition(versions: DataFrame, key: str, name: str, exact: str) -> DataFrame:
    """The one row of an exactly named edition; there is no fallback to another."""
    found = versions.where((F.col(key) == name) & (F.col("edition") == exact))
    if found.limit(2).count() != 1:
        raise ValueError(f"no single edition {exact} of {name}")
    return found


def xlsx_layout(spark: SparkSession, path: str) -> DataFrame:
    """Sheet names with the rows, columns and cells they use, no values."""

    def parse(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n.get("name") for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet") if n.get(_REL)]
        out = []
        for i, name in enumerate(names, 1):
            used = [k for k, v in xlsx_cells(data, name).items() if v is not None]
            out.append((i, i, {"sheet": name, "cells": str(len(used)), "columns": str(max((c for c, _ in used), default=0)), "rows": str(max((r for _, r in used), default=0))}))
        return out

    return _read(spark, path, parse)


def header_row(rows: DataFrame, most: int = 12) -> int | None:
    """The record number, among the first rows of a rectangle, of the last one with most filled text cells."""
    text = lambda v: v.isNotNull() & ~v.rlike(r"\A-?[0-9.,]+\z")
    score = F.aggregate(F.map_values("fields"), F.lit(0), lambda acc, v: acc + F.when(text(v), 1).otherwise(0))
    best = rows.where(F.col("record") <= most).select("record", score.alias("score")).orderBy(F.desc("score"), F.desc("record")).first()
    return best.record if best and best.score else None
