"""A full scan of CSV files in splits, with record and line numbers.

Whether a line starts a record depends on all quotes before it. A line either keeps or flips the state "inside quotes", so a stretch of
lines does what the parity of its quotes says; the parities of whole splits are composed in order, which gives each split its true first
state, its first line number and its first record number. No file is read by one task, and only records that cross lines are put together.

Records are strict: a quote inside an unquoted field, text behind a closing quote, quotes without an end, another number of fields than
the header has, blank or repeated header names and files with different headers fail the scan, whatever is selected from it later. Line
ends may be CRLF, and are LF inside fields; blank lines are no records but count as lines; a byte order mark is dropped; all values are
text, and nothing is null. Files without a header line give no rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a one-machine session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def strict(record: Column, separator: str) -> Column:
    """Whether quotes enclose whole fields only: with each quoted run as one sign, no other text touches such a sign."""
    sign, sep = "\u0001", f"\\x{ord(separator):02x}"
    plain = F.regexp_replace(F.translate(record, sign, " "), '"[^"]*"', sign)
    return ~plain.contains('"') & ~plain.rlike(f"[^{sep}{sign}]{sign}|{sign}[^{sep}{sign}]")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, record, text): every line that isn't blank between records; record 0 is the header."""
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("text"))
    kept = shared_path(spark, "csv-lines")
    # one reading is written down: splits and n of another may differ
    read.withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).write.parquet(kept)
    lines = spark.read.parquet(kept)
    inside = Window.partitionBy("path", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2
    # starts are counted for both first states a split may have
    starts = lambda state: F.when((odd == state) & (F.col("text") != ""), 1).otherwise(0)
    lines = lines.withColumn("odd", odd).withColumn("if_out", starts(0)).withColumn("if_in", starts(1))
    upto = Window.partitionBy("path", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.select("path", "split", "n", "text", "odd", F.sum("if_out").over(upto).alias("out_upto"), F.sum("if_in").over(upto).alias("in_upto"), F.row_number().over(Window.partitionBy("path", "split").orderBy("n")).alias("place"), "if_out", "if_in", "quotes")
    splits = lines.groupBy("path", "split").agg(F.sum("quotes").alias("quotes"), F.sum("if_out").alias("all_out"), F.sum("if_in").alias("all_in"), F.count("*").alias("lines"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("state", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).withColumn("own", F.when(F.col("state") == 0, F.col("all_out")).otherwise(F.col("all_in")))
    splits = splits.select("path", "split", "state", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("records_before"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"))
    found = lines.join(splits, ["path", "split"])
    out = F.col("state") == 0
    record = F.col("records_before") + F.when(out, F.col("out_upto")).otherwise(F.col("in_upto")) - 1
    starts_here = F.when(out, F.col("if_out")).otherwise(F.col("if_in")) == 1
    quoted = (F.col("odd") + F.col("state")) % 2 == 1
    return found.where(starts_here | quoted).select("path", (F.col("lines_before") + F.col("place")).alias("line"), record.alias("record"), "text")


def csv_scan(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(_path, _record, _line, the header's columns) of every data record; records count from 1, lines (of the file) too."""
    lines = numbered_lines(spark, path)
    mark = F.when(F.col("line") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    parts = lines.groupBy("path", "record").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", mark.alias("text")))), lambda x: x.text), "\n").alias("text"))
    whole = shared_path(spark, "csv-records")
    parts.write.parquet(whole)
    records = spark.read.parquet(whole)
    # no value holds CRLF, as its CR is dropped
    options = {"sep": separator, "escape": '"', "nullValue": "\r\n", "emptyValue": "", "mode": "FAILFAST"}
    headers = records.where("record = 0").select("text").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError("files have different headers")
    if not headers:
        return spark.createDataFrame([], "_path string, _record long, _line long")
    many = headers[0].text.count(separator) + 1
    row = spark.createDataFrame([(headers[0].text,)], "h string").select(F.from_csv("h", ", ".join(f"c{i} string" for i in range(many)), {**options, "mode": "PERMISSIVE"}).alias("r")).first().r
    names = [v.strip() for v in row if v is not None]
    if not names or "" in names or len(set(names)) < len(names) or not spark.range(1).select(strict(F.lit(headers[0].text), separator)).first()[0]:
        raise ValueError("a header needs names, no name twice, and whole quotes")
    place = F.concat(F.col("path"), F.lit(": record "), F.col("record").cast("string"))
    checked = F.when(strict(F.col("text"), separator), F.col("text")).otherwise(F.raise_error(F.concat(place, F.lit(" has stray quotes"))))
    # fields are counted by separators outside of quotes
    width = F.length(F.regexp_replace(F.regexp_replace("text", '"[^"]*"', ""), f"[^\\x{ord(separator):02x}]", "")) + 1
    checked = F.when(width == len(names), checked).otherwise(F.raise_error(F.concat(place, F.lit(" has another number of fields than the header"))))
    # a record is kept only if it passes, so a selection can't leave the checks out
    rows = records.where("record > 0").withColumn("_text", checked).where(F.col("_text").isNotNull())
    rows = rows.withColumn("_row", F.from_csv("_text", ", ".join(f"c{i} string" for i in range(len(names))), options))
    return rows.select(F.col("path").alias("_path"), F.col("record").cast("long").alias("_record"), F.col("line").cast("long").alias("_line"), *(F.coalesce(F.col(f"_row.c{i}"), F.lit("")).alias(c) for i, c in enumerate(names)))
