"""Sinks: JSON lines, pretty JSON, an aligned table, snapshot swap (K1-K5)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import display_width


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, nulls kept (K2)."""
    df.write.option("ignoreNullFields", "false").json(path)


def pretty_json(df: DataFrame, most: int = 1000) -> str:
    """A short result as indented JSON (K1); longer ones are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)


def aligned_table(df: DataFrame, most: int = 100) -> str:
    """A short result as text; wide characters take two cells (K3). Longer ones are refused, not cut."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    rows = [df.columns, *([("" if v is None else str(v)) for v in r] for r in found)]
    widths = [max(display_width(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c + " " * (w - display_width(c)) for c, w in zip(r, widths)).rstrip() for r in rows)


POINTER = "CURRENT"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def snapshot_path(spark: SparkSession, path: str) -> str:
    """The folder that holds the snapshot now."""
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def write_snapshot(df: DataFrame, path: str) -> None:
    """Writes a new version, then swaps the file that names it in one rename, so readers see the old snapshot or the new one, whole,
    and so they do after a crash (K4). The version before stays for those that read it; older ones go."""
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    pointer, fs = _path(spark, f"{path}/{POINTER}")
    before = spark.read.text(str(pointer)).first()[0] if fs.exists(pointer) else None
    df.write.parquet(f"{path}/{version}")
    staged, _ = _path(spark, f"{path}/_{version}")
    stream = fs.create(staged, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(staged, pointer, overwrite)
    for old in fs.listStatus(_path(spark, path)[0]):
        name = old.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(old.getPath(), True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(snapshot_path(spark, path))
