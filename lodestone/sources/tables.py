"""Readers for tabular files: CSV in UTF-8 or EUC-KR, CSV inside ZIP, XLSX rectangles, DBF headers.

Files come through Spark's binaryFile source, so any store that Spark reads will do, and are parsed in the executors, file by file;
each row keeps its data record number from 1 (W6). Large plain UTF-8 CSV goes through `csv_splittable`, which splits files instead."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell_index

MOST_COLUMNS, MOST_BYTES, MOST_MEMBERS = 256, 64 << 20, 128
ROW = "path string, record long, line long, fields map<string,string>, sha256 string"


def decode(data: bytes) -> str:
    """UTF-8 if valid, else EUC-KR if it goes back to the same bytes."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("euc_kr")
        if text.encode("euc_kr") != data:
            raise ValueError("neither UTF-8 nor EUC-KR") from None
        return text


def sniff(line: str) -> str:
    """The separator of a header line: comma, tab or bar (S3)."""
    return max(",\t|", key=lambda c: (line.count(c), c == ","))


def parse_csv(text: str, separator: str | None = None) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(record, line, fields) of strictly formed CSV: a header of different names, rows as wide as it."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=separator or sniff(text.split("\n", 1)[0]), strict=True)
    header = next(reader, [])
    if not header or len(header) > MOST_COLUMNS or len({h.strip() for h in header}) != len(header) or not all(h.strip() for h in header):
        raise ValueError("the header needs different names that aren't blank")
    for record, row in enumerate(reader, 1):
        if len(row) != len(header):
            raise ValueError(f"record {record} has {len(row)} fields, the header {len(header)}")
        yield record, reader.line_num, dict(zip(header, row))


def _rows(parse):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if len(data) > MOST_BYTES:
                    raise ValueError(f"{path} is over {MOST_BYTES} bytes")
                sha = hashlib.sha256(data).hexdigest()
                found = list(parse(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found)), pa.array([r for r, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([list(f.items()) for _, _, f in found], pa.map_(pa.string(), pa.string())), pa.array([sha] * len(found))],
                    ["path", "record", "line", "fields", "sha256"],
                )

    return run


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows(parse), ROW)


def csv_files(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, record, line, fields, sha256) of every record of the files."""
    return _read(spark, path, lambda data: parse_csv(decode(data), separator))


def csv_splittable(spark: SparkSession, path: str, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """All-text columns of large UTF-8 CSV, split over tasks; malformed rows fail the query."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, sep=separator, escape='"', mode="FAILFAST", nullValue="\u0001", emptyValue="")


def safe_member(name: str) -> bool:
    return not (name.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", name) or ":" in name)


def zip_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """The records of one CSV member of ZIP files; sizes and checksums are verified."""

    def parse(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if len(z.infolist()) > MOST_MEMBERS or not all(safe_member(i.filename) for i in z.infolist()) or sum(i.file_size for i in z.infolist()) > MOST_BYTES:
                raise ValueError("not a ZIP file that may be read")
            return list(parse_csv(decode(z.read(member))))

    return _read(spark, path, parse)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, line, fields): name, size and checksum of each member."""

    def parse(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i, i, {"name": m.filename, "size": str(m.file_size), "crc": f"{m.CRC:08x}"}) for i, m in enumerate(z.infolist(), 1)]

    return _read(spark, path, parse)


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_cells(data: bytes, sheet: str) -> dict[tuple[int, int], str | None]:
    """(column, row) to text of a sheet; numbers keep their digits, an error cell fails."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.get("name"): n.get(_REL) for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")}
        if sheet not in names:
            raise ValueError(f"no sheet {sheet}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
        cells = {}
        for c in ElementTree.fromstring(z.read("xl/" + targets[names[sheet]].removeprefix("/xl/"))).iter(f"{_X}c"):
            value, kind = c.findtext(f"{_X}v"), c.get("t", "n")
            if kind == "e":
                raise ValueError(f"cell {c.get('r')} holds an error")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_X}t"))
            elif kind == "b" and value is not None:
                value = "true" if value == "1" else "false"
            cells[cell_index(c.get("r"))] = value
        return cells


def xlsx_rectangle(spark: SparkSession, path: str, sheet: str, first: str, last: str) -> DataFrame:
    """The rows of a rectangle; fields are named by column letter, blank cells are null."""
    (a, b), (c, d) = cell_index(first), cell_index(last)
    if not (a <= c and b <= d and c - a < MOST_COLUMNS and d - b < 1000):
        raise ValueError("not a rectangle that may be read")

    def letters(n: int) -> str:
        return (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)

    def parse(data: bytes):
        cells = xlsx_cells(data, sheet)
        return [(r - b + 1, r, {letters(k): cells.get((k, r)) for k in range(a, c + 1)}) for r in range(b, d + 1)]

    return _read(spark, path, parse)


def dbf_schema(spark: SparkSession, path: str) -> DataFrame:
    """Field names, types and the declared row count of DBF headers."""

    def parse(data: bytes):
        rows, size = struct.unpack_from("<IH", data, 4)
        found, at = [], 32
        while at + 32 <= size and data[at] != 0x0D:
            name, kind = data[at : at + 11].split(b"\0", 1)[0].decode("ascii"), chr(data[at + 11])
            found.append((len(found) + 1, rows, {"name": name, "type": kind, "length": str(data[at + 16])}))
            at += 32
        return found

    return _read(spark, path, parse)


def select_equal(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Rows whose fields equal the chosen values exactly."""
    for name, value in chosen.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def select_in(df: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose fields are each one of 1 to 32 values (P5)."""
    for name, values in chosen.items():
        if not 1 <= len(values) <= 32:
            raise ValueError("1 to 32 values")
        df = df.where(F.col(name).isin(*values))
    return df


def select_first(df: DataFrame, condition: Column, order: Sequence[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(counts, the first `most` matches in the given order): a selection that keeps a bounded part and tells how much there is."""
    return scan_counts(df, condition, most), df.where(condition).orderBy(*order).limit(most)


def scan_counts(df: DataFrame, matches, most: int) -> DataFrame:
    """Scanned, matched and returned rows of a selection that keeps at most so many."""
    return df.agg(F.count("*").alias("scanned"), F.count_if(matches).alias("matched"), F.least(F.count_if(matches), F.lit(most)).alias("returned"))
