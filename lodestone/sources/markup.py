"""Readers for markup: HTML blocks, XML to maps, JSON records and leaves."""

from __future__ import annotations

import hashlib
import json
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = {"address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "tr", "ul"}
HIDDEN = {"script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Text by innermost block, with the path of tags to it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.found: list[tuple[str, str]] = []
        self.text: list[str] = []

    def close_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append(("/".join(self.path), text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.close_block()
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.path:
            return
        if tag in BLOCKS or any(t in BLOCKS for t in self.path[len(self.path) - self.path[::-1].index(tag) :]):
            self.close_block()
        while self.path.pop() != tag:
            pass

    def handle_data(self, data):
        if not HIDDEN.intersection(self.path):
            self.text.append(data)


def html_blocks(html: str) -> list[tuple[str, str]]:
    """(path, text) of each block that has text of its own, scripts left out."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.close_block()
    return parser.found


def document_blocks(pages: DataFrame, key: str, html: str, contains: str | None = None) -> DataFrame:
    """(key, block, path, text, sha256): the blocks of each page, those that contain a literal if one is given."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(k, i, p, t, hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()) for i, (p, t) in enumerate(html_blocks(text or ""), 1)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], [key, "block", "path", "text", "sha256"])

    out = pages.select(F.col(key).cast("long"), html).mapInArrow(run, f"{key} long, block long, path string, text string, sha256 string")
    return out.where(F.contains("text", F.lit(contains))) if contains else out


def xml_to_value(node: ElementTree.Element):
    """Repeated children become lists, attributes are dropped, a leaf is its text."""
    if not len(node):
        return (node.text or "").strip()
    out: dict = {}
    for child in node:
        value = xml_to_value(child)
        name = child.tag.rpartition("}")[2]
        if name not in out:
            out[name] = value
        elif isinstance(out[name], list):
            out[name].append(value)
        else:
            out[name] = [out[name], value]
    return out


def xml_as_json(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """Adds the XML text of a column as JSON."""

    @F.pandas_udf("string")
    def convert(s):
        return s.map(lambda x: None if x is None else json.dumps(xml_to_value(ElementTree.fromstring(x)), ensure_ascii=False))

    return df.withColumn(out, convert(column))


def record_array(value, pointer: str | None = None):
    """The records of a JSON document: the array at a pointer, or the only array of flat objects."""
    if pointer is not None:
        for part in pointer.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            value = value[int(part)] if isinstance(value, list) else value[part]
        return value
    found = []

    def walk(v):
        if isinstance(v, list):
            if v and all(isinstance(x, dict) for x in v):
                found.append(v)
            else:
                for x in v:
                    walk(x)
        elif isinstance(v, dict):
            for x in v.values():
                walk(x)

    walk(value)
    if len(found) != 1:
        raise ValueError(f"{len(found)} arrays of records")
    return found[0]


def json_records(df: DataFrame, key: str, column: str, pointer: str | None = None) -> DataFrame:
    """(key, record, fields): the flat records of each JSON document; nested values are refused."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, r in enumerate(record_array(json.loads(text, parse_int=str, parse_float=str), pointer), 1):
                    if any(isinstance(v, (dict, list)) for v in r.values()):
                        raise ValueError("a record holds a nested value")
                    rows.append((k, i, [(n, None if v is None else str(v).lower() if isinstance(v, bool) else v) for n, v in r.items()]))
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())))], [key, "record", "fields"])

    return df.select(F.col(key).cast("long"), column).mapInArrow(run, f"{key} long, record long, fields map<string,string>")
