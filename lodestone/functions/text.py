"""Text helpers: tokens, compact text, lists in a cell, loose integers, keys in parentheses."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(*parts: Column) -> Column:
    """White-space tokens of the parts joined; null if any part is null or blank."""
    joined = F.concat_ws(" ", *parts)
    found = F.filter(F.split(joined, r"(?U)\s+"), lambda x: x != "")
    known = parts[0].isNotNull()
    for p in parts:
        known = known & p.isNotNull() & (F.regexp_replace(p, r"(?U)\s+", "") != "")
    return F.when(known, found)


def compact(text: Column, most: int) -> Column:
    """White space collapsed, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)


def preview(text: Column, most: int = 180) -> Column:
    """The beginning of a collapsed text, with an ellipsis where it was cut."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def listed(text: Column, separators: str = r"[,;/|+]", upper: bool = True) -> Column:
    """The different entries of a cell that holds a list (F16)."""
    parts = F.filter(F.transform(F.split(text, separators), lambda x: F.trim(F.upper(x) if upper else x)), lambda x: x != "")
    return F.array_distinct(parts)


def loose_integer(text: Column) -> Column:
    """Digits, with grouping commas or not, else 0."""
    digits = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.coalesce(F.when(digits.rlike(r"\A[0-9]{1,18}\z"), digits.cast("long")), F.lit(0).cast("long"))


def trailing_digits(text: Column, width: int) -> Column:
    """The last parenthesised group if it is exactly so many ASCII digits (J13), else null."""
    return F.nullif(F.regexp_extract(text, rf"\(([0-9]{{{width}}})\)\s*\z", 1), F.lit(""))


def code_prefix(text: Column, prefix: str, width: int = 10) -> Column:
    """Whether the last parenthesised code begins with the prefix."""
    return F.coalesce(F.startswith(trailing_digits(text, width), F.lit(prefix)), F.lit(False))


def required(mark: Column) -> Column:
    """Whether a parameter's mark says that it is required."""
    flat = F.lower(F.trim(mark))
    return F.startswith(flat, F.lit("필")) | flat.isin("y", "yes", "true", "1")


def deleted(mark: Column) -> Column:
    """Whether a row's mark says that it is deleted (P10)."""
    return F.lower(F.trim(F.coalesce(mark, F.lit("")))).isin("y", "yes", "true", "1")


def edge_kinds(kinds: Column, allowed: Sequence[str] = ("entity", "spatial", "temporal", "proxy")) -> Column:
    """Known kinds, lower case, each once."""
    return F.array_distinct(F.filter(F.transform(kinds, lambda x: F.lower(F.trim(x))), lambda x: x.isin(*allowed)))


def query_terms(text: str, fillers: Sequence[str] = (), particles: Sequence[str] = ()) -> list[str]:
    """Terms of a question: lower case, split at space, punctuation and symbols; fillers dropped; the first particle whose removal
    leaves two characters is stripped; fillers dropped again. Duplicates stay (F13)."""
    flat = "".join(" " if unicodedata.category(c)[0] in "PSZ" or c.isspace() else c for c in text.lower())
    out = []
    for term in flat.split():
        if term in fillers:
            continue
        ending = next((p for p in particles if term.endswith(p) and len(term) - len(p) >= 2), "")
        term = term[: len(term) - len(ending)]
        if term not in fillers:
            out.append(term)
    return out


def sensitive_name(name: str) -> bool:
    """Whether a column's name tells of a credential."""
    return bool(re.search(r"(?i)(pass(word|wd)?|secret|token|api_?key|service_?key|auth)", name))


def display_width(text: str) -> int:
    """Terminal cells: wide characters count as two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def bounded_utf8(text: str, most: int) -> str:
    """The longest prefix of at most so many bytes."""
    return text.encode()[:most].decode("utf-8", "ignore")


def pointer_parts(pointer: str) -> list[str]:
    """The unescaped parts of a JSON pointer."""
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def cell_index(name: str) -> tuple[int, int]:
    """Column and row of a spreadsheet address, from 1."""
    found = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]*)", name)
    if not found:
        raise ValueError(f"not a cell: {name}")
    column = 0
    for c in found[1]:
        column = 26 * column + ord(c) - 64
    return column, int(found[2])
