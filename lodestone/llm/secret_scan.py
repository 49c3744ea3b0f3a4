"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger holds which (blob, rule version) pairs have
been scanned and what was found; a scan reads only blobs whose pair isn't in it, each once however many paths hold it, appends the
findings, and joins them back to all paths. The ledger has a row for each scanned pair, with no spans where nothing is found, so clean
blobs aren't scanned again either. A quick test by every rule goes first: of blobs that fail it only the address is shuffled.

A finding is a span of code points, end exclusive, of the leftmost non-overlapping matches of its rule. Rules repeat single characters
or are possessive, so a match needs no stack, however long it is; places are summed in blocks of BLOCK matches, and texts are redacted
in blocks of characters, so very long texts cost their length. Defined results: null text is the empty blob, which has no findings;
repeated rows are paths with equal content; null ids are paths too; extra columns are ignored; an empty table appends nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, fresh


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # fewer code points than this drop the match


#: A private key: through its END line, if no other BEGIN or END comes before that; else the lines of headers and base64 behind the
#: BEGIN line. Line ends may be written as \\n, as in JSON. Possessive throughout, so a long body takes one pass and no stack.
PEM_BEGIN = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_BREAK = r"(?:\s|\\[nrt])++"
_TO_END = r"(?s:(?:(?!-----(?:BEGIN|END) ).)*+)-----END [A-Z ]{0,40}PRIVATE KEY-----"
_HEADERS = rf"(?:{_BREAK}(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Comment):(?:(?!\\n)[^\r\n])*+)*+"
_LINES = rf"(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_BREAK}[A-Za-z0-9+/]++={{0,2}}(?=[\r\n\\\"']|\s*$))*+"
PEM = f"{PEM_BEGIN}(?:{_TO_END}|{_HEADERS}{_LINES})"

RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    # added by the method
    Rule("pem", PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("platform", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})"),
)
#: Changes with RULES: pairs of a blob and another version are scanned anew.
RULE_VERSION = "2026-3"

SPANS = "array<struct<start:int,thru:int,kind:int>>"


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans in a text. Matches and the pieces between them alternate, so their lengths give every place."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("own"), F.transform(measured, lambda x: F.length(x)).alias("counts"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["own"], F.lit(0)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(between) - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, BLOCK))
    nowhere = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    ahead = F.aggregate(blocks, nowhere, lambda acc, x: F.struct((acc["at"] + total(x)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
    many = F.flatten(F.zip_with(blocks, ahead, lambda x, at: _placed(x, at, rule, kind)))
    return F.when(F.size(between) > BLOCK, many).otherwise(_placed(steps, F.lit(0), rule, kind))


#: Running sums append to an array, which copies it; blocks of so many bound that.
BLOCK = 512


def _placed(steps: Column, at: Column, rule: Rule, kind: int) -> Column:
    """Spans of the steps (gap, own, counts) that begin at a place."""
    zero = F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        thru = start + F.coalesce(x["own"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), thru.alias("thru"), F.lit(kind).alias("kind")))
        return F.struct(thru.alias("at"), F.when(x["counts"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, zero, step, lambda acc: acc["spans"])


def quick_test(text: Column, rule: Rule) -> Column:
    """False only where the rule finds nothing."""
    pattern = rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    return text.rlike(pattern)


def suspect(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """False only where no rule finds anything."""
    found = F.lit(False)
    for r in rules:
        found = found | quick_test(text, r)
    return found


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start, then in the order of the rules."""
    none = F.array().cast(SPANS)
    return F.array_sort(F.concat(*(F.when(quick_test(text, r), spans_of(text, r, i)).otherwise(none) for i, r in enumerate(rules))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


class Ledger:
    """Scanned (blob, rule version) pairs and their spans, as an append-only table in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or Scratch(spark, "ledger").path("blobs")
        self.schema = f"blob binary, rule_version string, spans {SPANS}"

    def read(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(self.schema).parquet(self.path)

    def scan_unseen(self, addressed: DataFrame, rule_version: str = RULE_VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans blobs of (blob, text) that the ledger doesn't have under this rule version; gives the ledger's rows of the version."""
        known = self.read()
        unseen = addressed.select("blob", F.when(suspect(F.col("text"), rules), F.col("text")).alias("text"))
        if known is not None:
            unseen = unseen.join(known.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
        unseen = unseen.dropDuplicates(["blob"])
        none = F.array().cast(SPANS)
        found = F.when(F.col("text").isNull(), none).otherwise(scan(F.col("text"), rules))
        unseen.select("blob", F.lit(rule_version).alias("rule_version"), found.alias("spans")).write.mode("append").parquet(self.path)
        return self.read().where(F.col("rule_version") == rule_version)


def content_address(docs: DataFrame) -> DataFrame:
    """Adds the blob of each version (row): the SHA-256 of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("blob", F.unhex(F.sha2(text, 256))).withColumn("text", text)


def findings(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """(columns of docs, blob, spans): every path with what its content holds; spans is empty where there is nothing."""
    addressed = content_address(docs)
    found = ledger.scan_unseen(addressed.select("blob", "text")).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    none = F.array().cast(SPANS)
    return addressed.drop("text").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["thru"].cast("string"))))


#: Texts are redacted in blocks of so many characters: a substring is found by counting from the start.
CHARACTERS = 4096


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start), overlapping ones merged, replaced by the mark."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARACTERS}}}+"), F.lit(0))

    def cut(block: Column, i: Column) -> Column:
        low = i * CHARACTERS
        past = F.array_max(F.transform(F.filter(spans, lambda x: x["start"] < low), lambda x: x["thru"]))
        own = F.filter(spans, lambda x: (x["start"] >= low) & (x["start"] < low + CHARACTERS))
        zero = F.struct(F.greatest(low, past).alias("at"), F.lit("").alias("out"))

        def step(acc, x):
            free = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(block, acc["at"] - low + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["thru"]).alias("at"), free.alias("out"))

        return F.aggregate(own, zero, step, lambda acc: F.concat(acc["out"], F.substring(block, acc["at"] - low + 1, F.lit(CHARACTERS))))

    return F.array_join(F.transform(blocks, cut), "")


#: So many findings and spans may be sent to every executor; with more, rows that hold any are joined by a shuffle.
MOST_FINDINGS, MOST_SPANS = 200_000, 2_000_000


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: every document stays; what the scan finds is replaced by [SECRET] and n_chars counted anew. Clean rows are
    unchanged, and aren't shuffled."""
    blob, spans, text = fresh(docs, "blob"), fresh(docs, "spans"), F.coalesce("text", F.lit(""))
    addressed = docs.withColumn(blob, F.unhex(F.sha2(text, 256)))
    found = Ledger(spark).scan_unseen(addressed.select(F.col(blob).alias("blob"), text.alias("text")))
    found = Scratch(spark, "secrets").table(found.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob]), "found")
    n, most = found.agg(F.count("*"), F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()

    def redacted(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(spans))))
        if "n_chars" in docs.columns:
            kind = docs.schema["n_chars"].dataType
            out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
        return out.select(docs.columns)

    if n <= MOST_FINDINGS and most <= MOST_SPANS:
        return redacted(addressed.join(F.broadcast(found), blob, "left"))
    hit = suspect(text)
    return redacted(addressed.where(hit).join(found, blob, "left")).union(docs.where(~hit))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(documents(spark, sf_dir, "doc_id", "text"), Ledger(spark))
    n = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The spans in DuckDB: matches and the pieces between them, as above."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found, lists = [], []
    for i, r in enumerate(rules):
        found.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, string_split_regex(t, {quoted(r.pattern)}) AS p, {r.least} AS least FROM d")
    total = lambda xs, n: f"coalesce(list_sum(list_transform({xs}[1:{n}], lambda x: length(x))), 0)"
    lists = f"""SELECT doc_id, k, kind, {total('p', 'i')} + {total('m', 'i - 1')} AS a, length(m[i]) AS n, length(g[i]) AS counts, least FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r)"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({' UNION ALL '.join(found)}),
s AS (SELECT doc_id, k, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM ({lists}) WHERE counts >= least),
f AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


#: The SQL is as it was and ends a pem span with the BEGIN line; tables that hold such keys differ from it in `spans` by that.
ORACLE = _oracle(tuple(Rule("pem", PEM_BEGIN) if r.kind == "pem" else r for r in RULES))
