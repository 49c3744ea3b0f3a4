"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record is a header block, an empty line, the payload and two line ends, so the text writer with those line ends as its
separator makes valid archives. Payloads of at least `least_bytes` that equal an earlier page's become revisit records. Archives are
gzip files of so many records, each one split; uncompressed ones are cut into splits wherever they fall.

Reading: archives are cut at every occurrence of the version line, wherever file splits fall, so a task sees candidates: real record
starts, and version lines that payloads hold. Each candidate's header tells how long its record is, and so where its successor
starts. A place is a record only if the chain of successors from the start of its file reaches it; pointer jumping finds the reached
places in as many rounds as the logarithm of the records in a file. What payloads hold is never reached, since chains step over it.

Tasks emit numbers and header fields, and what the caller derives from payloads (the payload itself, or a digest of it); the text
stays in the task that reads it. Only files with payloads that hold version lines are read again, and those payloads put together.
Places are running sums of the pieces' bytes: within a split, and over the splits of a file. Each reading is written as a table before
its pieces are numbered, and what two readings tell is joined by (file, place) alone, so they may cut the files into other splits; a
payload whose pieces aren't all found again is an error.

Defined results: null html is the empty payload; repeated rows are records each, and of rows with the same page_id and payload the one
with the least url (of equal ones any one) answers, the others revisit it; a null page_id is written as an empty id and read as null,
and answers only if all pages with its payload are without id; line ends in urls are percent-encoded; very long texts are records like
others; extra columns are ignored; an empty table gives no records. In a broken archive the chain ends at the first header that
doesn't say how long its record is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

VERSION = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
#: So many payloads that several pages share (some 60 bytes each) may be sent to every executor; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32 without padding: 160 bits are 32 digits of 5."""
    digest = F.sha1(data)
    digits = []
    for i in range(4):
        part = F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(BASE32), (F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*digits)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, bytes, revisit, refers_to): what is to be written for pages (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    scratch = Scratch(pages.sparkSession, "archives")
    ids = rows.groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("n"))
    alike = ids.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("page_id").isNull(), F.col("n"))).alias("nameless"), F.min_by("n", "page_id").alias("named"))
    alike = scratch.table(alike.where("n > 1").select("digest", "bytes", "first", F.when(F.col("first").isNull(), F.col("nameless")).otherwise(F.col("named")).alias("ties")), "alike")
    rows = rows.join(F.broadcast(alike) if alike.count() <= MOST_BROADCAST else alike, ["digest", "bytes"], "left")
    held = (F.col("bytes") >= least_bytes) & F.col("ties").isNotNull()
    leads = F.col("page_id").eqNullSafe(F.col("first"))
    columns = ["page_id", "url", "payload", "digest", "bytes"]
    if alike.where((F.col("ties") > 1) & (F.col("bytes") >= least_bytes)).isEmpty():
        revisit = held & ~leads
        return rows.select(*columns, revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    tied = held & leads & (F.col("ties") > 1)
    others = rows.where(~F.coalesce(tied, F.lit(False)))
    others = others.select(*columns, (held & ~leads).alias("revisit"), F.when(held & ~leads, F.col("first")).alias("refers_to"))
    several = rows.where(tied).groupBy("page_id", "url", "digest", "bytes").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    several = several.withColumn("place", F.row_number().over(Window.partitionBy("digest", "bytes").orderBy("url")))
    several = several.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    again = (F.col("place") > 1) | (F.col("copy") > 1)
    return others.union(several.select(*columns, again.alias("revisit"), F.when(again, F.col("page_id")).alias("refers_to")))


#: What ends a line for some reader or other, and how a url has it.
LINE_ENDS = {"\r": "%0D", "\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\x85": "%C2%85", "\u2028": "%E2%80%A8", "\u2029": "%E2%80%A9"}


def write(rows: DataFrame, path: str, records_per_file: int = 4096, compression: str = "gzip") -> None:
    """Writes records as archives, by default each a gzip file; uncompressed ones (none) are split when they are read."""
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    url = F.col("url")
    for end, code in LINE_ENDS.items():
        url = F.replace(url, F.lit(end), F.lit(code))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), page("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), page("refers_to"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), body)
    rows.select(record).write.option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def field(header: Column, name: str) -> Column:
    """A header's value; only line feeds end its lines."""
    return F.nullif(F.regexp_extract(header, rf"(?imd)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def number(text: Column) -> Column:
    return text.try_cast("long")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(f, split, n, piece): what follows each version line, up to the next one. f stands for the file; n orders the pieces of a
    split. Splits and n hold for one reading only: how files are cut depends on cores and settings of the moment."""
    read = spark.read.option("lineSep", VERSION).text(path)
    return read.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("piece"))


def parsed(pieces: DataFrame, derived: dict) -> DataFrame:
    """(f, split, n, size, ahead, length, held, the header's fields, derived): numbers of candidates. `ahead` is where the body starts,
    `held` how much of it the piece has; what is derived from payloads is null where the piece holds less than its header says."""
    header = F.substring_index("piece", BREAK, 1)
    rows = pieces.withColumn("header", header).withColumn("size", F.octet_length("piece").cast("long") + len(VERSION))
    rows = rows.withColumn("ahead", F.octet_length("header").cast("long") + len(VERSION) + len(BREAK)).withColumn("held", F.col("size") - F.col("ahead"))
    rows = rows.withColumn("length", F.when(F.col("held") >= 0, number(field(F.col("header"), "Content-Length").substr(1, 15))))
    body = F.expr(f"substring(cast(piece as binary), cast(ahead as int) - {len(VERSION) - 1}, cast(length as int))")
    page = lambda name: number(F.regexp_extract(field(F.col("header"), name), r"<urn:page:(-?\d+)>", 1))
    fields = [
        field(F.col("header"), "WARC-Type").alias("type"), page("WARC-Record-ID").alias("page_id"), field(F.col("header"), "WARC-Target-URI").alias("url"),
        F.regexp_replace(field(F.col("header"), "WARC-Payload-Digest"), "^sha1:", "").alias("digest"), number(field(F.col("header"), "WARC-Payload-Length")).alias("payload_bytes"), page("WARC-Refers-To").alias("refers_to"),
    ]
    return rows.select("f", "split", "n", "size", "ahead", "length", "held", *fields, *(F.when(F.col("held") >= F.col("length"), make(body)).alias(c) for c, make in derived.items()))


def running(rows: DataFrame, amount: Column, gather, name: str) -> DataFrame:
    """Adds what `gather` (a sum or a maximum) makes of the amounts before each piece of its file: in its split, and in those before."""
    inside = gather(amount).over(Window.partitionBy("f", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    splits = rows.groupBy("f", "split").agg(gather(amount).alias("_all"))
    before = gather("_all").over(Window.partitionBy("f").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("f", "split", before.alias("_before"))
    return rows.withColumn("_inside", inside).join(splits, ["f", "split"]).withColumnRenamed("_inside", f"{name}_inside").withColumnRenamed("_before", f"{name}_before")


def reached(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(f, at) of the places that the chain from place 0 of a file reaches, over links (f, at, next)."""
    found = scratch.table(links.where("at = 0").select("f", "at"), "reached")
    jumps = scratch.table(links.where("next is not null").select("f", "at", "next"), "jumps")
    while True:
        step = found.join(jumps, ["f", "at"]).select("f", F.col("next").alias("at"))
        more = scratch.table(found.union(step), "reached")
        ahead = jumps.select("f", F.col("at").alias("next"), F.col("next").alias("after"))
        longer = scratch.table(jumps.join(ahead, ["f", "next"]).select("f", "at", F.col("after").alias("next")), "jumps")
        scratch.drop(found)
        scratch.drop(jumps)
        found, jumps = more, longer
        if jumps.isEmpty():
            return found


def placed(pieces: DataFrame, *columns: str) -> DataFrame:
    """(f, split, n, at, columns) of one reading's pieces: `at` is the place of the version line before each. The first piece of a file is
    what stands before its first version line."""
    key = ["f", "split", "n"]
    summed = running(pieces.select(*key, "size", *columns), F.col("size"), F.sum, "sum")
    at = F.coalesce("sum_before", F.lit(0)) + F.coalesce("sum_inside", F.lit(0)) - len(VERSION)
    return summed.select(*key, at.alias("at"), *columns).where("at >= 0")


def read(spark: SparkSession, path: str, derived: dict | None = None) -> DataFrame:
    """(type, page_id, url, digest, payload_bytes, refers_to, derived) of every record of the archives below a path.

    `derived` names columns and how each is made of a record's payload (binary); the payload itself unless it says otherwise."""
    derived = derived or {"payload": lambda body: body}
    scratch = Scratch(spark, "warc")
    texts = candidates(spark, path)
    pieces = scratch.table(parsed(texts, derived), "pieces")
    told = ["type", "page_id", "url", "digest", "payload_bytes", "refers_to"]
    key = ["f", "split", "n"]
    links = scratch.table(placed(pieces, "ahead", "length", "held").withColumn("next", F.col("at") + F.col("ahead") + F.col("length") + len(BREAK)), "links")
    starts = scratch.table(links.join(reached(scratch, links), ["f", "at"]), "starts")
    whole = starts.where("held >= length").select(*key).join(pieces, key).select(*told, *derived)
    cut = scratch.table(starts.where("held < length").select("f", "at", "length"), "cut")
    if cut.isEmpty():
        return whole
    # pieces that aren't starts belong to the payload of the start before them
    files = cut.select("f").distinct()
    near = links.join(files, "f", "left_semi").join(starts.select("f", "at", F.lit(True).alias("real")), ["f", "at"], "left")
    owned = running(near, F.when(F.col("real"), F.col("at")), F.max, "start").withColumn("owner", F.when(F.col("real"), F.col("at")).otherwise(F.coalesce("start_inside", "start_before")))
    parts = scratch.table(owned.select("f", "at", "owner").join(cut.select("f", F.col("at").alias("owner"), "length"), ["f", "owner"]), "parts")
    small = lambda rows: F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows
    again = scratch.table(texts.join(small(files), "f", "left_semi"), "again")
    texts = again.join(placed(again.withColumn("size", F.octet_length("piece").cast("long") + len(VERSION))).join(small(parts), ["f", "at"]), key)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x.piece), VERSION)  # the pieces of one payload
    full = texts.groupBy("f", "owner", "length").agg(joined.alias("all"), F.count("*").alias("found"))
    body = F.expr(f"substring(cast(all as binary), octet_length(substring_index(all, '\\r\\n\\r\\n', 1)) + {len(BREAK) + 1}, cast(length as int))")
    made = full.select("f", F.col("owner").alias("at"), "found", *(make(body).alias(c) for c, make in derived.items()))
    wanted = parts.groupBy("f", F.col("owner").alias("at")).agg(F.count("*").alias("wanted"))
    fields = starts.where("held < length").select(*key, "at").join(pieces.select(*key, *told), key).join(wanted, ["f", "at"])
    lost = F.when(F.coalesce("found", F.lit(0)) != F.col("wanted"), F.raise_error(F.lit("a payload was not found again; were the archives changed?")).cast("int"))
    fields = fields.join(made, ["f", "at"], "left").where(lost.isNull())
    return whole.union(fields.select(*told, *derived))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "archives").path("warc")
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), archives)
    found = read(spark, archives, {"own_bytes": lambda body: F.octet_length(body).cast("long"), "own_digest": base32_sha1})
    response = F.col("type") == "response"
    # of responses what is said is what the payload itself gives
    size = F.when(response, F.col("own_bytes")).otherwise(F.col("payload_bytes"))
    digest = F.when(response, F.col("own_digest")).otherwise(F.col("digest"))
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: DuckDB has no base32, so its digits are looked up.
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url) AS place,
  array_to_string([array_to_string([substr('{BASE32}', CAST((CAST('0x' || substr(x, 10 * i + 1, 10) AS BIGINT) >> (35 - 5 * j)) & 31 AS INT) + 1, 1) for j in range(8)], '') for i in range(4)], '') AS digest FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to FROM q
"""
