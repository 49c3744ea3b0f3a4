"""Source divergence audit: how far apart the sources of each language are in the terms they use.

Terms are counted in one pass over the texts: numpy sums each batch's terms by (lang, source), so the rows that Spark shuffles and sums are
those of a batch's groups and terms, not of documents and terms. Sums are exact whole numbers. The vocabulary of a language is all terms
with documents enough, with no bound on its size.

A group gives a term with `count` occurrences p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), so all terms that a group doesn't hold have
one p, its ground. The divergence of two groups is a sum of f(p, q) = floor((p - q)^2 / (p + q)) over all V terms:

    V f(ground, ground')  +  what one group's own terms add while the other is at its ground  +  what terms of both add to that

The first two need only how many terms a group holds how often. The third is summed by blocks of terms, each a small dense matrix of
sources by terms, in numpy; only sums by pair of sources leave a block. No pairs of rows are made.

Defined results: null text, lang and source are read as ''; documents without terms make a group all the same; a language without kept
terms has pairs of value 0 and no terms; repeated rows count each; texts of any length are counted whole; of equal values the item of
smaller UTF-8 bytes comes first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, encode_words, gathered, whole_array

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: letters and what isn't ASCII stay, A-Z become small, all else parts terms.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE = 1_000_000_000
#: A block holds some so many terms of one language.
BLOCK = 2048
TOP = 10


def share(count: Column, total: Column, size: Column) -> Column:
    """p of a term; decimals, since a thousand million counts times SCALE is no long."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = (wide(count) + 2).cast("decimal(22,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, (wide(total) + 2 * wide(size)).cast("decimal(24,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def batch_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of documents (text, lang, source): how often each term occurs in a batch's documents of a group,
    and in how many of them. One row for each term of a group and batch."""

    def run(batches):
        for batch in gathered(batches, 0):
            texts = whole_array(batch.column(0))
            _, offsets, data = texts.buffers()
            plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(TO_TERMS))
            codes, terms, starts = encode_words(pa.LargeStringArray.from_buffers(len(texts), offsets, plain), lower=False)
            langs, sources = (batch.column(i).dictionary_encode() for i in (1, 2))
            group = np.asarray(langs.indices, np.int64) * len(sources.dictionary) + np.asarray(sources.indices, np.int64)
            width = max(1, len(terms))
            own, times = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts)) * width + codes, return_counts=True)
            key = group[own // width] * width + own % width
            place = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[place], prepend=-1))
            key, count = key[place][first], np.add.reduceat(times[place], first) if len(first) else times
            group = key // width
            lang, source = (pa.array(x.astype(np.int32)) for x in (group // len(sources.dictionary), group % len(sources.dictionary)))
            yield pa.RecordBatch.from_pydict({
                "lang": langs.dictionary.take(lang),
                "source": sources.dictionary.take(source),
                "term": terms.take(pa.array(key % width)).cast(pa.string()),
                "count": pa.array(count.astype(np.int64)),
                "docs": pa.array(np.diff(first, append=len(place)).astype(np.int64)),
            })

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, count long, docs long")


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, index, term, count) of terms that enough documents of their language hold; index stands for (lang, term)."""
    # dealt by (lang, term), so both sums need one shuffle
    dealt = batch_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).withColumn("row", F.monotonically_increasing_id())
    term = Window.partitionBy("lang", "term")
    held = summed.withColumn("all_docs", F.sum("docs").over(term)).withColumn("index", F.min("row").over(term))
    return held.where(F.col("all_docs") >= least_docs).select("lang", "source", "index", "term", "count")


def in_both(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block's rows (source, index, p, ground): for each pair of sources, what terms that both hold add to the sum."""
    found = []
    sources, at = np.unique(rows["source"].to_numpy(dtype=object).astype(str), return_inverse=True)
    if len(sources) < 2:
        return pd.DataFrame({"lang": [], "source": [], "other": [], "value": []})
    terms, place = np.unique(rows["index"].to_numpy(), return_inverse=True)
    p, ground = np.zeros((len(sources), len(terms)), np.int64), np.zeros((len(sources), 1), np.int64)
    p[at, place], ground[at, 0] = rows["p"].to_numpy(), rows["ground"].to_numpy()
    f = lambda a, b: (a - b) ** 2 // np.maximum(a + b, 1)
    for a in range(len(sources) - 1):
        held = np.flatnonzero(p[a])
        mine, other, low, rest = p[a, held], p[a + 1 :, held], ground[a, 0], ground[a + 1 :]
        added = f(mine, other) - f(mine, rest) - f(low, other) + f(low, rest)
        sums = np.where(other > 0, added, 0).sum(axis=1)
        found.append(pd.DataFrame({"source": sources[a], "other": sources[a + 1 :], "value": sums}))
    all_found = pd.concat(found)
    all_found.insert(0, "lang", rows["lang"].iloc[0])
    return all_found


def divergence(docs: DataFrame, least_docs: int = 10, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source)."""
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = scratch.table(kept_counts(docs, least_docs), "counts")
    scratch.release()
    whole = scratch.table(counts.groupBy("lang", "index").agg(F.sum("count").alias("all")), "terms")
    sizes = whole.groupBy("lang").agg(F.count("*").alias("V"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("N"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["N", "V"])
    ground = F.when(F.col("V") > 0, share(F.lit(0), F.col("N"), F.col("V"))).alias("ground")
    groups = scratch.table(groups.select("lang", "source", "N", "V", ground), "groups")
    held = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("N"), F.col("V")))
    held = scratch.table(held.select("lang", "source", "index", "term", "count", "p", "ground", "V"), "shares")

    # pairs of sources: the result's own size
    other = groups.select("lang", F.col("source").alias("item"), F.col("ground").alias("other_ground"))
    both = groups.join(other, "lang").where(~F.col("source").eqNullSafe(F.col("item"))).select("lang", "source", "item", "V", "ground", "other_ground")
    often = held.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    own = both.join(often, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (apart(F.col("p"), F.col("other_ground")) - apart(F.col("ground"), F.col("other_ground")))).alias("own"))
    own = scratch.table(own, "own")
    block = F.pmod(F.xxhash64("index"), F.greatest(F.lit(1), F.ceil(F.col("V") / BLOCK))).alias("block")
    shared = held.select("lang", "source", "index", "p", "ground", block).groupBy("lang", "block").applyInPandas(in_both, "lang string, source string, other string, value long")
    shared = scratch.table(shared.groupBy("lang", "source", "other").agg(F.sum("value").alias("shared")), "shared")
    sided = shared.select("lang", "source", F.col("other").alias("item"), "shared").union(shared.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "shared"))
    theirs = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("theirs"))
    key = ["lang", "source", "item"]
    value = F.coalesce(F.col("V") * apart(F.col("ground"), F.col("other_ground")), F.lit(0)) + sum(F.coalesce(c, F.lit(0)) for c in ("own", "theirs", "shared"))
    pair = both.join(own, key, "left").join(theirs, key, "left").join(sided, key, "left").select(*key, value.cast("long").alias("value"))

    # terms that a group holds more than its language does
    language = groups.groupBy("lang").agg(F.sum("N").alias("all_N"), F.max("V").alias("lang_V"))
    q = whole.join(F.broadcast(language) if language.count() <= 100_000 else language, "lang").select("index", share(F.col("all"), F.col("all_N"), F.col("lang_V")).alias("q"))
    term = held.select("lang", "source", "index", F.col("term").alias("item"), "p").join(q, "index").where("p > q").select(*key, apart(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return ranked(pair, "pair").union(ranked(term, "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir, "text", "lang", "source"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS V FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT o.lang, o.source, coalesce(x.N, 0) AS N, coalesce(s.V, 0) AS V FROM (SELECT DISTINCT lang, source FROM d) o
  LEFT JOIN (SELECT lang, source, sum(n) AS N FROM c GROUP BY lang, source) x ON o.lang = x.lang AND o.source = x.source LEFT JOIN sizes s ON o.lang = s.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (g.N + 2 * g.V) AS BIGINT) AS p
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT a.lang, a.term, CAST(1 + (1000000000 * (CAST(a.n AS HUGEINT) + 2)) // (b.N + 2 * b.V) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) a
  JOIN (SELECT lang, sum(N) AS N, max(V) AS V FROM g GROUP BY lang) b ON a.lang = b.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(z.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) FROM term)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
