"""Document fingerprints by MinHash.

A text's shingles of five words are hashed once and then permuted by multiply-add universal hashing, all in numpy; the minima of the
permutations are the signature. The share of equal minima of two signatures estimates the Jaccard similarity of the shingle sets.
Classes of near copies come from the exact join of the shingle sets (see partenum), so any two near copies have the same class, the
least doc_id that links reach, whether or not minima of theirs agree.

Defined results: a null text is the empty text; texts without words have no shingles and share one signature, whose likeness to each
other is 1 and to all others 0; fewer than five words are one shingle; repeated rows have equal fingerprints and follow each other
in the order of ids; a row with a null id comes first in that order and has no class; texts without words are their own class; rows
that repeat an id share a class; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, Scratch, documents, letting_go, mix64, rolled_words, shingle_sets, shingles_of, sliced, small_table, text_batches
from .partenum import MOST_BROADCAST, joined_groups, marked_sets, sampled_order, set_arrays, with_sets

PERMUTATIONS, WORDS = 128, 5
EMPTY = np.uint32(0xFFFFFFFF)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * MIX)
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS, most: int = 8192) -> np.ndarray:
    """(texts, permutations) minima of 32 bits; sets without shingles have all bits set. Some `most` shingles are permuted at once, one
    permutation after the other, so that they stay near the processor; the upper halves are taken of the minima."""
    a, b = _coefficients(permutations)
    least = np.full((len(sets), permutations), ~np.uint64(0), np.uint64)
    filled = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    ends = np.cumsum([0] + [len(sets[i]) for i in filled.tolist()])
    k = 0
    with np.errstate(over="ignore"):
        while k < len(filled):
            m = max(k + 1, int(np.searchsorted(ends, ends[k] + most, side="right")) - 1)
            flat, starts = np.concatenate([sets[i] for i in filled[k:m].tolist()]), ends[k:m] - ends[k]
            permuted, minima = np.empty(len(flat), np.uint64), np.empty((permutations, m - k), np.uint64)
            for p in range(permutations):
                np.multiply(flat, a[p], out=permuted)
                np.add(permuted, b[p], out=permuted)
                np.minimum.reduceat(permuted, starts, out=minima[p])
            least[filled[k:m]] = minima.T
            k = m
    return (least >> np.uint64(32)).astype(np.uint32)


def edited_end(text: str, following: str, words: int) -> tuple[bytes, bytes, int]:
    """The edited text in UTF-8, the end of it that holds all its shingles but the first ones of the text, and how many those are.

    A shingle that ends before the last word ahead of the cut is the same in both texts; the word at the cut may become longer."""
    n = len(text) // 4
    head, new = (x.encode("utf-8", "surrogatepass") for x in (text[: len(text) - n], following[:n]))
    cut = head.rsplit(None, words)
    if len(cut) <= words:
        return head + new, head + new, 0
    whole = text.encode("utf-8", "surrogatepass")
    return head + new, head[len(cut[0]) :] + new, len(whole[len(cut[0]) :].split())


def text_of(signature: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row; a set without shingles is like another such set only."""
    return np.where((a == EMPTY).all(1) == (b == EMPTY).all(1), (a == b).mean(1), 0.0)


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint) of documents (doc_id, text)."""

    def run(batches):
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array(text_of(signatures(shingle_sets(batch.column(1), words), permutations)), pa.string())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_order_with_next(docs: DataFrame, partitions: int, columns: list[str]) -> DataFrame:
    """Rows in runs of ascending doc_id: (run, doc_id, columns, sentinel). Every run ends with a sentinel, the first row of the next
    run (of the first run, after the last), so the successor of each row is the row that follows it. Runs are ranges between
    quantiles of the ids, so they are even and none depends on how Spark places them."""
    keyed = docs.select(F.col("doc_id").cast("long"), *columns)
    cuts = keyed.agg(F.percentile_approx("doc_id", [i / partitions for i in range(1, partitions)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    number = F.lit(0)
    if cuts:
        # a binary search over the cuts, as an expression
        def find(low: int, high: int):
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.col("doc_id") <= cuts[mid], find(low, mid)).otherwise(find(mid + 1, high))

        number = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(find(0, len(cuts)))
    keyed = keyed.withColumn("run", number)
    firsts = {r.run: None if r.nulls else r.id for r in keyed.groupBy("run").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()}
    if not firsts:
        return keyed.withColumn("sentinel", F.lit(False))
    runs = sorted(firsts)
    before = {r: runs[i - 1] for i, r in enumerate(runs)}
    follows = small_table(docs.sparkSession, [(firsts[r], before[r]) for r in runs], "doc_id long, before int")
    firsts_only = keyed.join(F.broadcast(follows), keyed.doc_id.eqNullSafe(follows.doc_id)).drop(follows.doc_id)
    least = firsts_only.groupBy("before").agg(F.min_by(F.struct("doc_id", *columns), F.struct(*columns)).alias("r"))
    sentinels = least.select("r.*", F.col("before").alias("run"), F.lit(True).alias("sentinel")).select(*keyed.columns, "sentinel")
    return keyed.withColumn("sentinel", F.lit(False)).union(sentinels)


def edited_fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents (doc_id, text).

    The edited text has its last quarter replaced by as much of the beginning of the next document by id."""
    spark = docs.sparkSession
    text_batches(spark)
    partitions = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = in_order_with_next(docs, partitions, ["text"])
    rows = rows.repartition(partitions, "run").sortWithinPartitions("run", "sentinel", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        carried = None
        for batch in sliced(batches, 1):
            if carried is not None:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            carried = batch.slice(batch.num_rows - 1, 1)
            texts, runs = batch.column(1).to_pylist(), np.asarray(batch.column(2))
            own = np.flatnonzero(runs[1:] == runs[:-1]) if len(runs) > 1 else np.zeros(0, np.int64)
            own = own[~np.asarray(batch.column(3).cast(pa.uint8()), bool)[own]]
            if not len(own):
                continue
            # a text and its edited one begin alike: what they share is split into words and permuted once, and repeats don't change a minimum
            edited = [edited_end(texts[i], texts[i + 1], words) for i in own.tolist()]
            named, codes, starts, rolled = rolled_words(batch.column(1), words)
            before = shingles_of(named, codes, starts, rolled, words)
            after = shingles_of(*rolled_words(pa.array([x[1] for x in edited], pa.large_binary()).cast(pa.large_string()), words), words)
            same = np.zeros(len(before), np.int64)
            same[own] = [size - x[2] if x[2] else 0 for x, size in zip(edited, np.diff(starts)[own].tolist())]
            alike = signatures([x[:k] for x, k in zip(before, same)], permutations)
            marks = np.minimum(alike, signatures([x[k:] for x, k in zip(before, same)], permutations))
            changed = np.minimum(alike[own], signatures(after, permutations))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).take(pa.array(own)),
                "n_chars": pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x[0]).hexdigest() for x in edited]),
                "fingerprint": pa.array(text_of(marks[own])),
                "edited_fingerprint": pa.array(text_of(changed)),
                "near_edited": pa.array(likeness(marks[own], changed)),
                "near_next": pa.array(likeness(marks[own], marks[own + 1])),
            })

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_groups(scratch: Scratch, docs: DataFrame, least: Fraction, words: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, root, component) of documents (id, text) and the links (a, b) that make the components."""
    keyed = docs.select("id", F.lit(0).cast("long").alias("mark"), "text")
    marked = scratch.table(marked_sets(keyed, words, least, sampled_order(scratch, keyed, words)), "marked")
    return joined_groups(scratch, docs, marked, words, least)


def near_copies(docs: DataFrame, least: float = 0.8, words: int = WORDS) -> DataFrame:
    """(a, b, jaccard): verified links that hold each class of near copies together."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    links = scratch.table(near_groups(scratch, docs, Fraction(str(least)), words)[1], "links")
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    sets = scratch.table(set_arrays(docs.join(ids, "id", "left_semi"), words).dropDuplicates(["id"]).withColumnRenamed("id", "key"), "sets")
    shared = F.size(F.array_intersect("xs", "ys"))
    return with_sets(links, sets).select("a", "b", (shared / (F.size("xs") + F.size("ys") - shared)).alias("jaccard"))


def near_classes(docs: DataFrame, least: Fraction = Fraction(4, 5), words: int = WORDS) -> DataFrame:
    """(doc_id, class_id) of the documents (doc_id, text) whose class is another's id."""
    scratch, result = Scratch(docs.sparkSession, "near-copies"), Scratch(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    with letting_go(docs.sparkSession):
        found, _ = near_groups(scratch, docs, least, words)
    classes = result.table(found.where("id != component").groupBy("id").agg(F.min("component").alias("class_id")).withColumnRenamed("id", "doc_id"), "classes")
    scratch.clear()
    return classes


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    classes = near_classes(docs)
    with letting_go(spark):
        few = classes.count() <= MOST_BROADCAST
    marked = edited_fingerprints(docs).join(F.broadcast(classes) if few else classes, "doc_id", "left")
    return marked.withColumn("class_id", F.coalesce("class_id", "doc_id"))
