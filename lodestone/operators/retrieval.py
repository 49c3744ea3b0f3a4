"""Search over a catalogue: lexical tiers, orders, vector search, fusion and round robin (R-1 to R-5, T1-T6, W2-W5, F14, F22)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import rank_share

#: Orders of a result; each ends in the key, so none is left to chance.
DEMAND = ("apply_count", "view_count")


def clamp(limit: int | None) -> int:
    """20 unless given, 100 at most."""
    return min(100, limit) if limit and limit > 0 else 20


def scored(entries: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Adds matched and in_title: a term in title, organisation or category counts for both, one in the description for the first."""
    name = F.lower(F.concat_ws(" ", "title", "org", "category"))
    desc = F.lower(F.coalesce("description", F.lit("")))
    in_name = [F.contains(name, F.lit(t)) for t in terms]
    in_desc = [F.contains(desc, F.lit(t)) for t in terms]
    zero = F.lit(0)
    matched = sum((F.when(a | b, 1).otherwise(0) for a, b in zip(in_name, in_desc)), zero)
    return entries.withColumn("matched", matched).withColumn("in_title", sum((F.when(a, 1).otherwise(0) for a in in_name), zero))


def order_by(kind: str) -> list[Column]:
    demand = [F.desc(c) for c in DEMAND] + [F.asc("pk")]
    relevance = [F.desc(F.col("matched") + 2 * F.col("in_title")), F.desc("in_title"), F.desc("matched")]
    return relevance + ([F.desc("modified_at")] if kind == "recent" else []) + demand


def with_rank(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows with their rank from 1: a top-k first, so the ranking window sees `limit` rows only."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def tiered(found: DataFrame, terms: Sequence[str], order: Sequence[Column], limit: int, planned: bool = False) -> DataFrame:
    """The first of the entries with all terms if there is one, else of those with any (`relaxed`, only for more than one term; R-1,
    R-2). Entries with all terms go first, so one pass tells which it is: if the first has all, the others that don't are dropped."""
    n = len(terms)
    if not n:
        return with_rank(found, order, limit).withColumn("relaxed", F.lit(False))
    least = (n + 1) // 2 if planned and n >= 3 else 1
    strict = F.col("matched") == n
    top = with_rank(found.where(F.col("matched") >= (least if n > 1 else 1)), [F.desc(strict), *order], limit)
    any_strict = F.max(strict).over(Window.partitionBy())
    return top.withColumn("relaxed", ~any_strict).where(F.col("relaxed") | strict)


def lexical(entries: DataFrame, terms: Sequence[str], limit: int | None = None, ranking: str = "demand", planned: bool = False, rest_only: bool = False) -> DataFrame:
    """Ranked hits by demand, by date, or balanced (both lists in turn, T4); of services that can be called only, if so asked."""
    limit = clamp(limit)
    found = scored(entries.where("svc_type = 'REST'") if rest_only else entries, terms)
    if ranking != "balanced":
        return tiered(found, terms, order_by(ranking), limit, planned)
    lists = [tiered(found, terms, order_by(kind), limit, planned).withColumn("bucket", F.lit(i)) for i, kind in enumerate(("demand", "recent"))]
    return round_robin(lists[0].unionByName(lists[1]), limit)


def round_robin(ranked: DataFrame, limit: int) -> DataFrame:
    """Hits of several ranked lists in turn (columns bucket, rank, pk); a pk counts where it first comes."""
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("pk").orderBy("rank", "bucket"))).where("_n = 1").drop("_n")
    order = [F.asc("rank"), F.asc("bucket"), F.asc("pk")]
    top = first.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def planned(entries: DataFrame, axes: Sequence[tuple[str, Sequence[str]]], limit: int | None = None) -> DataFrame:
    """Up to eight axes (role, terms), each searched on its own, in turn (R-3)."""
    limit = clamp(limit)
    if not 1 <= len(axes) <= 8:
        raise ValueError("1 to 8 axes")
    lists = None
    for i, (role, terms) in enumerate(axes):
        one = lexical(entries, terms, max(limit, 3), planned=True).withColumns({"bucket": F.lit(i), "role": F.lit(role)})
        lists = one if lists is None else lists.unionByName(one)
    return round_robin(lists, limit)


#: Vectors are multiplied block by block; a block of queries or vectors has some so many rows.
BLOCK_ROWS = 2048


def _blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, vec) packed some BLOCK_ROWS to a row."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return rows.groupBy(F.pmod(F.xxhash64("pk"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(*keys, "vec")).alias("rows")).select("rows")


def vector_top(vectors: DataFrame, queries: DataFrame, limit: int, demand: Sequence[str] = ()) -> DataFrame:
    """(query, pk, score, rank): cosine top-k of unit vectors for a set of queries, by score, then demand, then key (R-4, T5). Both have
    (pk, vec) of one length, the vectors the demand columns too.

    Blocks of queries meet blocks of vectors, and each pair of blocks keeps `limit` rows per query."""
    asked = _blocks(queries.select("pk", "vec"), ["pk"]).withColumnRenamed("rows", "asked")
    held = _blocks(vectors.select("pk", *demand, "vec"), ["pk", *demand])
    kind = vectors.schema["pk"].dataType.simpleString()
    fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in demand)

    def matrix(rows: pa.StructArray) -> np.ndarray:
        flat = rows.field("vec").flatten()
        return np.asarray(flat, np.float64).reshape(len(rows), -1)

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = batch.column("asked")[i].values, batch.column("rows")[i].values
                scores = np.einsum("ij,kj->ik", matrix(mine), matrix(theirs))
                keys = [np.asarray(theirs.field(c).to_pylist()) for c in demand]
                names = np.asarray(theirs.field("pk").to_pylist())
                # by score, and of equal ones by demand and key; the last key of lexsort leads
                order = np.lexsort((names, *(-k for k in reversed(keys)))) if len(names) else np.zeros(0, np.int64)
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :limit]]
                row = np.repeat(np.arange(len(mine)), best.shape[1])
                col = best.reshape(-1)
                yield pa.RecordBatch.from_arrays([mine.field("pk").take(pa.array(row)), theirs.field("pk").take(pa.array(col)), pa.array(scores[row, col]), *(theirs.field(c).take(pa.array(col)) for c in demand)], ["query", "pk", "score", *demand])

    found = asked.crossJoin(held).mapInArrow(search, ", ".join(filter(None, [f"query {kind}, pk {kind}, score double", fields])))
    order = Window.partitionBy("query").orderBy(F.desc("score"), *(F.desc(c) for c in demand), "pk")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fuse(lexical_hits: DataFrame, semantic_hits: DataFrame, offset: int = 60, weight: float = 4.0) -> DataFrame:
    """(pk, score, axis, exact, position): reciprocal ranks of both lists (pk, position, bucket and exact or score) added, the semantic
    ones times weight and score where above 0 (F22). The axis is the lexical hit's, else the semantic one's."""
    a = lexical_hits.select("pk", rank_share(F.col("position"), 1.0, offset).alias("share"), F.col("bucket").alias("a"), F.lit(None).cast("int").alias("b"), "exact", "position")
    share = F.when(F.col("score") > 0, rank_share(F.col("position"), weight, offset) * F.col("score")).otherwise(0.0)
    b = semantic_hits.select("pk", share.alias("share"), F.lit(None).cast("int").alias("a"), F.col("bucket").alias("b"), F.lit(False).alias("exact"), F.lit(None).cast("int").alias("position"))
    both = a.unionByName(b).groupBy("pk").agg(F.sum("share").alias("score"), F.max("a").alias("a"), F.max("b").alias("b"), F.max("exact").alias("exact"), F.max("position").alias("position"))
    return both.select("pk", "score", F.coalesce("a", "b").alias("axis"), "exact", "position")


def hybrid(entries: DataFrame, axes: Sequence[tuple[str, Sequence[str]]], vectors: DataFrame, questions: DataFrame, limit: int | None = None) -> DataFrame:
    """(pk, score, position): lexical and vector search over the axes, fused (R-5). questions are (pk, vec), pk the axis from 0.

    Both searches go wider than asked (four times, 40 at least). Fused hits are ordered by score, then demand (T6); each axis puts its
    earliest exact lexical hit first (W4), then its others, and the axes take turns, after them hits of none."""
    want = clamp(limit)
    wide = clamp(max(40, 4 * want))
    words = planned(entries, axes, wide).withColumn("exact", ~F.col("relaxed"))
    near = vector_top(vectors, questions, wide, DEMAND).withColumn("bucket", F.col("query").cast("int"))
    fused = fuse(words, round_robin(near, wide))
    fused = fused.join(entries.select("pk", *DEMAND), "pk")
    order = [F.desc("score"), *(F.desc(c) for c in DEMAND), F.asc("pk")]
    first = F.min(F.when(F.col("exact"), F.col("position"))).over(Window.partitionBy("axis"))
    fused = fused.withColumn("kept", F.coalesce(F.col("exact") & (F.col("position") == first), F.lit(False)))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("kept"), *order))).drop("position").withColumnRenamed("axis", "bucket")
    return round_robin(ranked, want).select("pk", "score", "position")


def hit_at(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(pk, max_rank, rank, hit): whether expected keys are ranked as high as asked."""
    return expected.join(hits.select("pk", "rank"), "pk", "left").withColumn("hit", F.coalesce(F.col("rank") <= F.col("max_rank"), F.lit(False)))


def best_per_role(options: DataFrame, most: int = 3) -> DataFrame:
    """Each node once, in its first role; then the best `most` of each role (W5). Columns role, node, rank."""
    once = options.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("rank", "role"))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("rank", "node"))).where(F.col("place") <= most)
