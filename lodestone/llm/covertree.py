"""Exact top-k inner-product search with two cover trees.

Data and queries are both indexed. The upper levels are a tree of pivots, chosen farthest-first from a bounded sample (`PIVOT_SAMPLE`),
FANOUT to a node, with as many leaves as the data has blocks; every vector goes down to the nearest pivot, level by level. A leaf's
vectors are dealt into blocks of bounded size, however many are alike. Below, each block has a cover tree: a node's children have
centres that are farther apart than a covering distance and cover its points within it; children of few points share a leaf. Trees are
built once and kept as a table, and every node of the upper levels has a centre and the radius that covers all below it.

A pair of a query node and a data node can score at most <cq, cp> + rq |cp| + rp |cq| + rq rp with centres c and covering radii r. It
is dropped if that is below the worst k-th score among the node's queries; of equal scores the smaller id wins, so equal bounds stay.
Every query group first goes down to the block with the greatest bounds, which gives it k-th scores. Then it goes down level by level
to all nodes that these scores don't rule out, so a pair of a group and a block is made only if none of the nodes above was pruned.
Pairs are searched block by block: a task reads a block's tree once, for up to GROUPS_AT_ONCE query groups. The best k of every block
meet in a ranking per query.

Defined results: vectors that are null, hold null or non-finite components, or have another length than most, take no part, nor do
rows without an id; rows with the query's own id are no candidates; repeated rows are candidates each (each has its rank); extra
columns are ignored; an empty table, or one without queries, gives none. Component products must sum to less than 2**53. Without
clusters (random directions in many dimensions) no bound rules anything out, and all pairs of blocks are searched.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

PIVOT_SAMPLE, FANOUT = 65_536, 32
BLOCK_ROWS, GROUP_ROWS, LEAF, GROUPS_AT_ONCE = 4096, 512, 128, 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows (vec_id, v array<double>) that take part."""
    whole = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = vectors.where(F.coalesce(whole, F.lit(False)))
    usual = found.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return found.where(F.size("v") == (usual["n"] if usual else 0))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each pivot is the point farthest from those before it."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class CoverTree:
    """Nodes as arrays: centre, radius, the range of points below, and the range of children (none for a leaf)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.nodes: list[list] = []  # [centre, radius, first point, end, first child, end]
        order: list[np.ndarray] = []
        queue = [(np.arange(len(points)), points.mean(0))]
        # breadth first, so children of a node are next to each other; points are put in order of the leaves at the end
        leaves: dict[int, np.ndarray] = {}
        at = 0
        while at < len(queue):
            own, centre = queue[at]
            away = np.sqrt(((points[own] - centre) ** 2).sum(1))
            node = [centre, float(away.max()) if len(own) else 0.0, 0, 0, 0, 0]
            self.nodes.append(node)
            if len(own) <= leaf or node[1] == 0:
                leaves[at] = own
            else:
                groups = self.cover(own, points, away, node[1], leaf)
                node[4], node[5] = len(queue), len(queue) + len(groups)
                queue += groups
            at += 1
        count = 0

        def lay(i: int) -> None:
            nonlocal count
            stack = [(i, False)]
            while stack:
                j, done = stack.pop()
                node = self.nodes[j]
                if j in leaves:
                    node[2] = count
                    order.append(leaves[j])
                    count += len(leaves[j])
                    node[3] = count
                elif done:
                    node[2], node[3] = self.nodes[node[4]][2], self.nodes[node[5] - 1][3]
                else:
                    stack.append((j, True))
                    stack += [(c, False) for c in range(node[5] - 1, node[4] - 1, -1)]

        lay(0)
        placed = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.points = ids[placed], points[placed]
        self.norms = [float(np.sqrt((n[0] ** 2).sum())) for n in self.nodes]

    @staticmethod
    def cover(own: np.ndarray, points: np.ndarray, away: np.ndarray, radius: float, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Splits points among centres farther apart than the covering distance; what small children hold is put into leaves."""
        near, small, out = radius / 1.6, [], []
        left = own[np.argsort(-away, kind="stable")]
        while len(left):
            centre = points[left[0]]
            inside = ((points[left] - centre) ** 2).sum(1) <= near * near
            group, left = left[inside], left[~inside]
            if 2 * len(group) <= leaf:
                small.append(group)
                if len(small) > 64 and not out:  # points that don't cluster: cut what is left as it comes
                    small.append(left)
                    break
            else:
                out.append((group, centre))
        rest = np.concatenate(small) if small else np.zeros(0, np.int64)
        for a in range(0, len(rest), leaf):
            part = rest[a : a + leaf]
            out.append((part, points[part].mean(0)))
        if len(out) == 1:  # all within the covering distance of one: halve, so children are smaller than the node
            group = out[0][0]
            middle = len(group) // 2
            out = [(g, points[g].mean(0)) for g in (group[:middle], group[middle:])]
        return out


def bound(q: CoverTree, i: int, p: CoverTree, j: int) -> float:
    a, b = q.nodes[i], p.nodes[j]
    # a hair more than the sum, for rounding
    return float(a[0] @ b[0]) + a[1] * p.norms[j] + b[1] * q.norms[i] + a[1] * b[1] + 1e-6 * (1 + q.norms[i] * p.norms[j])


def search(q: CoverTree, p: CoverTree, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best k of the block, as far as they reach its given k-th score; -inf and -1 where fewer do."""
    scores, ids = np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), np.iinfo(np.int64).max)
    floor = worst.copy()
    stack = [(bound(q, 0, p, 0), 0, 0)]
    while stack:
        most, i, j = stack.pop()
        a, b = q.nodes[i], p.nodes[j]
        if most < floor[a[2] : a[3]].min():
            continue
        if a[4] == a[5] and b[4] == b[5]:
            rows = slice(a[2], a[3])
            found = q.points[rows] @ p.points[b[2] : b[3]].T
            own = p.ids[b[2] : b[3]]
            found = np.where((own[None, :] == q.ids[rows][:, None]) | (found < floor[rows][:, None]), -np.inf, found)
            hit = np.flatnonzero(found.max(1) > -np.inf) if found.size else []
            if len(hit):
                at = hit + a[2]
                both = np.concatenate([scores[at], found[hit]], axis=1)
                names = np.concatenate([ids[at], np.broadcast_to(own, (len(hit), len(own)))], axis=1)
                best = np.lexsort((names, -both), axis=-1)[:, :k]
                scores[at], ids[at] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                floor[at] = np.maximum(floor[at], scores[at, k - 1])
            continue
        if b[4] == b[5] or (a[4] != a[5] and a[1] > b[1]):
            pairs = [(c, j) for c in range(a[4], a[5])]
        else:
            pairs = [(i, c) for c in range(b[4], b[5])]
        stack += sorted((bound(q, x, p, y), x, y) for x, y in pairs)  # the most promising pair is met first
    return scores, ids


@dataclass
class PivotTree:
    """Pivots of the upper levels. Node 0 is the root; children[i] are the numbers of node i's children, points their pivots."""

    points: np.ndarray
    children: list[list[int]]
    parent: list[int]
    depth: list[int]

    @classmethod
    def grow(cls, sample: np.ndarray, leaves: int) -> PivotTree:
        """Splits the node with most of the sample, until there are so many leaves or nothing is left to tell apart."""
        points, children, parent, depth = [sample.mean(0)], [[]], [-1], [0]
        heap, count = [(-len(sample), 0, np.arange(len(sample)))], 1
        while heap and count < leaves:
            _, node, own = heapq.heappop(heap)
            pivots = choose_pivots(sample[own], min(FANOUT, leaves - count + 1))
            if len(pivots) < 2:
                continue
            nearest = ((pivots**2).sum(1)[None, :] - 2 * sample[own] @ pivots.T).argmin(1)
            for i, pivot in enumerate(pivots):
                number = len(points)
                points.append(pivot)
                children.append([])
                parent.append(node)
                depth.append(depth[node] + 1)
                children[node].append(number)
                heapq.heappush(heap, (-int((nearest == i).sum()), number, own[nearest == i]))
            count += len(pivots) - 1
        return cls(np.array(points), children, parent, depth)

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        open_ = np.arange(len(v)) if self.children[0] else np.zeros(0, np.int64)
        while len(open_):
            for node in np.unique(at[open_]).tolist():
                rows, below = open_[at[open_] == node], self.children[node]
                near = self.points[below]
                at[rows] = np.array(below)[((near**2).sum(1)[None, :] - 2 * v[rows] @ near.T).argmin(1)]
            open_ = open_[[bool(self.children[i]) for i in at[open_].tolist()]]
        return at


def assign(rows: DataFrame, pivots: PivotTree) -> DataFrame:
    """Adds the number of its leaf of the pivot tree to (vec_id, v)."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf_of(v).astype(np.int32))], ["vec_id", "v", "pivot"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, pivot int")


SUMMARY = "centre array<double>, radius double, norm double, size long"


def index(scratch: Scratch, assigned: DataFrame, rows: int, name: str) -> DataFrame:
    """(name, pivot, tree, centre, radius, norm, size): the tree of each block. Blocks are numbered from 0; a pivot has as many as its
    rows need."""
    counts = sorted((r["pivot"], r["count"]) for r in assigned.groupBy("pivot").count().collect())  # a row for each pivot
    numbered, first = [], 0
    for pivot, n in counts:
        numbered.append((pivot, first, -(-n // rows)))
        first += numbered[-1][2]
    blocks = F.broadcast(scratch.spark.createDataFrame(numbered, "pivot int, first int, parts int"))
    dealt = assigned.join(blocks, "pivot").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias(name), "pivot", "vec_id", "v")

    def build(table: pa.Table) -> pa.Table:
        points = np.asarray(table["v"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        tree = CoverTree(np.asarray(table["vec_id"], np.int64), points)
        own = {name: pa.array([table[name][0].as_py()], pa.int32()), "pivot": pa.array([table["pivot"][0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())}
        return pa.table(own | {"centre": pa.array([tree.nodes[0][0].tolist()], pa.list_(pa.float64())), "radius": [tree.nodes[0][1]], "norm": [tree.norms[0]], "size": pa.array([table.num_rows], pa.int64())})

    return scratch.table(dealt.groupBy(name).applyInArrow(build, f"{name} int, pivot int, tree binary, {SUMMARY}"), name)


def upper_levels(scratch: Scratch, blocks: DataFrame, pivots: PivotTree) -> list[DataFrame]:
    """(node, above, centre, radius, norm) of the nodes of each level, from the root's children to the blocks. A node without an own
    level (a leaf that isn't as deep as others) stands on the levels below as itself."""
    deepest = max(pivots.depth)
    chain = [(leaf, *(_at_depth(pivots, leaf, d) for d in range(1, deepest + 1))) for leaf in range(len(pivots.points)) if not pivots.children[leaf]]
    names = ", ".join(f"n{d} int" for d in range(1, deepest + 1))
    placed = blocks.select("blk", "pivot", "centre", "radius", "norm", "size")
    if deepest:
        placed = placed.join(F.broadcast(scratch.spark.createDataFrame(chain, f"pivot int, {names}")), "pivot")
    placed = scratch.table(placed, "placed")
    levels = [placed.select(F.col("blk").alias("node"), F.col(f"n{deepest}" if deepest else "pivot").alias("above"), "centre", "radius", "norm")]

    def covered(table: pa.Table) -> pa.Table:
        centres = np.asarray(table["centre"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        sizes, radii = np.asarray(table["size"], np.float64), np.asarray(table["radius"], np.float64)
        middle = (centres * sizes[:, None]).sum(0) / sizes.sum()
        radius = float((np.sqrt(((centres - middle) ** 2).sum(1)) + radii).max()) * (1 + 1e-12)
        own = {"node": pa.array([table["node"][0].as_py()], pa.int32()), "above": pa.array([table["above"][0].as_py()], pa.int32())}
        return pa.table(own | {"centre": pa.array([middle.tolist()], pa.list_(pa.float64())), "radius": [radius], "norm": [float(np.sqrt((middle**2).sum()))], "size": pa.array([int(sizes.sum())], pa.int64())})

    below = placed
    for d in range(deepest, 0, -1):
        upper = [f"n{i}" for i in range(1, d)]
        keyed = below.withColumn("node", F.col(f"n{d}")).withColumn("above", F.col(f"n{d - 1}") if d > 1 else F.lit(0))
        level = keyed.select("node", "above", "centre", "radius", "size").groupBy("node").applyInArrow(covered, f"node int, above int, {SUMMARY}")
        ways = below.select(F.col(f"n{d}").alias("node"), *upper).distinct()
        below = scratch.table(level.join(ways, "node"), "level")
        levels.insert(0, below.select("node", "above", "centre", "radius", "norm"))
    return levels


def _at_depth(pivots: PivotTree, node: int, depth: int) -> int:
    while pivots.depth[node] > depth:
        node = pivots.parent[node]
    return node


def _bounded(pairs: DataFrame, groups: DataFrame, level: DataFrame) -> DataFrame:
    """(columns of pairs, node, most): the nodes of a level below the pairs' nodes (grp, above), with their bounds."""
    sides = pairs.join(level, "above").join(groups.select("grp", F.col("centre").alias("cq"), F.col("radius").alias("rq"), F.col("norm").alias("nq")), "grp")
    inner = F.aggregate(F.zip_with("cq", "centre", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    most = inner + F.col("rq") * F.col("norm") + F.col("radius") * F.col("nq") + F.col("rq") * F.col("radius") + 1e-6 * (1 + F.col("nq") * F.col("norm"))
    return sides.select(*(c for c in pairs.columns if c != "above"), "node", most.alias("most"))


def surviving_pairs(scratch: Scratch, groups: DataFrame, levels: list[DataFrame], floors: DataFrame) -> DataFrame:
    """(grp, floor, blk): the pairs that no bound rules out, going down level by level; floors are (grp, floor, done)."""
    pairs = floors.withColumn("above", F.lit(0))
    for i, level in enumerate(levels):
        pairs = scratch.table(_bounded(pairs, groups, level).where("floor is null or most >= floor").drop("most").withColumnRenamed("node", "above"), f"pairs-{i}")
    return pairs.where("above != done").select("grp", F.col("above").alias("blk"))


def _search_pairs(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(grp, query_id, vec_id, score) for pairs (grp, blk, qtree, ids, worst): worst k-th scores by query id."""
    counts = pairs.groupBy("blk").agg(F.ceil(F.count("*") / GROUPS_AT_ONCE).cast("int").alias("parts"))
    trees = blocks.select("blk", "tree").join(counts, "blk").select("blk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tree")
    dealt = pairs.join(counts, "blk").withColumn("part", F.pmod(F.xxhash64("grp"), F.col("parts")).cast("int"))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if mine.num_rows:
            p = pickle.loads(theirs["tree"][0].as_py())
            for r in mine.to_batches(1):
                r = r.to_pylist()[0]
                q, known = pickle.loads(r["qtree"]), dict(zip(r["ids"] or [], r["worst"] or []))
                floor = np.array([known.get(i, -np.inf) for i in q.ids.tolist()], np.float64)
                scores, ids = search(q, p, floor, k)
                row, col = np.nonzero(scores > -np.inf)
                for c, values in zip(out, (np.full(len(row), r["grp"], np.int32), q.ids[row], ids[row, col], scores[row, col].astype(np.int64))):
                    c.append(values)
        kinds = (np.int32, np.int64, np.int64, np.int64)
        return pa.table({n: pa.array(np.concatenate([*c, np.zeros(0, t)]).astype(t)) for n, c, t in zip(("grp", "query_id", "vec_id", "score"), out, kinds)})

    columns = dealt.select("blk", "part", "grp", "qtree", "ids", "worst")
    return columns.groupBy("blk", "part").cogroup(trees.groupBy("blk", "part")).applyInArrow(run, "grp int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products among vectors of other ids. Both: (vec_id, v)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "covertree")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = scratch.table(usable(vectors.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))), "vectors")
    asked = scratch.table(usable(queries.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))), "queries")
    leaves = -(-data.count() // BLOCK_ROWS)
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOT_SAMPLE, 64 * leaves)).select("v").toArrow()["v"].combine_chunks()
    if not len(sample) or asked.isEmpty():
        return empty
    sample = np.asarray(sample.flatten(), np.float64).reshape(len(sample), -1)
    if asked.where(F.size("v") != sample.shape[1]).limit(1).count():
        raise ValueError("queries and vectors differ in length")
    pivots = PivotTree.grow(sample, min(leaves, max(1, len(sample) // 16)))
    blocks = index(scratch, assign(data, pivots), BLOCK_ROWS, "blk")
    groups = index(scratch, assign(asked, pivots), GROUP_ROWS, "grp")
    levels = upper_levels(scratch, blocks, pivots)

    def searched(pairs: DataFrame) -> DataFrame:
        return _search_pairs(pairs.join(groups.select("grp", F.col("tree").alias("qtree")), "grp"), blocks, k)

    first = groups.select("grp", F.lit(0).alias("above"))
    for level in levels:
        first = _bounded(first, groups, level).groupBy("grp").agg(F.max_by("node", F.struct("most", -F.col("node"))).alias("above"))
    first = scratch.table(first.select("grp", F.col("above").alias("blk")), "first")
    nothing = (F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("worst"))
    found = scratch.table(searched(first.select("grp", "blk", *nothing)), "found")
    kth = found.groupBy("grp", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select("grp", "query_id", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf")).alias("worst"))
    known = kth.groupBy("grp").agg(F.collect_list("query_id").alias("ids"), F.collect_list("worst").alias("worst"), F.count("*").alias("n"), F.min("worst").alias("floor"))  # a group has GROUP_ROWS queries, about
    # a query that has found nothing yet leaves its group without a floor
    known = known.join(groups.select("grp", "size"), "grp").withColumn("floor", F.when(F.col("n") == F.col("size"), F.col("floor")))
    known = scratch.table(known.select("grp", "ids", "worst", "floor"), "known")
    floors = first.select("grp", F.col("blk").alias("done")).join(known.select("grp", "floor"), "grp", "left")
    left = surviving_pairs(scratch, groups, levels, floors.select("grp", "floor", "done"))
    left = left.join(known.select("grp", "ids", "worst"), "grp", "left")
    rest = searched(left)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    # a component that isn't finite stays as it is, and its vector takes no part
    whole = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(256 * x).cast("double"))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: whole(x.cast("double"))).alias("v"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
