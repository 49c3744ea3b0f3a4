"""Merkle dataset manifest: a tree of digests per source and one over the sources, and a proof for every row that climbs it.

Each row is a leaf, numbered within its source by a range sort (numbers of a partition's rows, moved by the counts of the partitions
before it), so no task holds a whole source. The trees are built three levels at once: 27 consecutive nodes make one stored row, which
holds their digests level by level; what it folds to is a node of the next such row. Above PART leaves all proofs run alike, so what
stands there (the rest of the source's tree, then the tree of subroots) is stored once for each part of PART leaves as one row.

The proof is a recursive query: each leaf starts with the digest of its tampered row and meets one stored row a step, appends the
siblings of each level there, folds its digest with them and goes on to that row's parent, until it is at the root. No stored row is met
by more than PART leaves, so a source of any share of the table is dealt out; and as siblings are appended in three steps, what the
steps shuffle doesn't grow with the height of the tree.

H is the lowercase hex sha256 of its inputs put together; digests are kept as bytes and hashed as hex text.

Defined results: nulls are '-' in a leaf and the null source is a source, the first; rows of one source come by doc_id, nulls first, ties
by leaf; equal rows are leaves each and get each a proof; a source of one row has its leaf as subroot; with nothing to fold a proof is
that of no siblings; texts of any length are hashed whole; rows without doc_id aren't tampered with; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, hot_parts, split_join

FAN = 3
RUN = FAN**3
PART = RUN * RUN
#: So many rows of counts or paths may be sent to every executor; more are joined by a shuffle.
MOST_BROADCAST = 10_000
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def up(digests: Column) -> Column:
    """One level: the digests of runs of FAN."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.transform(F.slice(digests, i * FAN + 1, FAN), lambda d: F.lower(F.hex(d))), "")))


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `i`: each row's place among those of its group, from 0. Rows are dealt by ranges of (group, order), so a group of any size
    is many partitions; equal rows are told apart by where they were read, so that they are dealt too."""
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "_salt")
    dealt = scratch.table(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_salt")) - 1
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.table(counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before")), "counts")
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts, [group, "_part"])
    return placed.select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("long").alias("i"))


def stretches(scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaves (tree, i, d, m), m the leaves of their tree: the stored rows (tree, stretch, block, steps, levels), and (tree, root)."""
    stored = scratch.spark.createDataFrame([], "tree long, stretch int, block long, steps int, levels array<array<binary>>")
    roots, stretch = nodes.where("m = 1").select("tree", "d"), 0
    live = nodes.where("m > 1")
    while not live.isEmpty():
        rows = live.groupBy("tree", F.floor(F.col("i") / RUN).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x"), F.first("m").alias("m"))
        steps = F.when(F.col("m") <= FAN, 1).when(F.col("m") <= FAN**2, 2).otherwise(3)
        rows = rows.select("tree", F.lit(stretch).alias("stretch"), "block", steps.alias("steps"), F.ceil(F.col("m") / RUN).cast("long").alias("m"), F.col("x.d").alias("d0")).withColumn("d1", up(F.col("d0")))
        rows = rows.withColumn("d2", F.when(F.col("steps") > 1, up(F.col("d1")))).withColumn("d3", F.when(F.col("steps") > 2, up(F.col("d2"))))
        rows = scratch.table(rows.select("tree", "stretch", "block", "steps", F.array("d0", "d1", "d2").alias("levels"), F.coalesce("d3", "d2", "d1")[0].alias("d"), "m"), f"stretch-{stretch}")
        stored = stored.union(rows.select(*stored.columns))
        roots = roots.union(rows.where("m = 1").select("tree", "d"))
        live, stretch = rows.where("m > 1").select("tree", F.col("block").alias("i"), "d", "m"), stretch + 1
    return stored, scratch.table(roots.withColumnRenamed("d", "root"), "roots")


def paths(sizes: DataFrame, trees: DataFrame, top: DataFrame, top_size: int) -> DataFrame:
    """(home, hop, key, path) of the stored rows a leaf meets: those of its first two stretches, which its number picks by block (place
    null), then one that holds what is above its part."""
    heights = []
    for rows in (sizes.select("m"), None):
        height, most = 0, top_size if rows is None else (rows.agg(F.max("m")).first()[0] or 0)
        while RUN**height < most:
            height += 1
        heights.append(height)
    stretch = lambda place: F.struct(F.col("hop"), place.cast("int").alias("place"), "steps", "levels").alias("stretch")
    own = trees.where("stretch < 2").select(F.col("tree").alias("home"), F.col("stretch").alias("hop"), F.col("block").alias("key"), "steps", "levels")
    own = own.select("home", "hop", "key", F.array(stretch(F.lit(None))).alias("path"))
    parts = sizes.select(F.col("tree").alias("home"), "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PART).cast("long"))).alias("key"))
    above = F.array([F.struct(F.lit(h).alias("hop"), F.col("home").alias("tree"), F.lit(h).alias("stretch"), F.floor(F.col("key") / RUN ** (h - 1)).cast("long").alias("block"), (F.floor(F.col("key") / RUN ** (h - 2)) % RUN).alias("place"), (F.col("m") > RUN**h).alias("there")) for h in range(2, heights[0])]
                    + [F.struct(F.lit(heights[0] + k).alias("hop"), F.lit(-1).cast("long").alias("tree"), F.lit(k).alias("stretch"), F.floor(F.col("home") / RUN ** (k + 1)).cast("long").alias("block"), (F.floor(F.col("home") / RUN**k) % RUN).alias("place"), F.lit(True).alias("there")) for k in range(heights[1])])
    if max(heights[0], 2) + heights[1] == 2:
        return own
    routes = parts.select("home", "key", F.when(F.col("m") <= 1, 0).when(F.col("m") <= RUN, 1).otherwise(2).alias("at"), F.explode(F.filter(above, lambda x: x.there)).alias("x")).select("home", "key", "at", "x.*")
    upper = trees.where("stretch >= 2").union(top)
    upper = F.broadcast(upper) if upper.count() <= MOST_BROADCAST else upper
    met = routes.join(upper, ["tree", "stretch", "block"]).select("home", "key", "at", stretch(F.col("place")))
    return own.union(met.groupBy("home", F.col("at").alias("hop"), "key").agg(F.array_sort(F.collect_list("stretch")).alias("path")))


_RUN_OF = f"slice(s.levels[l], CAST(acc.at DIV {FAN} AS INT) * {FAN} + 1, {FAN})"
#: One step: along a stored row's levels the siblings are appended and the digest is folded with them.
_LEVELS = f"""aggregate(sequence(0, s.steps - 1), named_struct('at', coalesce(s.place, first), 'folded', acc.folded, 'proof', acc.proof), (acc, l) -> named_struct(
        'at', CAST(acc.at DIV {FAN} AS INT),
        'folded', unhex(sha2(array_join(transform({_RUN_OF}, (d, k) -> lower(hex(IF(k = acc.at % {FAN}, acc.folded, d)))), ''), 256)),
        'proof', concat(acc.proof, unhex(array_join(transform({_RUN_OF}, (d, k) -> IF(k = acc.at % {FAN}, '', hex(d))), '')))))"""
CLIMB = f"""
WITH RECURSIVE climb(doc_id, leaf, home, i, hops, hop, key, folded, proof) AS (
  SELECT doc_id, leaf, home, i, hops, 0, i DIV {RUN}, coalesce(tampered, leaf), X'' FROM {{leaves}}
  UNION ALL
  SELECT doc_id, leaf, home, i, hops, hop + 1, i DIV {PART}, went.folded, IF(hop + 1 = hops, unhex(sha2(lower(hex(went.proof)), 256)), went.proof) FROM (
    SELECT c.*, aggregate(p.path, named_struct('at', 0, 'folded', c.folded, 'proof', c.proof), (acc, s) -> {_LEVELS.replace("first", f"CAST(IF(c.hop = 0, c.i, c.i DIV {RUN}) % {RUN} AS INT)")}) AS went
    FROM climb c JOIN {{paths}} p ON c.home = p.home AND c.hop = p.hop AND c.key = p.key)
)
SELECT doc_id, leaf, home, folded, IF(hops = 0, unhex(sha2('', 256)), proof) AS proof FROM climb WHERE hop = hops
"""


def manifest(rows: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows with the columns of a leaf. `text_now`, if there is
    such a column, is what the text has become; proofs start from it."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "manifest")
    joined = lambda text: digest(F.concat(*(field(text if c == "text" else F.col(c)) for c in LEAF)))
    now = joined(F.col("text_now")) if "text_now" in rows.columns else F.lit(None).cast("binary")
    # '' stands for the null source, so that it equals itself and comes first
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("named")
    leaves = rows.select("doc_id", named, joined(F.col("text")).alias("leaf"), now.alias("now")).withColumn("tampered", F.when(F.col("now") != F.col("leaf"), F.col("now"))).drop("now")
    leaves = scratch.table(numbered(scratch, leaves, "named", ["doc_id", "leaf"]), "leaves")
    counts = scratch.table(leaves.groupBy("named").agg(F.count("*").alias("n")), "sources")
    number = numbered(scratch, counts.withColumn("_all", F.lit(0)), "_all", ["named"])
    sources = scratch.table(number.select("named", F.col("i").alias("home"), F.col("n").alias("m")), "numbers")
    leaves = scratch.table(split_join(leaves, sources, ["named"], hot_parts(counts, ["named"])).drop("named"), "numbered")
    trees, subroots = stretches(scratch, leaves.select(F.col("home").alias("tree"), "i", F.col("leaf").alias("d"), "m"))
    several = sources.count()
    top, roots = stretches(scratch, subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("root").alias("d"), F.lit(several).cast("long").alias("m")))
    found = roots.first()
    root = F.lit(bytes(found.root)) if found else F.lit(None).cast("binary")
    stored = scratch.table(paths(sources.select(F.col("home").alias("tree"), "m"), trees, top, several), "paths")
    hops = F.when(F.col("m") <= 1, 0).when(F.col("m") <= RUN, 1).otherwise(2) + F.when((F.col("m") > PART) | F.lit(several > 1), 1).otherwise(0)
    start = leaves.select("doc_id", "leaf", "home", "i", hops.alias("hops"), "tampered")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        climbed = scratch.table(spark.sql(CLIMB, leaves=start, paths=stored), "climbed")
    finally:
        spark.conf.set(limit, before)
    sides = subroots.select(F.col("tree").alias("home"), F.col("root").alias("subroot"))
    parts = hot_parts(scratch.table(sources.select("home", F.col("m").alias("n")), "homes"), ["home"])
    text = lambda c: F.lower(F.hex(c))
    out = split_join(climbed, sides, ["home"], parts)
    return out.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(root).alias("root"), text(F.col("proof")).alias("proof_sha256"), text(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(documents(spark, sf_dir, *LEAF).withColumn("text_now", now))


_FIELD = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_CRC = "list_reduce(list_concat([4294967295], flatten([[CAST(ord(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for k in range(1, length(CAST(doc_id AS VARCHAR)) + 1)])), lambda c, v : xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384))"
_LEAF_OF = lambda text: "sha256(" + " || ".join(_FIELD(text if c == "text" else c) for c in LEAF) + ")"
ORACLE = f"""
WITH RECURSIVE x AS (SELECT doc_id, source, {_LEAF_OF("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND ({_CRC} & 1) = 1 THEN {_LEAF_OF("replace(text, chr(10), '')")} END AS now FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM x)),
leaves AS (SELECT x.doc_id, x.leaf, coalesce(x.now, x.leaf) AS now, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY x.doc_id NULLS FIRST, x.leaf) - 1 AS i,
    count(*) OVER (PARTITION BY s.tree) AS m FROM x JOIN s ON x.source IS NOT DISTINCT FROM s.source),
low(tree, l, i, d, m) AS (SELECT tree, 0, i, leaf, m FROM leaves
    UNION ALL SELECT tree, l + 1, i // {FAN}, sha256(string_agg(d, '' ORDER BY i)), (m + {FAN - 1}) // {FAN} FROM low WHERE m > 1 GROUP BY tree, l, i // {FAN}, m),
subroots AS (SELECT tree, d AS subroot FROM low WHERE m = 1),
high(l, i, d, m) AS (SELECT 0, tree, subroot, count(*) OVER () FROM subroots
    UNION ALL SELECT l + 1, i // {FAN}, sha256(string_agg(d, '' ORDER BY i)), (m + {FAN - 1}) // {FAN} FROM high WHERE m > 1 GROUP BY l, i // {FAN}, m),
low_runs AS (SELECT tree, l, i // {FAN} AS run, list(d ORDER BY i) AS ds FROM low WHERE m > 1 GROUP BY ALL),
high_runs AS (SELECT l, i // {FAN} AS run, list(d ORDER BY i) AS ds FROM high WHERE m > 1 GROUP BY ALL),
up(doc_id, leaf, tree, l, i, m, folded, proof) AS (SELECT doc_id, leaf, tree, 0, i, m, now, '' FROM leaves
    UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.l + 1, c.i // {FAN}, (c.m + {FAN - 1}) // {FAN},
      sha256(array_to_string(list_concat(r.ds[:c.i % {FAN}], [c.folded], r.ds[c.i % {FAN} + 2:]), '')),
      c.proof || array_to_string(list_concat(r.ds[:c.i % {FAN}], r.ds[c.i % {FAN} + 2:]), '') FROM up c JOIN low_runs r ON r.tree = c.tree AND r.l = c.l AND r.run = c.i // {FAN} WHERE c.m > 1),
top(doc_id, leaf, tree, l, i, m, folded, proof) AS (SELECT doc_id, leaf, tree, 0, tree, (SELECT count(*) FROM s), folded, proof FROM up WHERE m = 1
    UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.l + 1, c.i // {FAN}, (c.m + {FAN - 1}) // {FAN},
      sha256(array_to_string(list_concat(r.ds[:c.i % {FAN}], [c.folded], r.ds[c.i % {FAN} + 2:]), '')),
      c.proof || array_to_string(list_concat(r.ds[:c.i % {FAN}], r.ds[c.i % {FAN} + 2:]), '') FROM top c JOIN high_runs r ON r.l = c.l AND r.run = c.i // {FAN} WHERE c.m > 1)
SELECT t.doc_id, t.leaf, b.subroot, h.d AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root, t.folded = h.d AS verified
FROM top t JOIN subroots b ON b.tree = t.tree CROSS JOIN (SELECT d FROM high WHERE m = 1) h WHERE t.m = 1
"""
