"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the total is shared by weight; no source's target exceeds `most_repeats` times its size, and what is cut off is reshared by
weight among the others. Order: each source's documents are shuffled by a hash of the id, laid end to end and cut into blocks of
equal word counts. Schedule: slot t of the mix looks up the fraction of t times the golden ratio (40 bits, in whole numbers) in the
sources' cumulative target shares, so every source's slots are spread evenly. Slots are ranked within their source, and the source's
r-th slot takes its r-th block, starting over after the last one; the slot that reaches the target is cut there. There are as many
slots as all sources need. A source's count strays from its need by a few slots, so what some have too many is given, in order, to
those that have too few: at most some 2 log2(slots) for each source.

Running sums and ranks go in two levels (sums of bounded cells, then inside a cell), so no source, however large, meets in one task.
Sources are a list that a person weighs, so the per-source totals, a row each, go to the driver (`MOST_SOURCES`).

Defined results: a null text has 0 words and takes part with nothing; a null source is a source of its own, last in order; a document
without words is taken 0 times; very long texts span blocks like others; repeated rows count each; null ids are allowed; extra columns
are ignored; an empty table gives an empty mix. In the pipeline's stage rows with the same id, source and size are repeated as often
as the one that the mix takes most of.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, fresh, small_table

#: The golden ratio's fraction in 40 bits.
GOLDEN, BITS = 679535556991, 40
#: Places of a slot in the cumulative shares are found by their first bits.
PLACE_BITS = 12
MOST_SOURCES = 100_000
BLOCK = 1024
CELL_DOCS, CELL_SLOTS = 4096, 16384


def water_fill(sizes: list[int], weights: list[float], total: float, most_repeats: float) -> list[float]:
    """Targets by weight, cut at most_repeats times the size, the excess reshared until none is above."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] >= most_repeats * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = share * weights[i]
            break
        for i in full:
            targets[i] = float(most_repeats * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def targets_of(spark: SparkSession, sized: DataFrame, cycle: list[float], share: float, most_repeats: float) -> tuple[DataFrame, list]:
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources to weigh")
    sizes = [r.source_size for r in totals]
    targets = water_fill(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], share * sum(sizes), most_repeats)
    rows = [(i, r.source, r.source_size, t) for i, (r, t) in enumerate(zip(totals, targets))]
    return small_table(spark, rows, "s int, source string, source_size long, target double"), rows


def running(df: DataFrame, group: list[str], cell: str, amount: str, order: list, before: str) -> DataFrame:
    """Adds the sum of `amount` over what precedes a row within its group; cells are in order and bounded in rows."""
    cells = df.groupBy(*group, cell).agg(F.sum(amount).alias("_in_cell"))
    ahead = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, cell, F.coalesce(F.sum("_in_cell").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(cells, [*group, cell]).withColumn(before, F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside")


def golden_point(slot: str) -> Column:
    """slot times the golden ratio, modulo 1, times 2**40. The product is taken in two parts that a long holds."""
    low, high = f"({slot} & 1048575) * {GOLDEN}", f"((shiftright({slot}, 20) & 1048575) * {GOLDEN & 1048575}) & 1048575"
    return F.expr(f"(({low}) + shiftleft({high}, 20)) & {(1 << BITS) - 1}")


def schedule(spark: SparkSession, rows: list, block: int) -> DataFrame:
    """(s, rank, slot, block, words): the mix, slot by slot. words is what the slot takes of its block."""
    need = []
    for s, _, size, target in rows:
        words = math.floor(target + 1e-6)
        full, rest = divmod(words, size) if size else (0, 0)
        blocks = -(-size // block)
        slots = full * blocks + -(-rest // block)
        if slots:
            need.append((s, size, blocks, slots, words))
    if not need:
        return small_table(spark, [], "s int, rank long, slot long, block long, words long")
    total, at, intervals, wide = sum(n[3] for n in need), 0, [], BITS - PLACE_BITS
    for s, _, _, slots, _ in need:
        low, high = (at << BITS) // total, ((at + slots) << BITS) // total
        if high > low:
            intervals += [(place, s, low, high) for place in range(low >> wide, ((high - 1) >> wide) + 1)]  # all sources' together: one each, and 2**12
        at += slots
    slots = spark.range(total).select(F.col("id").alias("slot"), golden_point("id").alias("u"), (F.col("id") / CELL_SLOTS).cast("long").alias("cell")).withColumn("place", F.shiftright("u", wide))
    found = small_table(spark, intervals, "place long, s int, low long, high long")
    slots = slots.join(F.broadcast(found), "place").where("u >= low and u < high").select("s", "slot", "cell", F.lit(1).alias("one"))
    needs = small_table(spark, need, "s int, size long, blocks long, need long, wanted long")
    scratch = Scratch(spark, "schedule")
    ranked = scratch.table(running(slots, ["s"], "cell", "one", ["slot"], "rank").select("s", "slot", "rank").join(F.broadcast(needs), "s"), "ranked")
    counts = ranked.groupBy("s").agg(F.count("*").alias("n"))
    short = needs.join(counts, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need").withColumn("rank", F.explode(F.sequence(F.col("n"), F.col("need") - 1)))
    short = short.withColumn("i", F.row_number().over(Window.orderBy("s", "rank"))).drop("n")
    free = ranked.where("rank >= need").select("slot", F.row_number().over(Window.orderBy("slot")).alias("i"))
    columns = ["s", "slot", "rank", "size", "blocks", "wanted"]
    ranked = ranked.where("rank < need").select(*columns).union(short.join(free, "i").select(*columns))
    number = F.col("rank") % F.col("blocks")
    whole = F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block)
    left = F.col("wanted") - F.floor(F.col("rank") / F.col("blocks")).cast("long") * F.col("size") - F.col("block") * block
    return ranked.withColumn("block", number).select("s", "rank", "slot", "block", F.least(whole, left).cast("long").alias("words"))


def mix(docs: DataFrame, cycle: list[float] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, slots, pieces) of documents (doc_id, text, source).

    placed: doc_id, size, source, source_size, target, s and start, the document's place in its source; slots: the schedule;
    pieces: (key columns, slot, s, block, from, thru), the words [from, thru) of a document that a slot takes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    sized = scratch.table(sized, "sizes")
    sources, rows = targets_of(spark, sized, list(cycle), share, most_repeats)
    n = sized.count()
    bits = max(1, math.ceil(math.log2(max(n, 1) / CELL_DOCS + 1)) + 1)
    placed = sized.join(F.broadcast(sources), sized.source.eqNullSafe(sources.source)).drop(sources.source)
    placed = placed.withColumn("shuffled", F.xxhash64("doc_id")).withColumn("cell", F.shiftrightunsigned("shuffled", 64 - bits))
    order = [F.col("shuffled"), F.col("doc_id"), F.col("size")]
    placed = scratch.table(running(placed, ["s"], "cell", "size", order, "start"), "placed")
    slots = scratch.table(schedule(spark, rows, block), "slots")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    laid = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.col("start") - F.col("block") * block
    pieces = laid.join(slots.select("s", "block", "slot", "words"), ["s", "block"])
    pieces = pieces.select("doc_id", "shuffled", "s", "start", "size", "slot", "block", F.greatest(-inside, F.lit(0)).alias("from"), F.least(F.col("size"), F.col("words") - inside).alias("thru")).where("from < thru")
    return placed, slots, pieces


def taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """placed with the words that the mix takes of each document."""
    sums = pieces.groupBy("s", "start").agg(F.sum(F.col("thru") - F.col("from")).alias("taken"))
    used = placed.where("size > 0").join(sums, ["s", "start"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return used.union(placed.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long")))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the documents that the mix takes words of stay, each as often as the mix takes it, rounded to whole passes.

    A pass over a source takes its documents whole; the last, partial pass takes those that begin before it ends."""
    return repeated(docs)


def repeated(docs: DataFrame) -> DataFrame:
    placed, _, pieces = mix(docs.select("doc_id", "text", "source"))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    own, count, copy = fresh(docs, "size"), fresh(docs, "times"), fresh(docs, "copy")
    found = taken(placed, pieces).groupBy("doc_id", "source", "size").agg(F.max(times).cast("int").alias(count)).where(F.col(count) > 0)
    found = found.select(F.col("doc_id").alias(f"{count}_id"), F.col("source").alias(f"{count}_source"), F.col("size").alias(f"{count}_size"), count)
    sized = docs.withColumn(own, word_count("text"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{count}_id")) & F.col("source").eqNullSafe(F.col(f"{count}_source")) & (F.col(own) == F.col(f"{count}_size"))
    return sized.join(found, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).select(docs.columns)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, pieces = mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return taken(placed, pieces).select("doc_id", "size", "source_size", "target", "taken")
