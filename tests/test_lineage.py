"""Lineage: slots, refusals, row sets against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lineage
from lodestone.operators.aggregates import Measure
from lodestone.operators.joins import JoinRule, Scope
from lodestone.operators.lineage import original, paired, reduce_traced, traced_aggregate, traced_join


@pytest.fixture(scope="module")
def sources(spark):
    orders = spark.createDataFrame([(i, i % 3 if i % 5 else None, 10 * i) for i in range(1, 21)], "id long, cust long, price long")
    customers = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "id long, name string")
    return original(orders, "o", F.col("id"), "r1"), original(customers, "c", F.col("id"))


def test_shared_records_agree(sources):
    o, c = sources
    both = traced_join(o, c, JoinRule(["o__cust"], ["c__id"]))
    again = traced_join(both, o, JoinRule(["o__cust"], ["o__cust"]))  # the same orders: no pair of two orders of one customer
    assert sorted(r.o__id for r in again.frame().collect()) == [i for i in range(1, 21) if i % 5]
    assert set(again.fields) == set(both.fields) and again.slots == {"o": "r1", "c": ""}
    scoped = traced_join(both, traced_join(o, c, JoinRule(["o__cust"], ["c__id"])), JoinRule(["o__cust"], ["c__id"], scopes=[Scope(["c__name"], ["c__name"])]))
    assert sorted(r.o__id for r in scoped.frame().collect()) == [i for i in range(1, 21) if i % 5 and i % 3 != 2]


def test_refusals(spark, sources):
    o, c = sources
    with pytest.raises(ValueError, match="two revisions"):
        traced_join(o, original(o.frame().toDF("id", "cust", "price"), "o", F.col("id"), "r2"), JoinRule(["o__cust"], ["o__cust"]))
    spent = reduce_traced(o, "s", ["o__cust"], [Measure("total", "sum", "o__price")])
    for left, right, keys in ((spent, o, ("s__cust", "o__cust")), (o, spent, ("o__cust", "s__cust")), (spent, reduce_traced(o, "t", ["o__cust"], [Measure("n", "count")]), ("s__cust", "t__cust"))):
        with pytest.raises(ValueError, match="is reduced"):
            traced_join(left, right, JoinRule([keys[0]], [keys[1]]))
    both = traced_join(o, c, JoinRule(["o__cust"], ["c__id"]))
    for rel in (both, spent):
        with pytest.raises(ValueError, match="only one original source"):
            reduce_traced(rel, "x", ["o__cust"], [Measure("n", "count")])
    with pytest.raises(ValueError, match="another revision"):
        reduce_traced(o, "x", ["o__cust"], [Measure("n", "count")], revision="r2")
    with pytest.raises(ValueError, match="different records"):
        lineage.measured(both, "m", ["o__price", "c__id"], F.col("o__price") + F.col("c__id"))
    with pytest.raises(ValueError, match="overwrite"):
        lineage.measured(both, "o__id", ["o__price"], F.col("o__price"))
    with pytest.raises(ValueError, match="no original record"):
        traced_aggregate(spent, ["s__cust"], [Measure("x", "sum", "s__total")])
    foreign = lineage.Relation(o.rows.withColumnRenamed("_at__o", "_at__z"), {"z": ""}, {f: "z" for f in o.fields})
    with pytest.raises(ValueError, match="both sides have"):
        traced_join(o, foreign, JoinRule(["o__id"], ["o__id"]))
    with pytest.raises(Exception, match="has no position"):
        original(o.frame(), "n", F.col("o__cust")).rows.collect()


def test_sums_count_a_record_once(sources):
    o, c = sources
    both = traced_join(o, c, JoinRule(["o__cust"], ["c__id"]))
    rows = traced_aggregate(lineage.measured(both, "double", ["o__price", "o__id"], F.col("o__price") * 2), ["c__name"], [Measure("n", "count"), Measure("total", "sum", "double")]).collect()
    want = {n: [20 * i for i in range(1, 21) if i % 5 and i % 3 == k] for k, n in enumerate(("a", "b", None))}
    assert [(r.c__name, r.n, int(r.total)) for r in rows] == [(n, len(want[n]), sum(want[n])) for n in (None, "a", "b")]
    with pytest.raises(Exception, match="counts twice"):
        traced_aggregate(both, [], [Measure("x", "sum", "c__id")]).collect()


def test_pairs_inherit_both(spark, sources):
    o, c = sources
    pairs = paired(spark.createDataFrame([(1, 0, 2.5), (2, 2, 1.5)], "a long, b long, far double"), "near", {"o": ("a", "r1"), "c": ("b", "")}, {})
    both = traced_join(pairs, lineage.Relation(o.rows.withColumn("k", F.lit(2.5)), o.slots, o.origins), JoinRule(["near__far"], ["k"]))
    assert [(r.o__id, r.near__far) for r in both.frame().collect()] == [(1, 2.5)]
    assert {(r.source, r.record) for r in lineage.used_originals(both).collect()} == {("o", 1), ("c", 0)}
    with pytest.raises(ValueError, match="two sources or more"):
        paired(o.frame(), "near", {"o": ("o__id", "r1")}, {})


def test_reduction_keeps_members(spark, sources):
    o, c = sources
    spent = reduce_traced(o, "s", ["o__cust"], [Measure("total", "sum", "o__price"), Measure("n", "count")], revision="r1")
    got = {r.s__cust: (int(r.s__total), r.s__n) for r in spent.frame().collect()}
    group = lambda i: i % 3 if i % 5 else None
    want = {k: [i for i in range(1, 21) if group(i) == k] for k in (0, 1, 2, None)}
    assert got == {k: (10 * sum(v), len(v)) for k, v in want.items()}
    joined = traced_join(spent, original(c.rows.select(F.col("c__id").alias("id")).where("id < 2"), "c", F.col("id")), JoinRule(["s__cust"], ["c__id"]))
    used = {(r.source, r.record) for r in lineage.used_originals(joined).collect()}
    assert used == {("c", 0), ("c", 1)} | {("o", i) for k in (0, 1) for i in want[k]}
    # a group of null keys has members too
    assert {r.record for r in lineage.used_originals(spent).collect()} == set(range(1, 21))
    empty = reduce_traced(original(o.frame().where("false").toDF("id", "cust", "price"), "o", F.col("id")), "s", ["o__cust"], [Measure("n", "count")])
    assert lineage.used_originals(empty).count() == 0


def runs(numbers):
    out = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1 and n % lineage.BLOCK:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


def test_row_sets_against_python(spark):
    draw = random.Random(3)
    held = {g: [draw.randrange(-70_000, 70_000) for _ in range(n)] + list(range(s, s + 40)) for g, n, s in (("x", 2000, 32760), ("y", 5, -20), (None, 0, 0))}
    rows = spark.createDataFrame([(g, p) for g, ps in held.items() for p in ps + ps[:3]], "g string, p long")
    sets = lineage.row_sets(rows, [F.col("g")], "p").cache()
    for g, ps in held.items():
        got = [[r["first"], r["last"]] for s in sets.where(F.col("group.g").eqNullSafe(F.lit(g))).orderBy("block").collect() for r in s.runs]
        assert got == runs(ps)
    whole = lineage.merged(sets).orderBy("block").collect()
    assert [[r["first"], r["last"]] for s in whole for r in s.runs] == runs(sum(held.values(), []))
    sizes = {r.g: r.n for r in sets.groupBy("group.g").agg(F.sum(lineage.size_of(F.col("runs"))).alias("n")).collect()}
    assert sizes == {g: len(set(ps)) for g, ps in held.items()}


def test_check_members(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(40_000)], "g long, p long")
    sets = lineage.row_sets(rows, [F.col("g")], "p").cache()
    assert lineage.check_members(sets, rows, "p").count() == 0
    assert [r.block for r in lineage.check_members(sets, rows.where("p <> 39999"), "p").collect()] == [1]  # a member that isn't there
    assert [r.block for r in lineage.check_members(lineage.row_sets(rows.where("p <> 3"), [F.col("g")], "p"), rows, "p").collect()] == [0]  # omitted
    twice = sets.union(lineage.row_sets(rows.where("p = 5").withColumn("g", F.lit(99).cast("long")), [F.col("g")], "p"))
    assert [(r.block, r.overlapping > 0) for r in lineage.check_members(twice, rows, "p").collect()] == [(0, True)]
    again = rows.union(rows.where("p = 5"))
    assert lineage.check_records(original(again, "s", F.col("p")), "s").first().record == 5
    assert lineage.revision_of(rows) == lineage.revision_of(rows.orderBy(F.desc("p"))) != lineage.revision_of(again)
