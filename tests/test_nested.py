"""Profiles of nested fields and the accounting of comparisons, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import comparison, nested
from lodestone.operators.comparison import METRICS, Check, Key


def texts(spark, *values):
    return spark.createDataFrame([(v if v is None else v if isinstance(v, str) else json.dumps(v),) for v in values], "body string")


def walk(value, keys=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*keys, k))
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, keys)
    else:
        yield keys, value


def test_leaves_against_python(spark):
    docs = [{"a": [{"b": 1}, {"b": None}, [[{"c": {"d": "x"}}]], 7, "t"], "e": {}, "f": [], "g": True}, [1, [2]], 5, None, {"": {"a.b": "dot"}}, {"k": "null"}]
    got = [(tuple(r["keys"]), r.value) for r in nested.leaves(texts(spark, *docs), "body").collect()]
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    want = sorted(((k, plain(v)) for d in docs if d is not None for k, v in walk(d)), key=str)
    assert sorted(got, key=str) == want
    assert nested.leaves(texts(spark), "body").count() == 0


def profile(spark, fields, *docs):
    return {r.field: r for r in nested.profile_fields(texts(spark, *docs), "body", fields).collect()}


def test_profile(spark):
    body = {"response": {"items": [{"code": "11", "ym": None}, {"code": "11", "ym": "202401"}, {"code": "26"}], "Code": {"x": 1}}, "other": {"name": "n"}, "name": "m", "many": list(range(60))}
    got = profile(spark, [" CODE ", "ym", "name", "other.name", "ITEMS.ym", "none", "many", "ems.ym"], body, None, {"other": {"name": None}})
    code = got["CODE"]
    assert (code.matched, code.ambiguous, code["count"], code.nulls, code.distinct, code.duplicates, code["values"], code.paths) == (True, False, 3, 0, 2, 1, ["11", "26"], ["response.items.code"])
    assert (got["ym"]["count"], got["ym"].nulls, got["ITEMS.ym"]["count"], got["ems.ym"].matched) == (1, 1, 1, False)
    assert (got["name"].ambiguous, got["name"].path_count, got["name"]["count"], got["name"]["values"], got["name"].paths) == (True, 2, 0, [], ["name", "other.name"])
    assert (got["other.name"]["count"], got["other.name"].nulls, got["other.name"].ambiguous) == (1, 1, False)
    assert (got["none"].matched, got["none"].paths, got["none"].path_count) == (False, [], 0)
    assert (got["many"].distinct, got["many"].more_values, len(got["many"]["values"])) == (60, True, 50)


def test_profile_refusals(spark):
    with pytest.raises(ValueError):
        nested.selectors(["a", " "])
    with pytest.raises(ValueError):
        nested.selectors([str(i) for i in range(9)])
    with pytest.raises(ValueError):
        nested.selectors(["x" * 81])
    assert nested.selectors(["b", "A", "a ", "B"]) == ["b", "A"]
    deep = "1"
    for _ in range(40):
        deep = '{"a":' + deep + "}"
    with pytest.raises(ValueError, match="levels"):
        nested.leaves(texts(spark, deep), "body")
    with pytest.raises(Exception):
        nested.leaves(texts(spark, "{"), "body").collect()
    assert profile(spark, ["a"])["a"].matched is False


CHECKS = [Check("total", "v", "w"), Check("grouped", "t", "u", grouped=True)]


def report(spark, left, right):
    l = spark.createDataFrame(left, "k string, v decimal(10,2), t string")
    r = spark.createDataFrame(right, "k string, w long, u string")
    return comparison.compare(l, r, [Key("k", "digits", 3)], [Key("k", "trim")], CHECKS)


def test_thirteen_metrics(spark):
    from decimal import Decimal as D

    left = [("A (001)", D("5.00"), "1,000"), ("B (002)", D("6.10"), "x"), ("C (003)", None, "3"), ("D (004)", D(1), "1"), ("D2 (004)", D(1), "1"), ("E", D(1), "1"), (None, D(1), "1"), (" ", D(1), "1"), ("F (006)", D(1), "1"), ("G (01)", D(1), "1"), ("x" * 3000, D(1), "1")]
    right = [(" 001", 5, "1,000"), ("002", 6, "2"), ("003", 3, None), ("004", 1, "1"), ("007", 1, "1"), ("007", 1, "1"), ("008", 1, "1"), ("", 1, "1")]
    found = report(spark, left, right)
    got = {r.metric: r.value for r in comparison.summary(found, CHECKS).collect()}
    assert [got[m] for m in METRICS] == [11, 8, 3, 1, 1, 7, 4, 2, 6, 2, 1, 2, 1]
    assert {r.check: tuple(r)[1:] for r in comparison.by_check(found, CHECKS).collect()} == {"total": (1, 1, 1, 0), "grouped": (1, 0, 1, 1)}
    kinds = {r.kind: (r.left_members, r.right_members) for r in found.where("key is null").collect()}
    assert kinds == {"left_missing_key": (2, 0), "left_invalid_key": (3, 0), "right_missing_key": (0, 1)}
    # every row of both sides is under one metric
    assert got["left_rows"] == got["matched_pairs"] + got["left_only"] + got["left_unresolved"] and got["right_rows"] == got["matched_pairs"] + got["right_only"] + got["right_unresolved"]
    assert got["comparisons"] == got["checks"] * got["matched_pairs"] == sum(got[s] for s in comparison.STATUSES)


def test_empty_comparison(spark):
    found = report(spark, [], [])
    assert [r.value for r in comparison.summary(found, CHECKS).orderBy("ordinal").collect()] == [0] * 7 + [2] + [0] * 5
    assert {tuple(r)[1:] for r in comparison.by_check(found, CHECKS).collect()} == {(0, 0, 0, 0)}
    with pytest.raises(ValueError):
        comparison.compare(spark.range(1), spark.range(1), [Key("id")], [Key("id")], [])


def test_coverage(spark):
    whole = [(i, f) for i in range(1, 14) for f in ("metric", "value")]
    rows = [("c", "all", *x) for x in whole + whole[:3]] + [("c", "less", *x) for x in whole if x != (13, "value")] + [("c", "rest", 99, "metric"), ("c", "rest", 1, "kind")] + [("d", "all", 13, "value")]
    got = {(r.comparison, r.target): (r.complete, r.lacking) for r in comparison.coverage(spark.createDataFrame(rows, "comparison string, target string, ordinal int, field string")).collect()}
    assert got == {("c", "all"): (True, []), ("c", "less"): (False, ["invalid"]), ("c", "rest"): (False, list(METRICS)), ("d", "all"): (False, list(METRICS))}
