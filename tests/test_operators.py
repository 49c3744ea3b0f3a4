"""Guards and edge cases of the core operators, and the file readers."""

import io
import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone import sinks, streaming
from lodestone.functions import numbers, periods, text
from lodestone.operators import aggregates, catalogue, evidence, joins, ledger, retrieval
from lodestone.operators.aggregates import Measure
from lodestone.operators.joins import JoinRule, Scope
from lodestone.plans.composition import Composition, Step
from lodestone.sources import markup, snapshots, tables


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_keys_of_different_kinds_are_refused(spark):
    a, b = spark.createDataFrame([("1",)], "k string"), spark.createDataFrame([(1,)], "r long")
    with pytest.raises(ValueError, match="kinds"):
        joins.join(a, b, JoinRule(["k"], ["r"]))


def test_null_empty_and_blank_keys(spark):
    a = spark.createDataFrame([(None,), ("",), (" ",), ("01",), ("1",), ("　1",)], "k string")
    b = spark.createDataFrame([(None,), ("",), (" ",), ("1",)], "r string")
    assert {r.k for r in joins.join(a, b, JoinRule(["k"], ["r"])).collect()} == {" ", "1"}
    assert {r.k for r in joins.join(a, b, JoinRule(["k"], ["r"], trim=True)).collect()} == {"1", "　1"}


def test_scopes_count_every_pair(spark):
    left = spark.createDataFrame([(1, "k", "Seoul Jung"), (2, "k", None), (3, "k", "Busan")], "i long, k string, place string")
    right = spark.createDataFrame([(1, "k", "Seoul"), (2, "k", " ")], "j long, r string, area string")
    rule = JoinRule(["k"], ["r"], scopes=[Scope(["place"], ["area"], "right_prefix")])
    m = joins.metrics(left, right, rule, "i", "j").first()
    assert (m.candidate_pairs, m.scope0_matched, m.scope0_conflicts, m.scope0_unknown, m.output_rows) == (6, 1, 1, 4, 1)


def scoped(left, right, how):
    """All pairs of (id, key, place) that a scope admits, in plain Python."""
    begins = lambda a, b: a[: len(b)] == b
    holds = {"equal": lambda a, b: a == b, "left_prefix": lambda a, b: begins(b, a), "right_prefix": begins}[how]
    return sorted((i, j) for i, k, a in left for j, r, b in right if k == r and (a or "").split() and (b or "").split() and holds(a.split(), b.split()))


@pytest.mark.parametrize("how", ["equal", "left_prefix", "right_prefix"])
def test_scopes_are_keys(spark, how):
    places = ["a", "a b", " a  b ", "a\u3000b", "a bc", "a b c", "ab", "b a", None, "", " ", "a a", "a a a", "A b"]
    left = [(i, f"k{i // len(places)}", p) for i, p in enumerate(places * 2)]
    right = [(i, f"k{i % 3}", p) for i, p in enumerate(places * 3)]
    l, r = spark.createDataFrame(left, "i long, k string, place string"), spark.createDataFrame(right, "j long, r string, area string")
    rule = JoinRule(["k"], ["r"], scopes=[Scope(["place"], ["area"], how)])
    found = joins.join(l, r, rule)
    expected = scoped(left, right, how)
    assert found.columns == ["i", "k", "place", "j", "r", "area"]
    assert sorted((x.i, x.j) for x in found.collect()) == expected
    # what a pair is made for is kept: nothing is computed or refused above the join
    top = found.select("i", "j")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "split" not in top and "Filter" not in top
    m = joins.metrics(l, r, rule, "i", "j").first()
    blank = lambda rows: {x[0] for x in rows if not (x[2] or "").split()}
    both = [(i, j) for i, k, _ in left for j, r, _ in right if k == r]
    unknown = sum(i in blank(left) or j in blank(right) for i, j in both)
    assert (m.left_rows, m.right_rows, m.candidate_pairs, m.scope0_matched, m.scope0_unknown) == (len(left), len(right), len(both), len(expected), unknown)
    assert (m.scope0_conflicts, m.output_rows) == (len(both) - unknown - len(expected), len(expected))
    assert (m.matched_left, m.matched_right) == (len({i for i, _ in expected}), len({j for _, j in expected}))


def test_scoped_pairs_are_dealt_over_all_tasks(spark):
    """Few rows may make many pairs, so small tables aren't joined in one task."""
    rows = spark.range(0, 400, 1, 1).select("id", (F.col("id") % 40).alias("k"), F.lit("a b").alias("place"))
    other = spark.range(0, 400, 1, 1).select(F.col("id").alias("j"), (F.col("id") % 40).alias("r"), F.lit("a b").alias("area"))
    found = joins.join(rows, other, JoinRule(["k"], ["r"], scopes=[Scope(["place"], ["area"])])).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(x["count"] for x in found) == 4000 and len(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counts_of_many_pairs_make_none(spark):
    """Ten thousand million pairs are counted by groups of equal rows."""
    rows = spark.range(100_000).select("id", F.lit(1).alias("k"), F.concat(F.lit("a "), (F.col("id") % 5).cast("string")).alias("place"))
    other = rows.select(F.col("id").alias("j"), F.col("k").alias("r"), F.when(F.col("id") % 2 == 0, "a 1").alias("area"))
    m = joins.metrics(rows, other, JoinRule(["k"], ["r"], scopes=[Scope(["place"], ["area"])]), "id", "j").first()
    assert (m.candidate_pairs, m.scope0_matched, m.scope0_conflicts, m.scope0_unknown) == (10**10, 10**9, 4 * 10**9, 5 * 10**9)
    assert (m.matched_left, m.matched_right) == (20_000, 50_000)


def test_metrics_with_lineage_and_periods(spark):
    left = [(1, "k", 7, 1, 5), (2, "k", 8, 1, 5), (3, "k", None, 4, 9), (3, "k", 7, None, 9), (4, "z", 7, 1, 5), (5, None, 7, 1, 5)]
    right = [(1, "k", 7, 5, 6), (2, "k", None, 2, None), (2, "k", 8, 6, 9), (3, "y", 7, 1, 9)]
    l, r = spark.createDataFrame(left, "i long, k string, s long, a long, b long"), spark.createDataFrame(right, "j long, r string, t long, c long, d long")
    m = joins.metrics(l, r, JoinRule(["k"], ["r"], periods=(("a", "b"), ("c", "d")), lineage=[("s", "t")]), "i", "j").first()
    pairs = [(x, y) for x in left for y in right if x[1] == y[1]]
    agree = [(x, y) for x, y in pairs if x[2] is None or y[2] is None or x[2] == y[2]]
    known = [(x, y) for x, y in agree if None not in (x[3], x[4], y[3], y[4])]
    held = [(x, y) for x, y in known if max(x[3], y[3]) <= min(x[4], y[4])]
    assert (m.candidate_pairs, m.lineage_rejected, m.temporal_unknown, m.temporal_rejected, m.output_rows) == (len(pairs), len(pairs) - len(agree), len(agree) - len(known), len(agree) - len(held), len(held))
    assert (m.matched_left, m.matched_right) == (len({x[0] for x, _ in held}), len({y[0] for _, y in held}))


def test_periods(spark):
    first, last = periods.parse_period(F.lit("2024-02"), "month")
    assert [str(one(spark, c)) for c in (first, last)] == ["2024-02-01", "2024-02-29"]
    assert one(spark, periods.parse_period(F.lit("").cast("string"), "date")[0]) is None
    for bad in ("2024-13", "2024-2", "2024-02\n"):
        with pytest.raises(Exception, match="not a month"):
            one(spark, periods.parse_period(F.lit(bad), "month")[0])
    with pytest.raises(ValueError):
        periods.window("2024-02-02", "2024-02-01")
    unknown = periods.intersect(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date"))
    assert one(spark, unknown[0]) is None


def test_numbers(spark):
    assert str(one(spark, numbers.to_decimal(F.lit("-1,234,567.50"), grouped=True, scale=2))) == "-1234567.50"
    for bad, grouped in (("1,23", True), ("1e3", False), ("12\n", False), ("", False)):
        with pytest.raises(Exception, match="not a decimal"):
            one(spark, numbers.to_decimal(F.lit(bad), grouped=grouped))
    assert one(spark, numbers.to_decimal(F.lit(" - "), trim=True, null_tokens=["-"])) is None
    assert [one(spark, numbers.canonical(F.lit(x).cast("decimal(20,4)"))) for x in ("1.5000", "-0.0000", "100", "0.0100")] == ["1.5", "0", "100", "0.01"]
    with pytest.raises(Exception, match="bad coordinate"):
        one(spark, numbers.coordinate(F.lit("91"), 90))
    assert one(spark, numbers.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015114.35, abs=1)


def test_exact_sums_and_their_guards(spark):
    big = spark.createDataFrame([("9007199254740993", 1), ("1", 2)], "v string, origin long").withColumn("n", F.col("v").cast("decimal(38,0)"))
    assert int(aggregates.aggregate(big, [], [Measure("s", "sum", "n", scale=0)]).first().s) == 9007199254740994
    with pytest.raises(ValueError, match="convert"):
        aggregates.aggregate(big, [], [Measure("s", "sum", "v")])
    with pytest.raises(Exception, match="null value"):
        aggregates.aggregate(big.union(big.limit(1).withColumn("n", F.lit(None).cast("decimal(38,0)"))), [], [Measure("s", "sum", "n", scale=0)]).collect()
    with pytest.raises(Exception, match="counts twice"):
        aggregates.aggregate(big.withColumn("origin", F.lit(1)), [], [Measure("s", "sum", "n", "origin", 0)]).collect()
    with pytest.raises(ValueError, match="over 1 rows"):
        aggregates.at_most(big, 1)
    with pytest.raises(ValueError, match="empty"):
        aggregates.not_empty(big.limit(0))


def test_sums_keep_every_decimal_place(spark):
    rows = spark.createDataFrame([("0.004",), ("0.004",), ("0.004",), ("0.005",)], "v string").withColumn("d", F.col("v").cast("decimal(18,3)"))
    assert str(aggregates.aggregate(rows, [], [Measure("s", "sum", "d")]).first().s) == "0.017"
    with pytest.raises(Exception, match="decimal places"):
        aggregates.aggregate(rows, [], [Measure("s", "sum", "d", scale=2)]).collect()
    with pytest.raises(ValueError, match="exact scale"):
        aggregates.aggregate(rows.withColumn("x", F.col("d").cast("double")), [], [Measure("s", "sum", "x")])
    assert str(one(spark, numbers.to_decimal(F.lit("1.0500"), scale=2))) == "1.05"
    with pytest.raises(Exception, match="not a decimal"):
        one(spark, numbers.to_decimal(F.lit("1.005"), scale=2))


def test_recipes_are_checked(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, v long"), spark.createDataFrame([(1, 3)], "k long, w long")
    plan = Composition("a", [Step("b", ["a.k"], ["k"])], select={"v": "a.v", "w": "b.w"})
    assert plan.run({"a": a, "b": b}).collect() == [(2, 3)]
    for wrong in (Composition("a", select={"x": "a.none"}), Composition("a", group_by=["a.k"]), Composition("a", [Step("a", ["a.k"], ["k"])]), Composition("a", measures={"a__k": F.lit(1)})):
        with pytest.raises(ValueError):
            wrong.run({"a": a, "b": b})
    with pytest.raises(ValueError, match="empty"):
        Composition("a", [Step("b", ["a.v"], ["k"])], refuse_empty=True).run({"a": a, "b": b})
    many = a.union(a).union(a)
    with pytest.raises(ValueError, match="makes 3 pairs, over 2"):
        Composition("a", [Step("b", ["a.k"], ["k"])], most_pairs=2).run({"a": many, "b": b})
    assert Composition("a", [Step("b", ["a.k"], ["k"])], most_pairs=3).run({"a": many, "b": b}).count() == 3


def test_vectors_are_reused_only_for_the_same_recipe(spark):
    index = spark.createDataFrame([(1, "h", "m1"), (2, "h", "m2")], "pk long, doc_hash string, model string")
    now = spark.createDataFrame([(1, "h", "m2"), (2, "h", "m2")], "pk long, doc_hash string, model string")
    kept, pending = catalogue.reuse(index, now, ["model"])
    assert [r.pk for r in kept.collect()] == [2] and [r.pk for r in pending.collect()] == [1]


def test_nearest_equals_brute_force_everywhere(spark):
    rng = random.Random(6)
    spots = [(89.9, 10.0), (-89.99, -170.0), (0.0, 179.99), (0.1, -179.99), (37.5, 127.0)]
    near = lambda: (lambda la, lo: (max(-89.995, min(89.995, la + rng.gauss(0, 0.05))), lo + rng.gauss(0, 0.05)))(*rng.choice(spots))
    anywhere = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    c = [(i, *(near() if i % 2 else anywhere())) for i in range(600)] + [(1000 + i, 37.5, 127.0) for i in range(400)] + [(5000, None, 1.0)]
    a = [(i, *(near() if i % 3 else anywhere())) for i in range(60)] + [(90, 90.0, 0.0), (91, 37.5, 127.0), (92, None, None)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    found = joins.nearest(frame(a, "i long, la double, lo double"), frame(c, "j long, la double, lo double"), 3, ("i", "la", "lo"), ("j", "la", "lo"))

    def away(p, q):
        (la, lo), (lb, lp) = [tuple(map(math.radians, x)) for x in (p, q)]
        h = min(1, max(0, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))
        return round(2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 3)

    want = sorted((i, n, j) for i, *p in a if p[0] is not None for n, (_, j) in enumerate(sorted((away(p, q), j) for j, *q in c if q[0] is not None)[:3], 1))
    assert sorted((r.anchor_id, r["rank"], r.candidate_id) for r in found.collect()) == want
    few = joins.nearest(frame(a, "i long, la double, lo double"), frame(c[:2], "j long, la double, lo double"), 3, ("i", "la", "lo"), ("j", "la", "lo"))
    assert few.count() == 2 * 62


def test_vector_hits_of_equal_score_go_by_demand(spark):
    v = [(i, [1.0, 0.0], i % 3, 7 - i) for i in range(8)] + [(20, [0.0, 1.0], 9, 9)]
    frame = spark.createDataFrame(v, "pk long, vec array<float>, apply_count long, view_count long")
    got = retrieval.vector_top(frame, frame.where("pk = 0"), 4, retrieval.DEMAND).orderBy("rank").collect()
    assert [(r.pk, r.score) for r in got] == [(2, 1.0), (5, 1.0), (1, 1.0), (4, 1.0)]


def test_nearest_keeps_the_smaller_id_of_ties(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "i long, la double, lo double")
    c = spark.createDataFrame([(7, 1.0, 0.0), (5, 1.0, 0.0), (9, 0.5, 0.0)], "j long, la double, lo double")
    assert [r.candidate_id for r in joins.nearest(a, c, 2, ("i", "la", "lo"), ("j", "la", "lo")).orderBy("rank").collect()] == [9, 5]
    with pytest.raises(ValueError):
        joins.nearest(a, c, 11, ("i", "la", "lo"), ("j", "la", "lo"))


def test_reconciliation_kinds(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3), ("d", None), (" ", 1), (None, 1), ("e", 5)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("d", 4), ("f", 6), ("", 1)], "k string, v int")
    report = joins.reconcile(left, right, F.col("k"), F.col("k"), [("v", F.col("v"), F.col("v"))])
    assert {r.kind: r.rows for r in joins.reconcile_summary(report).collect()} == {"equal": 1, "different": 1, "missing": 1, "ambiguous_key": 1, "left_only": 1, "right_only": 1, "left_missing_key": 2, "right_missing_key": 1}


def test_terms_and_cells():
    assert text.query_terms("서울의 공원, parks of X!", fillers=("of",), particles=("의",)) == ["서울", "공원", "parks", "x"]
    assert text.query_terms("나의", particles=("의",)) == ["나의"]
    assert text.cell_index("AA12") == (27, 12) and text.display_width("한a") == 3 and text.bounded_utf8("한글", 4) == "한" and text.pointer_parts("/a~1b/~0") == ["a/b", "~"]
    assert text.sensitive_name("serviceKey") and not text.sensitive_name("region")
    with pytest.raises(ValueError):
        text.cell_index("1A")


def test_text_columns(spark):
    assert one(spark, text.trailing_digits(F.lit("Jung (12345)"), 5)) == "12345" and one(spark, text.trailing_digits(F.lit("Jung (1234)"), 5)) is None
    assert one(spark, text.listed(F.lit("csv, XLS;csv"))) == ["CSV", "XLS"]
    assert [one(spark, text.loose_integer(F.lit(x))) for x in ("1,234", "x", "")] == [1234, 0, 0]
    assert one(spark, text.preview(F.lit("a  b" * 100), 5)) == "a ba …"
    assert one(spark, text.required(F.lit("필수"))) and one(spark, text.deleted(F.lit(" Y ")))
    assert one(spark, text.edge_kinds(F.array(F.lit(" Spatial"), F.lit("x"), F.lit("spatial")))) == ["spatial"]


def test_one_missing_term_finds_nothing(spark):
    e = spark.createDataFrame([(1, "parks", "city", "x", "green", 1, 1, "2024")], "pk long, title string, org string, category string, description string, apply_count long, view_count long, modified_at string")
    assert retrieval.lexical(e, ["zzz"]).count() == 0
    assert retrieval.lexical(e, ["zzz", "parks"]).first().relaxed
    assert retrieval.clamp(None) == 20 and retrieval.clamp(500) == 100
    options = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("b", 1, 2), ("b", 9, 1)], "role string, node long, rank int")
    assert sorted((r.role, r.node) for r in retrieval.best_per_role(options).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 9)]


def test_catalogue_guard(spark):
    old, new = spark.createDataFrame([(100, 50)], "entries long, api long"), spark.createDataFrame([(95, 44)], "entries long, api long")
    assert catalogue.keeps_old(old, new) and not catalogue.keeps_old(old, old)


def test_ledger_is_idempotent(spark):
    rows = ledger.with_id(spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int"), ["k", "v"])
    assert ledger.append(rows.limit(0), rows).count() == 2 and ledger.append(rows, rows).count() == 0
    ok = ledger.consistent_sample(*(F.lit(x) for x in (2, 3, 4, 6, 2, 2)))
    assert one(spark, ok) and not one(spark, ledger.consistent_sample(*(F.lit(x) for x in (2, 3, 4, 9, 2, 2))))


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,값\n서울,\"1\n2\"\n부산,3\n".encode("euc_kr"))
    rows = tables.csv_files(spark, str(tmp_path / "a.csv")).orderBy("record").collect()
    assert [(r.record, r.line, r.fields) for r in rows] == [(1, 3, {"이름": "서울", "값": "1\n2"}), (2, 4, {"이름": "부산", "값": "3"})]
    for bad in (b"a,a\n1,2\n", b"a,b\n1\n", b"a, \n1,2\n", b"a,b\n\xff\xfe,1\n"):
        (tmp_path / "bad.csv").write_bytes(bad)
        with pytest.raises(Exception):
            tables.csv_files(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "c.csv").write_text('a,b\n1,""\n2,x\n')
    assert [tuple(r) for r in tables.csv_splittable(spark, str(tmp_path / "c.csv"), ["a", "b"]).collect()] == [("1", ""), ("2", "x")]
    assert tables.sniff("a\tb\tc,d") == "\t"


def test_zip_and_xlsx_readers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "k,v\na,1\n")
    assert tables.zip_csv(spark, str(tmp_path / "a.zip"), "d/x.csv").first().fields == {"k": "a", "v": "1"}
    assert tables.zip_members(spark, str(tmp_path / "a.zip")).first().fields["name"] == "d/x.csv"
    assert not tables.safe_member("../x") and not tables.safe_member("/x")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1.10</v></c></row><row r="2"><c r="B2" t="b"><v>1</v></c><c r="C2" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue().replace(b"#N/A", b"#N/A"))
    with pytest.raises(Exception, match="error"):
        tables.xlsx_rectangle(spark, str(tmp_path / "b.xlsx"), "S", "A1", "B2").collect()
    with pytest.raises(ValueError):
        tables.xlsx_cells(book.getvalue(), "T")


def test_dbf_schema(spark, tmp_path):
    field = lambda n, k, w: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15
    (tmp_path / "a.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 5, 32 + 64 + 1, 20) + b"\0" * 20 + field("NAME", "C", 10) + field("N", "N", 9) + b"\x0d")
    assert [(r.line, r.fields["name"], r.fields["type"]) for r in tables.dbf_schema(spark, str(tmp_path / "a.dbf")).collect()] == [(5, "NAME", "C"), (5, "N", "N")]


def test_markup(spark):
    html = "<html><script>x</script><div>a <b>bold</b><p>one<br>two</p>tail</div><table><tr><td>c</td></tr></table></html>"
    assert [t for _, t in markup.html_blocks(html)] == ["a bold", "one two", "tail", "c"]
    df = spark.createDataFrame([(1, "<r><i><a>1</a></i><i><a>2</a></i><z k='v'/></r>", '{"x": {"items": [{"k": 1.10, "ok": true, "n": null}]}}')], "id long, xml string, json string")
    assert markup.xml_as_json(df, "xml", "out").first().out == '{"i": [{"a": "1"}, {"a": "2"}], "z": ""}'
    assert markup.json_records(df, "id", "json").first().fields == {"k": "1.10", "ok": "true", "n": None}
    assert markup.record_array({"a~b": [{"x": 1}], "c": [{"y": 2}]}, "/a~0b") == [{"x": 1}]
    with pytest.raises(ValueError):
        markup.record_array({"a": [{"x": 1}], "c": [{"y": 2}]})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "한"), (2, None)], "i long, s string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"i":1,"s":"한"}', '{"i":2,"s":null}']
    assert '"s": null' in sinks.pretty_json(df)
    assert sinks.aligned_table(df).splitlines()[:2] == ["i  s", "1  한"]
    for n in (1, 2):
        sinks.write_snapshot(df.limit(n), str(tmp_path / "snap"))
        assert sinks.read_snapshot(spark, str(tmp_path / "snap")).count() == n
    before = sinks.read_snapshot(spark, str(tmp_path / "snap"))
    sinks.write_snapshot(df.limit(1), str(tmp_path / "snap"))
    assert before.count() == 2 and sinks.read_snapshot(spark, str(tmp_path / "snap")).count() == 1  # who reads the old one still can
    sinks.write_snapshot(df, str(tmp_path / "snap"))
    assert len(list((tmp_path / "snap").glob("version-*"))) == 2
    for short in (sinks.aligned_table, sinks.pretty_json):
        with pytest.raises(ValueError, match="over 1 rows"):
            short(df, 1)


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    # with a lateness that covers the whole table the stream's counts are the batch's
    q = streaming.windowed_counts(stream, "ts", "event_type", "1 hour", "10000 days").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, streaming.windowed_counts(events, "ts", "event_type").collect()))
    q = streaming.accept_once(stream, "user_id", "ts", "10000 days").writeStream.format("memory").queryName("accepted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("accepted").count() == events.select("user_id").distinct().count()
    assert streaming.sessions(events, "ts", "user_id").agg(F.sum("events")).first()[0] == events.count()


def test_evidence(spark):
    assert evidence.json_changes({"a": 1, "b": {"c/d": 2}, "e": 3}, {"a": 1, "b": {"c/d": 4}, "f": True}) == [{"op": "replace", "path": "/b/c~1d", "value": 4}, {"op": "remove", "path": "/e"}, {"op": "add", "path": "/f", "value": True}]
    df = spark.createDataFrame([('{"a": 1}', '{"a": 1.5}')], "x string, y string")
    assert evidence.state_delta(df, "x", "y").first().delta == '[{"op": "replace", "path": "/a", "value": 1.5}]'
    assert [one(spark, c) for c in evidence.approval(F.lit("개발: 자동 / 운영: 심의"))] == ["자동", "심의"]
    assert [one(spark, evidence.path_matches(F.lit("Response.Items.Code"), s)) for s in ("code", "items.code", "tems.code", "items")] == [True, True, False, False]
    assert one(spark, evidence.canonical_list(F.array(F.lit(" b"), F.lit("a"), F.lit("b"), F.lit(" ")))) == ["a", "b"]
    assert one(spark, evidence.checklist(F.array(F.lit("spatial"), F.lit("proxy")))) == ["same coordinate system", "stated transform"]
    hits = spark.createDataFrame([("a", 1, 1, True), ("b", 1, 1, True), ("b", 2, 2, True), ("c", 3, 1, False)], "axis string, pk long, rank int, exact boolean")
    assert sorted(map(tuple, evidence.first_exact_per_axis(hits).collect())) == [("a", 1), ("b", 2)]
    selected = spark.createDataFrame([(5, "x", 1), (6, "x", 2), (7, "y", 3), (9, "z", 4)], "pk long, role string, position int")
    pool, anchors = spark.createDataFrame([(5,), (6,), (7,)], "pk long"), spark.createDataFrame([(5, 1), (8, 2)], "pk long, position int")
    assert [tuple(r) for r in evidence.bridges(selected, pool, anchors).collect()] == [(8, 5, "x", 1), (5, 7, "y", 3)]
    assert evidence.replayed(selected, selected.orderBy(F.desc("pk"))) and not evidence.replayed(selected, pool)
    assert evidence.select_evidence(selected, "pk", pool, ["role"]).count() == 3


def test_snapshots(spark, tmp_path):
    import gzip
    import json

    entry = {"pk": "1", "title": "t", "apply_count": 3, "formats": ["CSV"]}
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(json.dumps(entry) + "\n" + json.dumps({**entry, "pk": "2"}) + "\n")
    assert snapshots.read_snapshot(spark, str(tmp_path / "a.json.gz")).count() == 2
    (tmp_path / "b.json").write_text(json.dumps(entry) + "\n" + json.dumps(entry))
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, str(tmp_path / "b.json"))
    (tmp_path / "p").mkdir()
    for n in (1, 2):
        (tmp_path / "p" / f"{n}.json").write_text(json.dumps({"page": n, "total": 2, "items": [{**entry, "pk": str(n)}]}))
    assert sorted(r.pk for r in snapshots.read_pages(spark, str(tmp_path / "p")).collect()) == ["1", "2"]
    (tmp_path / "p" / "2.json").unlink()
    with pytest.raises(ValueError):
        snapshots.read_pages(spark, str(tmp_path / "p"))
    rows = spark.createDataFrame([("1", "t", "o", "c", "d", "1,200", "x", "2024", "rest", "csv,XLS", "N"), ("2", "t", "o", "c", "d", "1", "2", "2024", "", "", "Y")], "pk string, title string, org string, category string, description string, apply_count string, view_count string, modified_at string, svc_type string, formats string, deleted string")
    assert [(r.apply_count, r.view_count, r.formats) for r in snapshots.monthly_entries(rows).collect()] == [(1200, 0, ["CSV", "XLS"])]
    versions = spark.createDataFrame([("a", "2024-01"), ("a", "2024-02")], "k string, edition string")
    assert snapshots.edition(versions, "k", "a", "2024-01").count() == 1
    with pytest.raises(ValueError):
        snapshots.edition(versions, "k", "a", "2024-03")
    shaped = spark.createDataFrame([(1, {"A": "title", "B": None}), (2, {"A": "name", "B": "count"}), (3, {"A": "x", "B": "5"})], "record long, fields map<string,string>")
    assert snapshots.header_row(shaped) == 2
    spark.createDataFrame([("1", "h", [1.0, 2.0])], "pk string, doc_hash string, vec array<float>").write.parquet(str(tmp_path / "v"))
    assert snapshots.read_vectors(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(ValueError):
        snapshots.read_vectors(spark, str(tmp_path / "v"), 3)
