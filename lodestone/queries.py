"""The registry: a query over the driver's tables for each operator of the relational, retrieval and catalogue cores, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, periods, text, vectors
from .operators import aggregates, catalogue, comparison, evidence, joins, ledger, lineage, nested, retrieval
from .operators.aggregates import Measure
from .operators.joins import JoinRule, Scope
from .plans.composition import Composition, Step
from .sources import csv_scan, markup, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- composition -------------------------------------------------------------------------------------------------


@query("""SELECT r_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q_compose_region_revenue(spark, sf_dir):
    """A four-source path, exact sums by region."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}
    plan = Composition(
        base="orders",
        steps=[Step("customer", ["orders.o_custkey"], ["c_custkey"]), Step("nation", ["customer.c_nationkey"], ["n_nationkey"]), Step("region", ["nation.n_regionkey"], ["r_regionkey"])],
        measures={"price": F.col("orders__o_totalprice").cast("decimal(18,2)")},
        group_by=["region.r_name"],
        aggregates=[Measure("orders", "count"), Measure("revenue", "sum", "price")],
        select={"r_name": "region.r_name", "orders": "orders", "revenue": "revenue"},
    )
    return plan.run(t)


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def q_compose_three_source_path(spark, sf_dir):
    """J1, J3, P1, P2."""
    t = {n: table(spark, sf_dir, n) for n in ("supplier", "nation", "region")}
    names = {"s_suppkey": "supplier.s_suppkey", "s_name": "supplier.s_name", "n_name": "nation.n_name", "r_name": "region.r_name"}
    return Composition("supplier", [Step("nation", ["supplier.s_nationkey"], ["n_nationkey"]), Step("region", ["nation.n_regionkey"], ["r_regionkey"])], select=names).run(t)


@query("""SELECT c_custkey, n_name FROM (SELECT c_custkey, ' ' || c_nationkey || '  ' AS k FROM customer) c JOIN (SELECT n_name, n_nationkey || ' ' AS k FROM nation) n ON trim(c.k) = trim(n.k)""")
def q_join_trim_keys(spark, sf_dir):
    """Keys that match after the outer white space is trimmed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit("  ")).alias("k"))
    n = table(spark, sf_dir, "nation").select("n_name", F.concat(F.col("n_nationkey").cast("string"), F.lit(" ")).alias("nk"))
    return joins.join(c, n, JoinRule(["k"], ["nk"], trim=True)).select("c_custkey", "n_name")


_GAPPED = "CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 11 = 0 THEN '' ELSE CAST({k} AS VARCHAR) END"


def _gapped(c: str):
    return F.when(F.col(c) % 7 == 0, None).when(F.col(c) % 11 == 0, "").otherwise(F.col(c).cast("string"))


@query(f"""SELECT o_orderkey, l_linenumber, count(*) AS n FROM (SELECT o_orderkey, {_GAPPED.format(k='o_orderkey')} AS k FROM orders) o
JOIN (SELECT l_linenumber, {_GAPPED.format(k='l_orderkey')} AS k FROM lineitem) l ON o.k = l.k WHERE o.k <> '' GROUP BY 1, 2""")
def q_join_null_blank_keys(spark, sf_dir):
    """Null and empty keys never match."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", _gapped("o_orderkey").alias("k"))
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", _gapped("l_orderkey").alias("lk"))
    return joins.join(o, li, JoinRule(["k"], ["lk"])).groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM customer) AS left_rows, (SELECT count(*) FROM orders) AS right_rows, count(*) AS candidate_pairs,
CAST(0 AS BIGINT) AS lineage_rejected, count(*) AS output_rows, count(DISTINCT c_custkey) AS matched_left, count(DISTINCT o_orderkey) AS matched_right FROM customer JOIN orders ON c_custkey = o_custkey""")
def q_join_metrics(spark, sf_dir):
    """J7, J8."""
    return joins.metrics(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), JoinRule(["c_custkey"], ["o_custkey"]), "c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_unmatched_left(spark, sf_dir):
    """J9, U5."""
    left, _ = joins.unmatched(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), JoinRule(["c_custkey"], ["o_custkey"]), "c_custkey", "o_orderkey")
    return left.select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey)")
def q_unmatched_right(spark, sf_dir):
    """J9."""
    li = table(spark, sf_dir, "lineitem").withColumn("line", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    _, right = joins.unmatched(table(spark, sf_dir, "events"), li, JoinRule(["event_id"], ["l_orderkey"]), "event_id", "line")
    return right.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT 'left' AS side, CAST(c_custkey AS VARCHAR) AS id, f AS field, CASE f WHEN 'c_name' THEN c_name ELSE c_mktsegment END AS value
FROM customer, (VALUES ('c_name'), ('c_mktsegment')) t(f) WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)
UNION ALL SELECT 'right', CAST(event_id AS VARCHAR), 'event_type', event_type FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE user_id = c_custkey)""")
def q_unmatched_report(spark, sf_dir):
    """Both sides' unmatched rows in one shape."""
    return joins.unmatched_report(table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"), JoinRule(["c_custkey"], ["user_id"]), "c_custkey", "event_id", ["c_name", "c_mktsegment"], ["event_type"])


@query("""SELECT count(*) AS overlap_keys, CAST(sum(nl * nr) AS BIGINT) AS joined_rows, max(nl) AS most_left, max(nr) AS most_right
FROM (SELECT o_orderkey AS k, count(*) AS nl FROM orders GROUP BY 1) JOIN (SELECT l_orderkey AS k, count(*) AS nr FROM lineitem GROUP BY 1) USING (k)""")
def q_join_expansion_precheck(spark, sf_dir):
    """Pairs counted before they are made."""
    return joins.expansion(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"])


# --- scope and periods -------------------------------------------------------------------------------------------


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    whole = p.select("p_partkey", "p_size", F.col("p_name").alias("name"))
    other = p.select(F.col("p_partkey").alias("q_partkey"), F.col("p_size").alias("q_size"), F.col("p_name").alias("q_name"), F.split("p_name", " ")[0].alias("first"), F.element_at(F.split("p_name", " "), -1).alias("last"))
    return whole, other


_PAIRS = "SELECT a.p_partkey, b.p_partkey AS q_partkey FROM part a JOIN part b ON a.p_size = b.p_size AND "


@query(_PAIRS + "list_filter(string_split(a.p_name, ' '), lambda x: x <> '') = list_filter(string_split(b.p_name, ' '), lambda x: x <> '')")
def q_scope_equal_tokens(spark, sf_dir):
    """P11, J4."""
    a, b = _parts(spark, sf_dir)
    return joins.join(a, b, JoinRule(["p_size"], ["q_size"], scopes=[Scope(["name"], ["q_name"])])).select("p_partkey", "q_partkey")


@query(_PAIRS + "string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1]")
def q_scope_left_prefix(spark, sf_dir):
    """The right side's tokens begin the left side's."""
    a, b = _parts(spark, sf_dir)
    return joins.join(a, b, JoinRule(["p_size"], ["q_size"], scopes=[Scope(["name"], ["first"], "right_prefix")])).select("p_partkey", "q_partkey")


@query("""SELECT count(*) AS candidate_pairs, count(*) FILTER (string_split(a.p_name, ' ')[1] = string_split(b.p_name, ' ')[1]) AS matched
FROM part a JOIN part b ON a.p_size = b.p_size""")
def q_scope_counts(spark, sf_dir):
    """Every candidate pair is counted."""
    a, b = _parts(spark, sf_dir)
    m = joins.metrics(a, b, JoinRule(["p_size"], ["q_size"], scopes=[Scope(["name"], ["first"], "right_prefix")]), "p_partkey", "q_partkey")
    return m.select("candidate_pairs", F.col("scope0_matched").alias("matched"))


_SEGMENTS = {"AUTOMOBILE": "auto", "BUILDING": "build", "FURNITURE": "furn"}


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'build' WHEN 'FURNITURE' THEN 'furn' END AS code FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')")
def q_scope_vocabulary(spark, sf_dir):
    """Tokens mapped by a fixed table; unmapped ones are unknown and match nothing."""
    c = table(spark, sf_dir, "customer").withColumn("token", text.tokens(F.col("c_mktsegment"))[0])
    words = spark.createDataFrame(list(_SEGMENTS.items()), "word string, code string")
    return joins.join(c, words, JoinRule(["token"], ["word"])).select("c_custkey", "code")


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(CAST(date_trunc('month', o_orderdate) AS DATE), CAST(l_shipdate AS DATE)) AS first,
least(last_day(o_orderdate), CAST(l_shipdate AS DATE)) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey % 13 <> 0 AND CAST(l_shipdate AS DATE) BETWEEN CAST(date_trunc('month', o_orderdate) AS DATE) AND last_day(o_orderdate)""")
def q_temporal_overlap_month(spark, sf_dir):
    """A month against a day; unknown periods are rejected."""
    month = F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM"))
    first, last = periods.parse_period(month, "month")
    o = table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))
    day = F.to_date("l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.alias("rfirst"), day.alias("rlast"))
    return joins.join(o, li, JoinRule(["o_orderkey"], ["l_orderkey"], periods=(("first", "last"), ("rfirst", "rlast")))).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "first", "last")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-08-31'")
def q_temporal_window_filter(spark, sf_dir):
    """P14, F9."""
    a, b = periods.window("1996-03-01", "1996-08-31")
    day = F.to_date("o_orderdate")
    first, last = periods.intersect(day, day, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "orders").where(periods.overlaps(first, last)).select("o_orderkey")


@query("""SELECT count(*) FILTER (k % 13 = 0 OR NOT s BETWEEN d AND d + 30) AS temporal_rejected, count(*) FILTER (k % 13 = 0) AS temporal_unknown, count(*) FILTER (k % 13 <> 0 AND s BETWEEN d AND d + 30) AS output_rows
FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(l_shipdate AS DATE) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""")
def q_temporal_rejections(spark, sf_dir):
    """Validity of 30 days against a day; unknown ones count as rejected too."""
    known = F.when(F.col("o_orderkey") % 13 != 0, F.to_date("o_orderdate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", known.alias("first"), F.date_add(known, 30).alias("last"))
    day = F.to_date("l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("rid", F.lit(1)).select("l_orderkey", "rid", day.alias("rfirst"), day.alias("rlast"))
    m = joins.metrics(o, li, JoinRule(["o_orderkey"], ["l_orderkey"], periods=(("first", "last"), ("rfirst", "rlast"))), "o_orderkey", "rid")
    return m.select("temporal_rejected", "temporal_unknown", "output_rows")


# --- measures and aggregates -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(38,2)) AS price FROM orders")
def q_measure_grouped(spark, sf_dir):
    """numbers with grouping commas, null tokens."""
    shown = F.when(F.col("o_orderkey") % 17 == 0, "-").otherwise(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    o = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))
    return o.select("o_orderkey", numbers.to_decimal(F.col("shown"), grouped=True, scale=2, trim=True, null_tokens=["-", ""]).alias("price"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS balance FROM customer")
def q_measure_decimal(spark, sf_dir):
    """plain signed decimals."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("shown"))
    return c.select("c_custkey", numbers.to_decimal(F.col("shown"), scale=2).alias("balance"))


@query("""SELECT l_linenumber, count(total) AS known, CAST(sum(total) AS DECIMAL(38,2)) AS total FROM (SELECT l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_quantity AS DECIMAL(18,2)) END
+ CAST(l_tax AS DECIMAL(18,2)) AS total FROM lineitem) GROUP BY 1""")
def q_measure_sum_fields(spark, sf_dir):
    """A null term makes the sum null."""
    a = F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity").cast("decimal(18,2)"))
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", numbers.sum_fields([a, F.col("l_tax").cast("decimal(18,2)")]).alias("total"))
    return li.groupBy("l_linenumber").agg(F.count("total").alias("known"), F.sum("total").cast("decimal(38,2)").alias("total"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, count(*) AS orders, count(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END) AS known FROM orders GROUP BY 1")
def q_group_null_kept(spark, sf_dir):
    """A1, A2, R3."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))
    return aggregates.aggregate(o, ["priority"], [Measure("orders", "count"), Measure("known", "count", "status")])


@query("SELECT o_custkey, count(*) AS rows, count(DISTINCT o_orderkey) AS records FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) <> count(DISTINCT o_orderkey)")
def q_sum_fanout_guard(spark, sf_dir):
    """The groups in which a sum would count a record twice."""
    both = joins.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), JoinRule(["o_orderkey"], ["l_orderkey"]))
    return aggregates.fan_out(both, ["o_custkey"], "o_orderkey")


@query("""SELECT o_orderkey, lines, quantity, members FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS quantity, count(*) AS members FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_reduction_then_join(spark, sf_dir):
    """A5, J1."""
    li = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("decimal(18,2)"))
    reduced = aggregates.reduce_source(li, ["l_orderkey"], [Measure("lines", "count"), Measure("quantity", "sum", "quantity")])
    return joins.join(table(spark, sf_dir, "orders"), reduced, JoinRule(["o_orderkey"], ["l_orderkey"])).select("o_orderkey", "lines", "quantity", "members")


@query("""SELECT l_suppkey, count(*) AS lines, count(*) AS members, CASE WHEN count(*) FILTER (d IS NULL) = 0 THEN max(d) END AS first, CASE WHEN count(*) FILTER (d IS NULL) = 0 THEN min(d + 400) END AS last
FROM (SELECT l_suppkey, CASE WHEN l_orderkey % 997 <> 0 THEN CAST(l_shipdate AS DATE) END AS d FROM lineitem) GROUP BY 1""")
def q_reduction_period(spark, sf_dir):
    """A group's period is what all its members share."""
    d = F.when(F.col("l_orderkey") % 997 != 0, F.to_date("l_shipdate"))
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", d.alias("first"), F.date_add(d, 400).alias("last"))
    return aggregates.reduce_source(li, ["l_suppkey"], [Measure("lines", "count")], ("first", "last"))


_LAT, _LON = "(({k} * 37) % 17901) / 100.0 - 89.5", "(({k} * 91) % 35901) / 100.0 - 179.5"


@query(f"""WITH a AS (SELECT s_suppkey AS k, CAST({_LAT.format(k='s_suppkey')} AS DOUBLE) AS la, CAST({_LON.format(k='s_suppkey')} AS DOUBLE) AS lo FROM supplier),
c AS (SELECT c_custkey AS k, CAST({_LAT.format(k='c_custkey')} AS DOUBLE) AS la, CAST({_LON.format(k='c_custkey')} AS DOUBLE) AS lo FROM customer),
p AS (SELECT a.k AS anchor_id, c.k AS candidate_id, least(1.0, greatest(0.0, pow(sin(radians(c.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(c.la)) * pow(sin(radians(c.lo - a.lo) / 2), 2))) AS h FROM a, c)
SELECT anchor_id, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY 2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)), candidate_id) AS INT) AS rank, candidate_id, round(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)), 3) AS distance_m FROM p QUALIFY rank <= 3""")
def q_nearest_k3(spark, sf_dir):
    """J11, W1, F10."""
    place = lambda k, e: F.expr(e.format(k=k)).cast("double")
    a = table(spark, sf_dir, "supplier").select("s_suppkey", place("s_suppkey", _LAT).alias("lat"), place("s_suppkey", _LON).alias("lon"))
    c = table(spark, sf_dir, "customer").select("c_custkey", place("c_custkey", _LAT).alias("clat"), place("c_custkey", _LON).alias("clon"))
    return joins.nearest(a, c, 3, ("s_suppkey", "lat", "lon"), ("c_custkey", "clat", "clon")).withColumn("distance_m", F.round("distance_m", 3))


_COMPARED = """WITH l AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 50 = 1),
lg AS (SELECT CAST(k AS VARCHAR) AS key, count(*) AS nl, any_value(v) AS lv FROM l GROUP BY 1), rg AS (SELECT CAST(k AS VARCHAR) AS key, count(*) AS nr, any_value(v) AS rv FROM r GROUP BY 1),
b AS (SELECT key, CASE WHEN coalesce(nl, 0) > 1 OR coalesce(nr, 0) > 1 THEN 'ambiguous_key' WHEN nr IS NULL THEN 'left_only' WHEN nl IS NULL THEN 'right_only' WHEN lv = rv THEN 'equal' ELSE 'different' END AS kind FROM lg FULL JOIN rg USING (key))
"""


def _compared(spark, sf_dir):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    left = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("decimal(18,2)").alias("v"))
    c = table(spark, sf_dir, "customer")
    right = c.where("c_custkey % 3 != 0").select("c_custkey", money("c_acctbal").alias("v")).union(c.where("c_custkey % 50 = 1").select("c_custkey", F.lit(1).cast("decimal(18,2)")))
    return joins.reconcile(left, right, F.col("o_custkey"), F.col("c_custkey"), [("amount", F.col("v"), F.col("v"))])


@query(_COMPARED + "SELECT kind, key FROM b")
def q_compare_sources(spark, sf_dir):
    """J12, R11."""
    return _compared(spark, sf_dir).select("kind", "key")


@query(_COMPARED + "SELECT kind, count(*) AS rows FROM b GROUP BY 1")
def q_compare_summary(spark, sf_dir):
    """A7, U2."""
    return joins.reconcile_summary(_compared(spark, sf_dir))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer")
def q_key_trailing_digits(spark, sf_dir):
    """J13."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" ("), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(")")).alias("label"))
    return c.select("c_custkey", text.trailing_digits(F.col("label"), 6).alias("code"))


@query("SELECT c_custkey FROM customer WHERE lpad(CAST(c_custkey AS VARCHAR), 10, '0') LIKE '0000001%'")
def q_code_prefix(spark, sf_dir):
    """P7."""
    label = F.concat("c_name", F.lit(" ("), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(")"))
    return table(spark, sf_dir, "customer").where(text.code_prefix(label, "0000001")).select("c_custkey")


@query("""SELECT 'p_name' AS "column", count(*) FILTER (p_name IS NULL) AS nulls, count(p_name) AS strings, count(*) FILTER (p_name <> trim(p_name)) AS trimmed, count(*) FILTER (trim(p_name) = '') AS blank,
CAST(min(len(string_split(trim(p_name), ' '))) AS INT) AS min_tokens, CAST(max(len(string_split(trim(p_name), ' '))) AS INT) AS max_tokens, count(*) FILTER (regexp_full_match(p_name, '-?[0-9]+([.][0-9]+)?')) AS decimal, count(*) FILTER (regexp_full_match(p_name, '-?[0-9]{1,3}(,[0-9]{3})*([.][0-9]+)?')) AS grouped, 'text' AS kinds FROM part
UNION ALL SELECT 'size_text', 0, count(*), 0, 0, 1, 1, count(*), count(*), 'number' FROM part
UNION ALL SELECT 'size', count(*) FILTER (p_size % 7 = 0), 0, 0, 0, NULL, NULL, 0, 0, 'null,number' FROM part""")
def q_profile_columns(spark, sf_dir):
    """A8, A9."""
    p = table(spark, sf_dir, "part").select("p_name", F.col("p_size").cast("string").alias("size_text"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"))
    return aggregates.profile_columns(p).withColumn("kinds", F.concat_ws(",", "kinds"))


@query("""SELECT count(v) AS count, count(*) FILTER (v IS NULL) AS nulls, count(DISTINCT v) AS distinct, count(v) - count(DISTINCT v) AS duplicates,
(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT json_extract_string(props, '$.k') AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL ORDER BY v LIMIT 50)) AS values FROM (SELECT json_extract_string(props, '$.k') AS v FROM events)""")
def q_profile_json(spark, sf_dir):
    """A10."""
    found = aggregates.profile_json(table(spark, sf_dir, "events"), "props", "k")
    return found.withColumn("values", F.concat_ws(",", "values"))


@query("""WITH l AS (SELECT o_custkey AS k, count(*) AS nl FROM orders GROUP BY 1), r AS (SELECT user_id AS k, count(*) AS nr FROM events GROUP BY 1)
SELECT count(nl) AS left_distinct, count(nr) AS right_distinct, count(*) FILTER (nl IS NOT NULL AND nr IS NOT NULL) AS overlap, CAST(coalesce(sum(nl * nr), 0) AS BIGINT) AS joined_rows, max(nl) AS most_left, max(nr) AS most_right FROM l FULL JOIN r USING (k)""")
def q_overlap_stats(spark, sf_dir):
    """J14, U4."""
    return joins.overlap_statistics(table(spark, sf_dir, "orders"), table(spark, sf_dir, "events"), "o_custkey", "user_id")


@query("""SELECT min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS rows, max(o_orderkey) - min(o_orderkey) + 1 = count(DISTINCT o_orderkey) AND count(*) = count(DISTINCT o_orderkey) AS complete FROM orders""")
def q_extent_complete(spark, sf_dir):
    """A20."""
    return aggregates.contiguous(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT count(*) AS scanned, count(*) FILTER (p_size > 25) AS matched, least(count(*) FILTER (p_size > 25), 1000) AS returned FROM part")
def q_scan_counts(spark, sf_dir):
    """A23, S2."""
    return tables.scan_counts(table(spark, sf_dir, "part"), F.col("p_size") > 25, 1000).withColumn("returned", F.col("returned").cast("long"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size <= 10")
def q_csv_select_equals(spark, sf_dir):
    """P4."""
    p = table(spark, sf_dir, "part")
    brand = p.agg(F.min("p_brand")).first()[0]
    return tables.select_equal(p.where("p_size <= 10"), {"p_brand": brand}).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_csv_select_in(spark, sf_dir):
    """P5."""
    return tables.select_in(table(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey")


@query("""SELECT unnest(['positive', 'dated', 'known']) AS "check", unnest([bool_and(o_totalprice > 0), bool_and(o_orderdate IS NOT NULL), bool_and(o_orderstatus = 'F')]) AS passed FROM orders""")
def q_requirement_checks(spark, sf_dir):
    """A19, E2."""
    return aggregates.require(table(spark, sf_dir, "orders"), {"positive": F.col("o_totalprice") > 0, "dated": F.col("o_orderdate").isNotNull(), "known": F.col("o_orderstatus") == "F"})


# --- catalogue and retrieval -------------------------------------------------------------------------------------

_ENTRY_SQL = """WITH e AS (SELECT doc_id AS pk, source || ' ' || substr(text, 1, 40) AS title, source AS org, lang AS category, text AS description, n_chars AS apply_count, doc_id AS view_count,
CAST(DATE '2024-01-01' + CAST(doc_id % 700 AS INT) AS VARCHAR) AS modified_at FROM documents),
"""


def entries(spark, sf_dir) -> DataFrame:
    modified = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 700).cast("int")).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pk"), F.concat("source", F.lit(" "), F.substring("text", 1, 40)).alias("title"), F.col("source").alias("org"), F.col("lang").alias("category"),
        F.col("text").alias("description"), F.col("n_chars").alias("apply_count"), F.col("doc_id").alias("view_count"), modified.alias("modified_at"),
    )


def _score_sql(terms, name="s", planned=False):
    n = "lower(concat_ws(' ', title, org, category))"
    matched = " + ".join(f"CASE WHEN contains({n}, '{t}') OR contains(lower(description), '{t}') THEN 1 ELSE 0 END" for t in terms)
    title = " + ".join(f"CASE WHEN contains({n}, '{t}') THEN 1 ELSE 0 END" for t in terms)
    least = (len(terms) + 1) // 2 if planned and len(terms) >= 3 else 1
    return f"{name}0 AS (SELECT *, {matched} AS matched, {title} AS in_title FROM e), {name} AS (SELECT * FROM {name}0 WHERE CASE WHEN (SELECT max(matched) FROM {name}0) = {len(terms)} THEN matched = {len(terms)} ELSE {len(terms)} > 1 AND matched >= {least} END)"


_DEMAND = "matched + 2 * in_title DESC, in_title DESC, matched DESC, apply_count DESC, view_count DESC, pk"
_NEWEST = "matched + 2 * in_title DESC, in_title DESC, matched DESC, modified_at DESC, apply_count DESC, view_count DESC, pk"
_HITS = "CAST(matched AS INT) AS matched, CAST(in_title AS INT) AS in_title"


def _ranked_sql(terms, order, limit, name="s", planned=False):
    return f"{_score_sql(terms, name, planned)}, {name}r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {name} QUALIFY rank <= {limit})"


@query(_ENTRY_SQL + _ranked_sql(["the", "of"], _DEMAND, 20) + f" SELECT pk, {_HITS}, CAST(rank AS INT) AS rank FROM sr")
def q_lexical_strict(spark, sf_dir):
    """R-1, F14, T1, T2."""
    return retrieval.lexical(entries(spark, sf_dir), ["the", "of"]).select("pk", "matched", "in_title", "rank")


@query(_ENTRY_SQL + _ranked_sql(["src7", "license", "zzzz"], _DEMAND, 20) + f" SELECT pk, {_HITS}, CAST(rank AS INT) AS rank FROM sr")
def q_lexical_relaxed(spark, sf_dir):
    """R-1: no entry has all terms, so any will do."""
    return retrieval.lexical(entries(spark, sf_dir), ["src7", "license", "zzzz"]).select("pk", "matched", "in_title", "rank")


@query(_ENTRY_SQL + _ranked_sql(["the", "src1"], _NEWEST, 20) + " SELECT pk, modified_at, CAST(rank AS INT) AS rank FROM sr")
def q_rank_recent(spark, sf_dir):
    """T3."""
    return retrieval.lexical(entries(spark, sf_dir), ["the", "src1"], ranking="recent").select("pk", "modified_at", "rank")


_TURN = " SELECT pk, CAST(row_number() OVER (ORDER BY rank, bucket, pk) AS INT) AS position FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pk ORDER BY rank, bucket) = 1) QUALIFY position <= 20"


@query(_ENTRY_SQL + _score_sql(["the", "src1"]) + f""", u AS (SELECT pk, 0 AS bucket, row_number() OVER (ORDER BY {_DEMAND}) AS rank FROM s QUALIFY rank <= 20 UNION ALL
SELECT pk, 1, row_number() OVER (ORDER BY {_NEWEST}) AS rank FROM s QUALIFY rank <= 20)""" + _TURN)
def q_rank_balanced(spark, sf_dir):
    """T4, W3, U3."""
    return retrieval.lexical(entries(spark, sf_dir), ["the", "src1"], ranking="balanced").select("pk", "position")


_AXES = [("base", ["the", "src2"]), ("bridge", ["license", "version", "src3"]), ("other", ["der"])]


@query(_ENTRY_SQL + ", ".join(_ranked_sql(t, _DEMAND, 20, f"x{i}", True) for i, (_, t) in enumerate(_AXES)) + ", u AS (" + " UNION ALL ".join(f"SELECT pk, {i} AS bucket, rank FROM x{i}r" for i in range(3)) + ")" + _TURN)
def q_planned_round_robin(spark, sf_dir):
    """R-2, R-3, U6."""
    return retrieval.planned(entries(spark, sf_dir), _AXES).select("pk", "position")


_DOT = "list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _vectors(spark, sf_dir):
    """Vectors with the demand of the entry of their number."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pk"), F.col("embedding").alias("vec")).where(vectors.valid(F.col("vec"), 64))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), F.col("n_chars").alias("apply_count"), F.col("doc_id").alias("view_count"))
    return e.join(d, "pk")


@query(f"""WITH c AS (SELECT vec_id, embedding, n_chars FROM embeddings JOIN documents ON doc_id = vec_id), v AS (SELECT q.vec_id AS query, c.vec_id AS pk, {_DOT} AS s, c.n_chars AS d FROM c q, c WHERE q.vec_id % 20 = 0)
SELECT query, pk, round(s, 5) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, d DESC, pk DESC) AS INT) AS rank FROM v QUALIFY rank <= 10""")
def q_vector_topk(spark, sf_dir):
    """R-4, T5, F20, F21: every twentieth vector is a question, put to all of them; equal scores go by demand."""
    e = _vectors(spark, sf_dir)
    found = retrieval.vector_top(e, e.where("pk % 20 = 0"), 10, retrieval.DEMAND)
    return found.select("query", "pk", F.round("score", 5).alias("score"), "rank")


_ASKED = [("base", ["the", "src1"]), ("bridge", ["license", "version", "src3"])]


@query(_ENTRY_SQL + ", ".join(_ranked_sql(t, _DEMAND, 80, f"x{i}", True) for i, (_, t) in enumerate(_ASKED)) + f""",
u AS ({" UNION ALL ".join(f"SELECT pk, {i} AS bucket, rank, matched = {len(t)} AS exact FROM x{i}r" for i, (_, t) in enumerate(_ASKED))}),
lex AS (SELECT pk, bucket, exact, row_number() OVER (ORDER BY rank, bucket, pk) AS position FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pk ORDER BY rank, bucket) = 1) QUALIFY position <= 80),
v AS (SELECT CAST(q.vec_id / 20 AS INT) AS bucket, c.vec_id AS pk, {_DOT} AS s, n_chars AS d FROM (SELECT * FROM embeddings WHERE vec_id IN (0, 20)) q, (SELECT * FROM embeddings JOIN documents ON doc_id = vec_id) c),
vr AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY s DESC, d DESC, pk DESC) AS rank FROM v QUALIFY rank <= 80),
sem AS (SELECT pk, bucket, s, row_number() OVER (ORDER BY rank, bucket, pk) AS position FROM (SELECT * FROM vr QUALIFY row_number() OVER (PARTITION BY pk ORDER BY rank, bucket) = 1) QUALIFY position <= 80),
f AS (SELECT coalesce(lex.pk, sem.pk) AS pk, coalesce(1.0::DOUBLE / (60 + lex.position), 0) + coalesce(CASE WHEN s > 0 THEN 4.0::DOUBLE / (60 + sem.position) * s END, 0) AS score,
  coalesce(lex.bucket, sem.bucket) AS axis, coalesce(exact, false) AS exact, lex.position AS place FROM lex FULL JOIN sem ON lex.pk = sem.pk),
g AS (SELECT f.*, apply_count, view_count, exact AND place = min(place) FILTER (exact) OVER (PARTITION BY axis) AS kept FROM f JOIN e USING (pk)),
r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY coalesce(kept, false) DESC, score DESC, apply_count DESC, view_count DESC, pk) AS rank FROM g)
SELECT pk, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY rank, axis, pk) AS INT) AS position FROM r QUALIFY position <= 20""")
def q_hybrid_rrf(spark, sf_dir):
    """R-5, F22, T6, W2, W4: two axes, by words and by vector."""
    e = _vectors(spark, sf_dir)
    asked = e.where("pk in (0, 20)").select((F.col("pk") / 20).cast("int").alias("pk"), "vec")
    return retrieval.hybrid(entries(spark, sf_dir), _ASKED, e, asked.withColumn("pk", F.col("pk").cast("long"))).withColumn("score", F.round("score", 9))


@query(_ENTRY_SQL + _ranked_sql(["the", "of"], _DEMAND, 50) + """ SELECT x.pk, CAST(10 AS INT) AS max_rank, CAST(sr.rank AS INT) AS rank, coalesce(sr.rank <= 10, false) AS hit FROM (SELECT doc_id AS pk FROM documents) x LEFT JOIN sr USING (pk)""")
def q_golden_hit_at_k(spark, sf_dir):
    """Which entries are ranked as high as asked."""
    expected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), F.lit(10).alias("max_rank"))
    return retrieval.hit_at(retrieval.lexical(entries(spark, sf_dir), ["the", "of"], 50), expected)


@query("""WITH d AS (SELECT doc_id AS pk, sha256(concat_ws(chr(10), source, text)) AS doc_hash, sha256(concat_ws(chr(10), source, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END)) AS old FROM documents)
SELECT pk, doc_hash = old AND pk % 5 <> 0 AS reused FROM d""")
def q_incremental_reuse(spark, sf_dir):
    """J16, A21, F19, R-7."""
    d = table(spark, sf_dir, "documents")
    now = d.select(F.col("doc_id").alias("pk"), catalogue.document_hash("source", "text").alias("doc_hash"))
    changed = d.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    index = changed.where("doc_id % 5 != 0").select(F.col("doc_id").alias("pk"), catalogue.document_hash("source", "text").alias("doc_hash"))
    kept, pending = catalogue.reuse(index, now)
    return kept.select("pk", F.lit(True).alias("reused")).union(pending.select("pk", F.lit(False)))


@query("""WITH u AS (SELECT doc_id AS pk, 0 AS o, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS title, lang AS category, text AS description, n_chars AS a, 'FILE' AS svc FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 1, source || '2', NULL, text || CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '' END, n_chars + 1, 'REST' FROM documents WHERE doc_id % 3 <> 1)
SELECT pk, arg_min(title, o) FILTER (trim(coalesce(title, '')) <> '') AS title, arg_min(category, o) FILTER (trim(coalesce(category, '')) <> '') AS category, CAST(max(length(description)) AS INT) AS description_length, max(a) AS apply_count,
CASE WHEN max(CASE svc WHEN 'REST' THEN 3 ELSE 1 END) = 3 THEN 'REST' ELSE 'FILE' END AS svc_type, CASE count(*) WHEN 2 THEN 'CSV,JSON' ELSE CASE WHEN max(o) = 0 THEN 'CSV' ELSE 'JSON' END END AS formats FROM u GROUP BY 1""")
def q_merge_entries(spark, sf_dir):
    """A14, U1."""
    e = entries(spark, sf_dir)
    a = e.where("pk % 3 != 0").withColumns({"title": F.when(F.col("pk") % 4 == 0, " ").otherwise(F.col("org")), "svc_type": F.lit("FILE"), "formats": F.array(F.lit("csv"))})
    b = e.where("pk % 3 != 1").withColumns({"title": F.concat("org", F.lit("2")), "category": F.lit(None).cast("string"), "description": F.concat("description", F.when(F.col("pk") % 2 == 0, "+").otherwise("")), "apply_count": F.col("apply_count") + 1, "svc_type": F.lit("REST"), "formats": F.array(F.lit("json "))})
    m = catalogue.merge(a, b)
    return m.select("pk", "title", "category", F.length("description").alias("description_length"), "apply_count", "svc_type", F.concat_ws(",", "formats").alias("formats"))


@query("SELECT source AS org, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS demand FROM documents GROUP BY 1 ORDER BY entries DESC, demand DESC, org LIMIT 20")
def q_org_counts(spark, sf_dir):
    """A11."""
    return catalogue.publisher_counts(entries(spark, sf_dir))


@query("SELECT CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE lang END AS kind, count(*) AS rows FROM documents GROUP BY 1")
def q_svc_counts(spark, sf_dir):
    """A12."""
    kind = F.when(F.col("doc_id") % 6 == 0, F.when(F.col("doc_id") % 12 == 0, " ")).otherwise(F.col("lang"))
    return aggregates.value_counts(table(spark, sf_dir, "documents").select(kind.alias("kind")), "kind")


@query("SELECT count(*) AS entries, count(*) FILTER (lang = 'en') AS api, count(*) FILTER (lang <> 'en') AS file, count(*) FILTER (length(coalesce(text, '')) > 0) AS described FROM documents")
def q_coverage(spark, sf_dir):
    """A13."""
    return catalogue.coverage(entries(spark, sf_dir).withColumn("svc_type", F.when(F.col("category") == "en", "REST").otherwise("FILE")))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY 2")
def q_dedup_first(spark, sf_dir):
    """A15."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return aggregates.first_of_each(d, ["sha"], ["doc_id"]).select("doc_id", "sha")


@query("SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def q_preview(spark, sf_dir):
    """P17, F15."""
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


# --- evidence, events, documents ---------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1")
def q_ledger_latest(spark, sf_dir):
    """An append log by content id, the newest record of each key."""
    c = table(spark, sf_dir, "conversations")
    log = ledger.append(ledger.with_id(c.limit(0), c.columns), ledger.with_id(c, c.columns))
    newest = aggregates.first_of_each(log, ["conv_id"], [F.desc("turn"), F.asc("role"), F.asc("text")])
    return newest.select("conv_id", "turn", "role")


@query("""SELECT event_id, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 15 MINUTE, false) AS live FROM events""")
def q_receipts_ttl(spark, sf_dir):
    """X2."""
    return ledger.live_receipts(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "live")


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def q_replay_once(spark, sf_dir):
    """X5."""
    e = table(spark, sf_dir, "events").withColumn("digest", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256))
    return ledger.once(e, "digest", ["event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT (SELECT count(*) FROM documents) AS planned, count(DISTINCT l.doc_id) AS loaded, (SELECT count(*) FROM documents) - count(DISTINCT l.doc_id) AS missing, count(*) FILTER (quality = 0) AS invalid FROM labels l JOIN documents d USING (doc_id)")
def q_audit_counts(spark, sf_dir):
    """A17."""
    return ledger.audit_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2""")
def q_windowed_counts(spark, sf_dir):
    """The streaming form of a windowed count, on a batch."""
    from .streaming import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").select("start", "event_type", "events")


@query()
def q_html_blocks(spark, sf_dir):
    """S15, F26, P6."""
    return markup.document_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""SELECT 'o_orderkey' AS source, o_orderkey AS record FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'
UNION SELECT 'c_custkey', c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def q_used_records(spark, sf_dir):
    """The records that a joined relation uses, by source."""
    both = joins.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), JoinRule(["o_custkey"], ["c_custkey"]))
    return evidence.used_records(both, ["o_orderkey", "c_custkey"])


@query("""WITH kept AS (SELECT c_custkey AS record, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END FROM customer),
shown AS (SELECT c_custkey AS record, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer)
SELECT record, field, s.value, s.value IS NOT DISTINCT FROM k.value AS agrees FROM shown s JOIN kept k USING (record, field)""")
def q_cell_address_join(spark, sf_dir):
    """Disclosed cells against retained ones by address."""
    c = table(spark, sf_dir, "customer")
    kept = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))
    names = ["c_name", "c_mktsegment"]
    return evidence.same_cells(evidence.cells(c, "c_custkey", names), evidence.cells(kept, "c_custkey", names))


@query("SELECT event_type, count(*) AS calls, round(coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 0), 4) AS amount, count(*) FILTER (event_id % 7 = 0) AS unreported FROM events GROUP BY 1")
def q_usage_summary(spark, sf_dir):
    """A18."""
    e = table(spark, sf_dir, "events").withColumn("amount", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return evidence.usage(e, "event_type", "amount").withColumn("amount", F.round("amount", 4))


@query("SELECT d.doc_id FROM documents d SEMI JOIN (SELECT DISTINCT sha256(text) AS h FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0) b ON sha256(d.text) = b.h")
def q_same_revision(spark, sf_dir):
    """Documents whose content is that of a document labelled poor."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    poor = d.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi")
    return evidence.same_revision(d, poor, ["h"]).select("doc_id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def q_value_intersection(spark, sf_dir):
    """Values that two sources share."""
    return table(spark, sf_dir, "orders").select("o_custkey").intersect(table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")))


@query("SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 = count(DISTINCT turn) AS complete FROM conversations GROUP BY 1")
def q_extent_by_group(spark, sf_dir):
    """Positions without a gap, group by group."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.max("turn") - F.min("turn") + 1 == F.count_distinct("turn")).alias("complete"))


@query("SELECT p_partkey, array_to_string(string_split(upper(p_type), ' '), '|') AS words FROM part")
def q_listed_values(spark, sf_dir):
    """F16: the entries of a cell that holds a list."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", text.listed(F.col("p_type"), " ")).alias("words"))


@query("SELECT event_id, regexp_replace(CAST(json_extract_string(props, '$.k') AS VARCHAR), '[.]0$', '') AS k FROM events")
def q_scalar_text(spark, sf_dir):
    """A scalar of a JSON column as canonical text."""
    return table(spark, sf_dir, "events").select("event_id", evidence.scalar_text(F.get_json_object("props", "$.k")).alias("k"))


# --- single functions ---------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT o_orderkey, o_orderkey % 1000 AS a FROM orders) JOIN
(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_orderkey % 1000 ELSE l_orderkey % 2 END AS b FROM lineitem) ON l_orderkey = o_orderkey WHERE b IS NULL OR a = b""")
def q_lineage_join(spark, sf_dir):
    """Record positions must agree where both are known."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("a"))
    b = F.when(F.col("l_linenumber") % 3 == 1, F.col("l_orderkey") % 1000).when(F.col("l_linenumber") % 3 == 2, F.col("l_orderkey") % 2)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", b.alias("b"))
    return joins.join(o, li, JoinRule(["o_orderkey"], ["l_orderkey"], lineage=[("a", "b")])).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey, CASE WHEN d = 0 THEN '0' ELSE rtrim(rtrim(CAST(d AS VARCHAR), '0'), '.') END AS shown FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(18,4)) END AS d FROM customer)")
def q_canonical_decimals(spark, sf_dir):
    """F6."""
    d = F.when(F.col("c_custkey") % 7 == 0, F.lit(0)).otherwise(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(18,4)")
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.canonical(d).alias("shown"))


@query("SELECT c_custkey, CAST(c_custkey % 91 AS DOUBLE) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS latitude FROM customer")
def q_coordinates(spark, sf_dir):
    """degrees from text."""
    shown = F.concat(F.when(F.col("c_custkey") % 2 == 0, "-").otherwise(""), (F.col("c_custkey") % 91).cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.coordinate(shown, 90.0).alias("latitude"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS amount FROM orders")
def q_loose_integers(spark, sf_dir):
    """F17."""
    shown = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.format_number(F.floor("o_totalprice"), 0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.loose_integer(shown).alias("amount"))


@query("SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END, '') AS development, o_orderpriority AS production FROM orders")
def q_approval_parts(spark, sf_dir):
    """F18."""
    label = F.concat(F.lit("development: "), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_orderstatus")), F.lit(" / production: "), "o_orderpriority")
    development, production = evidence.approval(label)
    return table(spark, sf_dir, "orders").select("o_orderkey", development.alias("development"), production.alias("production"))


_MARKS = ["필수", " Y ", "no", "TRUE", "옵션", "1"]


@query("SELECT event_id, event_id % 6 IN (0, 1, 3, 5) AS required, event_id % 6 IN (1, 3, 5) AS deleted FROM events")
def q_marks(spark, sf_dir):
    """Marks of required parameters and of deleted rows."""
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.required(mark).alias("required"), text.deleted(mark).alias("deleted"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'entity,temporal' ELSE 'entity,proxy' END AS kinds,
CASE p_partkey % 3 WHEN 0 THEN 'same key meaning,key overlap' WHEN 1 THEN 'same key meaning,key overlap,same period unit' ELSE 'same key meaning,key overlap,stated transform' END AS checks FROM part""")
def q_edge_checklist(spark, sf_dir):
    """The kinds of an edge and what they ask for."""
    other = F.element_at(F.array(F.lit("Entity "), F.lit("TEMPORAL"), F.lit(" proxy")), (F.col("p_partkey") % 3 + 1).cast("int"))
    kinds = text.edge_kinds(F.array(F.lit(" Entity"), F.lit("unheard of"), other))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", kinds).alias("kinds"), F.concat_ws(",", evidence.checklist(kinds)).alias("checks"))


@query("SELECT event_id, event_type = 'click' AS leaf, event_type = 'click' AND event_id % 2 = 0 AS suffix FROM events")
def q_path_selectors(spark, sf_dir):
    """a leaf, and a suffix of a dotted path."""
    path = F.concat(F.when(F.col("event_id") % 2 == 0, "Body.Item.").otherwise("Body.Entry."), F.initcap("event_type"))
    return table(spark, sf_dir, "events").select("event_id", evidence.path_matches(path, "click").alias("leaf"), evidence.path_matches(path, "item.click").alias("suffix"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))), '|') AS names FROM part")
def q_canonical_lists(spark, sf_dir):
    """E4."""
    names = F.split(F.concat("p_name", F.lit("  "), "p_type", F.lit(" ")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", evidence.canonical_list(names)).alias("names"))


@query("""SELECT p_partkey, p_size % 7 <= p_size % 5 AND p_size % 7 <= p_size % 11 AND p_partkey % 20 >= p_size % 7 AND p_partkey % 20 <= (p_size % 7) * 6 AS consistent FROM part""")
def q_sample_consistency(spark, sf_dir):
    """Whether counts of an overlap can be true together."""
    at = lambda n: F.col("p_size") % n
    return table(spark, sf_dir, "part").select("p_partkey", ledger.consistent_sample(at(7), at(5), at(11), F.col("p_partkey") % 20, F.lit(2), F.lit(3)).alias("consistent"))


@query("""SELECT role, node, rank, CAST(row_number() OVER (PARTITION BY role ORDER BY rank) AS INT) AS place FROM (SELECT p_brand AS role, p_partkey AS node, p_size * 100000 + p_partkey AS rank FROM part) QUALIFY place <= 3""")
def q_role_cap(spark, sf_dir):
    """Each part in its first role, and the best three of each role."""
    p = table(spark, sf_dir, "part")
    rank = F.col("p_size") * 100000 + F.col("p_partkey")
    first = p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("role"), rank.alias("rank"))
    second = p.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("role"), (rank + 7).alias("rank"))
    return retrieval.best_per_role(first.unionByName(second)).select("role", "node", "rank", "place")


@query("""WITH one AS (SELECT s_nationkey AS role, min(s_suppkey) AS pk FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) GROUP BY 1)
SELECT (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey <> one.pk) AS anchor_pk, pk, role, pk AS position FROM one ORDER BY pk LIMIT 3""")
def q_bridge_selection(spark, sf_dir):
    """J17."""
    s = table(spark, sf_dir, "supplier")
    chosen = s.select(F.col("s_suppkey").alias("pk"), F.col("s_nationkey").alias("role"), F.col("s_suppkey").alias("position"))
    pool = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pk"))
    return evidence.bridges(chosen, pool, s.select(F.col("s_suppkey").alias("pk"), F.col("s_suppkey").alias("position")))


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 14 DAY AS stale FROM events")
def q_staleness(spark, sf_dir):
    """X4."""
    e = table(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", catalogue.stale(F.col("ts"), F.col("now")).alias("stale"))


@query(_ENTRY_SQL + _ranked_sql(["the", "src1"], _DEMAND, 100) + " SELECT pk, CAST(rank AS INT) AS rank FROM sr")
def q_question_terms(spark, sf_dir):
    """The terms of a question; a limit over 100 is 100."""
    terms = text.query_terms("Please: THE src1s!", fillers=["please"], particles=["s"])
    return retrieval.lexical(entries(spark, sf_dir), terms, 5000).select("pk", "rank")


@query(_ENTRY_SQL.replace("FROM documents)", "FROM documents WHERE lang = 'en')") + _ranked_sql(["the", "src1"], _DEMAND, 20) + " SELECT pk, CAST(rank AS INT) AS rank FROM sr")
def q_lexical_rest_only(spark, sf_dir):
    """Services that can be called only."""
    e = entries(spark, sf_dir).withColumn("svc_type", F.when(F.col("category") == "en", "REST").otherwise("FILE"))
    return retrieval.lexical(e, ["the", "src1"], rest_only=True).select("pk", "rank")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 1000")
def q_scan_sample(spark, sf_dir):
    """The first matches of a scan, beside its counts (scan_counts)."""
    _, first = tables.select_first(table(spark, sf_dir, "part"), F.col("p_size") > 25, ["p_partkey"], 1000)
    return first.select("p_partkey", "p_name")


@query("""SELECT doc_id // 5000 AS part, doc_id, row_number() OVER w AS record, CAST(2 + coalesce(sum(1 + length(t) - length(replace(t, chr(10), ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line, md5(t) AS text_md5, source
FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source FROM documents) WINDOW w AS (PARTITION BY doc_id // 5000 ORDER BY doc_id)""")
def q_csv_full_scan(spark, sf_dir):
    """Texts with quoted line ends, written as CSV files and scanned in splits, with record and line numbers."""
    path = csv_scan.shared_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.floor(F.col("doc_id") / 5000).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    part = F.regexp_extract("_path", r"part=(-?\d+)", 1).cast("long").alias("part")
    return csv_scan.csv_scan(spark, path).select(part, F.col("doc_id").cast("long").alias("doc_id"), F.col("_record").alias("record"), F.col("_line").alias("line"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "source")


# --- lineage -----------------------------------------------------------------------------------------------------


def _original(spark, sf_dir, name: str, key: str) -> lineage.Relation:
    return lineage.original(table(spark, sf_dir, name), name, F.col(key))


def _orders_of_customers(spark, sf_dir) -> lineage.Relation:
    return lineage.traced_join(_original(spark, sf_dir, "orders", "o_orderkey"), _original(spark, sf_dir, "customer", "c_custkey"), JoinRule(["orders__o_custkey"], ["customer__c_custkey"]))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderkey, c_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def q_traced_two_paths(spark, sf_dir):
    """Orders come in by two paths (of their lines, of their customers) that meet on the customer; a pair must be of one order."""
    lines = table(spark, sf_dir, "lineitem").withColumn("record", F.monotonically_increasing_id())
    lines = lineage.original(lines, "lineitem", F.col("record"))
    first = lineage.traced_join(lines, _original(spark, sf_dir, "orders", "o_orderkey"), JoinRule(["lineitem__l_orderkey"], ["orders__o_orderkey"]))
    both = lineage.traced_join(first, _orders_of_customers(spark, sf_dir), JoinRule(["orders__o_custkey"], ["customer__c_custkey"]))
    return both.frame().select(*(F.col(f"lineitem__l_{c}").alias(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "quantity")), F.col("orders__o_orderkey").alias("o_orderkey"), F.col("customer__c_custkey").alias("c_custkey"))


@query("""SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS twice
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def q_traced_sum(spark, sf_dir):
    """A measure inherits the record its fields come from, which its sum counts once; groups in the order of their keys."""
    price = F.col("orders__o_totalprice").cast("decimal(18,2)")
    rel = lineage.measured(_orders_of_customers(spark, sf_dir), "price", ["orders__o_totalprice"], (price + price).cast("decimal(20,2)"))
    rel = lineage.traced_join(rel, _original(spark, sf_dir, "nation", "n_nationkey"), JoinRule(["customer__c_nationkey"], ["nation__n_nationkey"]))
    return lineage.traced_aggregate(rel, ["nation__n_name"], [Measure("orders", "count"), Measure("twice", "sum", "price")]).withColumnRenamed("nation__n_name", "n_name")


@query("""WITH p AS (SELECT DISTINCT user_id, event_id // 32768 AS block, event_id FROM events),
r AS (SELECT *, event_id - row_number() OVER (PARTITION BY user_id, block ORDER BY event_id) AS island FROM p)
SELECT user_id, block, first, last FROM (SELECT user_id, block, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY user_id, block, island)""")
def q_member_runs(spark, sf_dir):
    """A5: the members of each group as sorted runs of positions."""
    sets = lineage.row_sets(table(spark, sf_dir, "events"), [F.col("user_id")], "event_id")
    return sets.select("group.user_id", "block", F.explode("runs").alias("r")).select("user_id", "block", "r.first", "r.last")


@query("""WITH u AS (SELECT c_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0)
SELECT 'orders' AS source, o_orderkey AS record FROM u UNION SELECT 'customer', c_custkey FROM u UNION SELECT 'nation', c_nationkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM u)""")
def q_used_through_reduction(spark, sf_dir):
    """Which orders, customers and nations a join of reduced orders rests on."""
    orders = lineage.original(table(spark, sf_dir, "orders"), "orders", F.col("o_orderkey"))
    each = lineage.reduce_traced(orders, "spent", ["orders__o_custkey"], [Measure("orders", "count")])
    rich = lineage.original(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "customer", F.col("c_custkey"))
    rel = lineage.traced_join(each, rich, JoinRule(["spent__o_custkey"], ["customer__c_custkey"]))
    rel = lineage.traced_join(rel, _original(spark, sf_dir, "nation", "n_nationkey"), JoinRule(["customer__c_nationkey"], ["nation__n_nationkey"]))
    return lineage.used_originals(rel)


# --- nested fields, accounting of comparisons -----------------------------------------------------------------------


@query("""WITH v AS (SELECT 'price' AS field, 'doc.price' AS path, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'meta.Priority', 'doc.meta.priority', o_orderpriority FROM orders
UNION ALL SELECT 'item', 'doc.items.item', CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 7 AS VARCHAR) END FROM orders UNION ALL SELECT 'item', 'doc.items.item', o_orderstatus FROM orders),
u AS (SELECT field, path, count(v) AS count, count(*) - count(v) AS nulls, count(DISTINCT v) AS "distinct" FROM v GROUP BY 1, 2)
SELECT field, true AS matched, false AS ambiguous, 1 AS path_count, path AS paths, count, nulls, "distinct", count - "distinct" AS duplicates, "distinct" > 50 AS more_values FROM u
UNION ALL SELECT 'status', true, true, 2, 'doc.meta.status,doc.status', 0, 0, 0, 0, false UNION ALL SELECT 'nothing', false, false, 0, '', 0, 0, 0, 0, false""")
def q_profile_nested(spark, sf_dir):
    """A10: fields of nested documents by name or end of path; leaves of one name on two paths aren't counted together."""
    o = table(spark, sf_dir, "orders")
    item = lambda c: F.struct(c.cast("string").alias("item"))
    meta = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    items = F.array(item(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 7)), item(F.col("o_orderstatus")))
    doc = F.struct(F.struct(F.col("o_custkey").alias("price"), F.col("o_orderstatus").alias("status"), meta.alias("meta"), items.alias("items")).alias("doc"))
    texts = o.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("body"))
    return nested.profile_fields(texts, "body", ["price", "status", "meta.Priority", "item", "nothing"]).withColumn("paths", F.concat_ws(",", "paths")).drop("values")


_ACCOUNT_SQL = """WITH l AS (SELECT CASE WHEN o_custkey % 11 = 0 THEN ' ' WHEN o_custkey % 13 = 0 THEN 'customer' ELSE 'c (' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ')' END AS k, o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1, 2),
lk AS (SELECT CASE WHEN k LIKE '%)' THEN lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS key, k = ' ' AS blank, CASE WHEN n % 4 = 1 THEN NULL ELSE n END AS n, CASE WHEN s % 3 = 0 THEN 'none' ELSE CAST(s AS VARCHAR) END AS s FROM l),
r AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key, CAST(c_nationkey AS BIGINT) AS n, CAST(c_custkey AS VARCHAR) AS s FROM customer UNION ALL SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, '2' FROM customer WHERE c_custkey % 17 = 0),
lg AS (SELECT key, count(*) AS m, any_value(n) AS n, any_value(s) AS s FROM lk WHERE key IS NOT NULL GROUP BY 1), rg AS (SELECT key, count(*) AS m, any_value(n) AS n, any_value(s) AS s FROM r GROUP BY 1),
b AS (SELECT key, coalesce(lg.m, 0) AS lm, coalesce(rg.m, 0) AS rm, lg.n AS ln, rg.n AS rn, lg.s AS ls, rg.s AS rs FROM lg FULL JOIN rg USING (key)),
p AS (SELECT * FROM b WHERE lm = 1 AND rm = 1),
c AS (SELECT 'orders' AS "check", CASE WHEN ln IS NULL OR rn IS NULL THEN 'missing' WHEN ln = rn THEN 'equal' ELSE 'different' END AS status FROM p
UNION ALL SELECT 'keys', CASE WHEN ls = 'none' THEN 'invalid' WHEN ls = rs THEN 'equal' ELSE 'different' END FROM p)
"""


def _accounted(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_custkey")
    label = F.when(k % 11 == 0, " ").when(k % 13 == 0, "customer").otherwise(F.concat(F.lit("c ("), F.lpad(k.cast("string"), 9, "0"), F.lit(")")))
    left = o.groupBy(label.alias("label"), "o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))
    left = left.select("label", F.when(F.col("n") % 4 != 1, F.col("n")).alias("n"), F.when(F.col("s") % 3 == 0, "none").otherwise(F.col("s").cast("string")).alias("s"))
    padded = F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("key")
    right = c.select(padded, F.col("c_nationkey").cast("long").alias("n"), F.col("c_custkey").cast("string").alias("s"))
    right = right.union(c.where("c_custkey % 17 = 0").select(padded, F.lit(1).cast("long"), F.lit("2")))
    checks = [comparison.Check("orders", "n", "n"), comparison.Check("keys", "s", "s")]
    return comparison.compare(left, right, [comparison.Key("label", "digits", 9)], [comparison.Key("key")], checks), checks


@query(_ACCOUNT_SQL + """SELECT CAST(m.ordinal AS INT) AS ordinal, m.metric, CAST(m.value AS BIGINT) AS value FROM (
SELECT 1 AS ordinal, 'left_rows' AS metric, (SELECT count(*) FROM lk) AS value UNION ALL SELECT 2, 'right_rows', (SELECT count(*) FROM r) UNION ALL SELECT 3, 'matched_pairs', (SELECT count(*) FROM p)
UNION ALL SELECT 4, 'left_only', (SELECT count(*) FROM b WHERE lm = 1 AND rm = 0) UNION ALL SELECT 5, 'right_only', (SELECT count(*) FROM b WHERE lm = 0 AND rm = 1)
UNION ALL SELECT 6, 'left_unresolved', (SELECT count(*) FROM lk WHERE key IS NULL) + (SELECT coalesce(sum(lm), 0) FROM b WHERE lm > 1 OR rm > 1) UNION ALL SELECT 7, 'right_unresolved', (SELECT coalesce(sum(rm), 0) FROM b WHERE lm > 1 OR rm > 1)
UNION ALL SELECT 8, 'checks', 2 UNION ALL SELECT 9, 'comparisons', (SELECT count(*) FROM c) UNION ALL SELECT 10, 'equal', (SELECT count(*) FROM c WHERE status = 'equal') UNION ALL SELECT 11, 'different', (SELECT count(*) FROM c WHERE status = 'different')
UNION ALL SELECT 12, 'missing', (SELECT count(*) FROM c WHERE status = 'missing') UNION ALL SELECT 13, 'invalid', (SELECT count(*) FROM c WHERE status = 'invalid')) m""")
def q_comparison_metrics(spark, sf_dir):
    """The thirteen metrics of a comparison."""
    return comparison.summary(*_accounted(spark, sf_dir))


@query(_ACCOUNT_SQL + """SELECT "check", count(*) FILTER (status = 'equal') AS equal, count(*) FILTER (status = 'different') AS different, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'invalid') AS invalid FROM c GROUP BY 1""")
def q_comparison_checks(spark, sf_dir):
    """How each check came out."""
    return comparison.by_check(*_accounted(spark, sf_dir))


@query("""SELECT event_type AS comparison, user_id AS target, count(DISTINCT (event_id % 13) * 2 + (event_id // 13) % 2) = 26 AS complete, 13 - (SELECT count(*) FROM (SELECT event_id % 13 FROM events e WHERE e.event_type = o.event_type AND e.user_id = o.user_id GROUP BY 1 HAVING count(DISTINCT (event_id // 13) % 2) = 2)) AS lacking
FROM events o GROUP BY 1, 2""")
def q_comparison_coverage(spark, sf_dir):
    """Which targets have been shown all of a comparison's metrics and values."""
    e = table(spark, sf_dir, "events")
    field = F.when(F.floor(F.col("event_id") / 13) % 2 == 1, "value").otherwise("metric")
    cells = e.select(F.col("event_type").alias("comparison"), F.col("user_id").alias("target"), (F.col("event_id") % 13 + 1).alias("ordinal"), field.alias("field"))
    return comparison.coverage(cells).withColumn("lacking", F.size("lacking").cast("long"))
