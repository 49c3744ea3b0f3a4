"""Joins of the relational core: typed keys, ordered equi-joins with scope, period and lineage conditions, metrics, unmatched rows,
nearest neighbours and reconciliation (J1-J13, W1, A7)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import EARTH_RADIUS_M, haversine_m, trimmed
from ..functions.periods import intersect
from ..functions.text import tokens


def key_part(df: DataFrame, name: str, trim: bool = False) -> Column:
    """A key column that is null where it must not match: null, or text that is empty after the optional trim."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if not isinstance(kind, T.StringType):
        return column
    text = trimmed(column) if trim else column
    return F.when(text != "", text)


def kinds_agree(a: T.DataType, b: T.DataType) -> bool:
    """Text matches text and numbers match numbers; a mixed pair is refused rather than cast."""
    group = lambda t: "number" if isinstance(t, T.NumericType) else t.typeName()
    return group(a) == group(b)


def keyed(df: DataFrame, names: Sequence[str], trim: bool, prefix: str) -> DataFrame:
    """Adds the key parts as prefix0, prefix1, ..."""
    return df.withColumns({f"{prefix}{i}": key_part(df, n, trim) for i, n in enumerate(names)})


@dataclass
class Scope:
    """A condition on white-space tokens of up to four columns of each side."""

    left: Sequence[str]
    right: Sequence[str]
    how: str = "equal"  # equal, left_prefix (left begins right), right_prefix

    def texts(self) -> tuple[Column, Column]:
        """Each side's tokens as one text with a blank between them, made before rows are paired; null where they are unknown."""
        a, b = (F.array_join(tokens(*(F.col(f"`{c}`") for c in side)), " ") for side in (self.left, self.right))
        return a, b

    def match(self, a: Column, b: Column) -> Column:
        """Whether two texts of tokens match; null where one is unknown."""
        begins = lambda long, short: (long == short) | F.startswith(long, F.concat(short, F.lit(" ")))
        return {"equal": a == b, "left_prefix": begins(b, a), "right_prefix": begins(a, b)}[self.how]


@dataclass
class JoinRule:
    left: Sequence[str]
    right: Sequence[str]
    trim: bool = False
    scopes: Sequence[Scope] = ()
    periods: tuple[tuple[str, str], tuple[str, str]] | None = None  # (first, last) columns of left and right
    lineage: Sequence[tuple[str, str]] = ()  # record-position columns that must agree


def check_keys(left: DataFrame, right: DataFrame, rule: JoinRule) -> None:
    if not 1 <= len(rule.left) <= 8 or len(rule.left) != len(rule.right):
        raise ValueError("a join has 1 to 8 pairs of keys")
    for a, b in zip(rule.left, rule.right):
        if not kinds_agree(left.schema[a].dataType, right.schema[b].dataType):
            raise ValueError(f"keys {a} and {b} are of different kinds")


def beginnings(long: DataFrame, x: str, short: DataFrame, y: str, k: int) -> DataFrame:
    """The rows of `long` with each beginning of their text of tokens x<k> in its place that has as many tokens as a text y<k> of
    `short` with the same keys before it and the same first token: rows match if what is then in x<k> and y<k> is equal."""
    head = lambda c: F.substring_index(c, " ", 1)
    size = lambda c: F.size(F.split(c, " "))
    had = short.select(*(F.col(f"{y}{i}").alias(f"_k{i}") for i in range(k)), head(f"{y}{k}").alias("_head"), size(f"{y}{k}").alias("_tokens")).distinct()
    same = [F.col(f"{x}{i}") == F.col(f"_k{i}") for i in range(k)] + [head(f"{x}{k}") == F.col("_head"), size(f"{x}{k}") >= F.col("_tokens")]
    cut = F.call_function("substring_index", F.col(f"{x}{k}"), F.lit(" "), F.col("_tokens"))
    return long.join(had, same).withColumn(f"{x}{k}", cut).drop(*(f"_k{i}" for i in range(k)), "_head", "_tokens")


def agreed(lineage: Sequence[tuple[str, str]]) -> Column:
    held = F.lit(True)
    for a, b in lineage:
        held = held & F.coalesce(F.col(f"`{a}`") == F.col(f"`{b}`"), F.lit(True))
    return held


def join(left: DataFrame, right: DataFrame, rule: JoinRule) -> DataFrame:
    """Pairs that meet every condition; the first period columns become the common period.

    Scopes are keys of the join: all tokens where they must be equal, else a beginning of the longer side's, so no pair is made and
    then refused by them."""
    check_keys(left, right, rule)
    l, r, keys = keyed(left, rule.left, rule.trim, "_l"), keyed(right, rule.right, rule.trim, "_r"), len(rule.left)
    for scope in rule.scopes:
        a, b = scope.texts()
        l, r = l.withColumn(f"_l{keys}", a), r.withColumn(f"_r{keys}", b)
        if scope.how == "left_prefix":
            r = beginnings(r, "_r", l, "_l", keys)
        elif scope.how == "right_prefix":
            l = beginnings(l, "_l", r, "_r", keys)
        keys += 1
    if rule.scopes:  # few rows may make many pairs: their keys are dealt over all tasks, however small the tables are
        l = l.repartition(int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(F.col(f"_l{i}") for i in range(keys)))
        r = r.hint("merge")
    both = l.join(r, [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(keys)], "inner").drop(*(f"_{s}{i}" for s in "lr" for i in range(keys)))
    if rule.lineage:
        both = both.where(agreed(rule.lineage))
    if rule.periods:
        (a, b), (c, d) = rule.periods
        first, last = intersect(F.col(a), F.col(b), F.col(c), F.col(d))
        both = both.withColumns({"_first": first, "_last": last}).where("_first <= _last")
        both = both.withColumn(a, F.col("_first")).withColumn(b, F.col("_last")).drop("_first", "_last")
    return both


def metrics(left: DataFrame, right: DataFrame, rule: JoinRule, left_id: str, right_id: str) -> DataFrame:
    """One row of counts (J7, J8): rows, candidates, rejections in the order of the conditions, and what matched.

    Rows that no condition tells apart are one group; groups are paired, and a pair counts as many times as it has pairs of rows."""
    check_keys(left, right, rule)
    periods = rule.periods or ((), ())
    sides = []
    for df, s, names, lineage, period, at in ((left, "l", rule.left, [a for a, _ in rule.lineage], periods[0], 0), (right, "r", rule.right, [b for _, b in rule.lineage], periods[1], 1)):
        made = {f"_{s}scope{i}": scope.texts()[at] for i, scope in enumerate(rule.scopes)}
        made |= {f"_{s}lineage{i}": F.col(f"`{c}`") for i, c in enumerate(lineage)} | {f"_{s}period{i}": F.col(c) for i, c in enumerate(period)}
        rows = keyed(df, names, rule.trim, f"_{s}").withColumns(made) if made else keyed(df, names, rule.trim, f"_{s}")
        sides.append((rows, [f"_{s}{i}" for i in range(len(names))], list(made)))
    (l, l_keys, l_seen), (r, r_keys, r_seen) = sides
    groups = [rows.groupBy(*keys, *seen).agg(F.count("*").alias(n)) for (rows, keys, seen), n in zip(sides, ("_nl", "_nr"))]
    pairs = groups[0].join(groups[1], [F.col(a) == F.col(b) for a, b in zip(l_keys, r_keys)])

    lineage = agreed([(f"_llineage{i}", f"_rlineage{i}") for i in range(len(rule.lineage))])
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("_nl") * F.col("_nr"))), F.lit(0))
    counts = [times(F.lit(True)).alias("candidate_pairs"), times(~lineage).alias("lineage_rejected")]
    held = lineage
    for i, scope in enumerate(rule.scopes):
        match = scope.match(F.col(f"_lscope{i}"), F.col(f"_rscope{i}"))
        counts += [
            times(lineage).alias(f"scope{i}_candidates"),
            times(lineage & match).alias(f"scope{i}_matched"),
            times(lineage & ~match).alias(f"scope{i}_conflicts"),
            times(lineage & match.isNull()).alias(f"scope{i}_unknown"),
        ]
        held = held & F.coalesce(match, F.lit(False))
    if rule.periods:
        first, last = intersect(*(F.col(f"_{s}period{i}") for s in "lr" for i in (0, 1)))
        common = F.when(first.isNotNull(), first <= last)
        counts += [times(held & ~F.coalesce(common, F.lit(False))).alias("temporal_rejected"), times(held & common.isNull()).alias("temporal_unknown")]
        held = held & F.coalesce(common, F.lit(False))
    accepted = pairs.where(held)

    def matched(rows: DataFrame, keys: list[str], seen: list[str], id_: str) -> DataFrame:
        of = accepted.select(*(F.col(c).alias(f"_of{c}") for c in (*keys, *seen))).distinct()
        same = [F.col(c) == F.col(f"_of{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in seen]
        return rows.join(of, same, "left_semi").agg(F.count_distinct(id_))

    # subqueries, so what isn't asked for isn't counted
    sizes = [df.agg(F.count("*")).scalar().alias(n) for df, n in ((left, "left_rows"), (right, "right_rows"))]
    ids = [matched(l, l_keys, l_seen, left_id).scalar().alias("matched_left"), matched(r, r_keys, r_seen, right_id).scalar().alias("matched_right")]
    return pairs.agg(*counts, times(held).alias("output_rows")).select(*sizes, "*", *ids)


def expansion(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], trim: bool = False) -> DataFrame:
    """How many pairs an equi-join makes, counted per key before it is made."""
    names = [f"_k{i}" for i in range(len(left_keys))]
    l = keyed(left, left_keys, trim, "_k").groupBy(*names).agg(F.count("*").alias("nl"))
    r = keyed(right, right_keys, trim, "_k").groupBy(*names).agg(F.count("*").alias("nr"))
    l, r = l.dropna(subset=names), r.dropna(subset=names)
    return l.join(r, names).agg(F.count("*").alias("overlap_keys"), F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("joined_rows"), F.max("nl").alias("most_left"), F.max("nr").alias("most_right"))


def unmatched(left: DataFrame, right: DataFrame, rule: JoinRule, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows of either side that no accepted pair holds."""
    pairs = join(left, right, rule)
    return left.join(pairs.select(left_id).distinct(), left_id, "left_anti"), right.join(pairs.select(right_id).distinct(), right_id, "left_anti")


def unmatched_report(left: DataFrame, right: DataFrame, rule: JoinRule, left_id: str, right_id: str, left_fields: Sequence[str], right_fields: Sequence[str]) -> DataFrame:
    """(side, id, field, value): unmatched rows of both sides in one shape."""
    sides = []
    for side, df, key, fields in zip(("left", "right"), unmatched(left, right, rule, left_id, right_id), (left_id, right_id), (left_fields, right_fields)):
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
        sides.append(df.select(F.lit(side).alias("side"), F.col(key).cast("string").alias("id"), F.explode(pairs).alias("p")).select("side", "id", "p.field", "p.value"))
    return sides[0].unionByName(sides[1])


#: A grid is cut finer until its fullest cell has no more candidates than so many times k.
FULL_CELL = 256
#: No grid is finer than this chord of the unit sphere, some 6 mm.
FINEST = 1e-9


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """Unit vectors, so that poles and the date line are places like others."""
    la, lo = F.radians(lat), F.radians(lon)
    return [(F.cos(la) * F.cos(lo)).alias("_x"), (F.cos(la) * F.sin(lo)).alias("_y"), F.sin(la).alias("_z")]


def _cell(side: float, shift: Sequence[Column] = ()) -> list[Column]:
    shift = shift or [F.lit(0)] * 3
    return [(F.floor((F.col(c) + 1) / side) + s).cast("long").alias(f"_c{c}") for c, s in zip(("_x", "_y", "_z"), shift)]


def nearest(anchors: DataFrame, candidates: DataFrame, k: int, anchor: tuple[str, str, str], candidate: tuple[str, str, str]) -> DataFrame:
    """The k candidates nearest to each anchor, ties by the candidate's id (J11, W1). Triples are (id, latitude, longitude); rows
    without coordinates take no part.

    Places fall into the cells of a grid on the unit sphere. An anchor meets the candidates of its cell and the 26 around it, so all
    within one cell's side are among them; it is done if its k-th lies within that. The others go on with a grid four times as wide,
    until one cell spans the sphere. Of candidates at one place the k smallest ids stand for all, and the first grid is cut until its
    fullest cell is small, so crowded places don't make their anchors meet crowds."""
    if not 1 <= k <= 10:
        raise ValueError("k is 1 to 10")
    a = anchors.select(*(F.col(c).alias(n) for c, n in zip(anchor, ("anchor_id", "_lat", "_lon")))).dropna(subset=["_lat", "_lon"])
    c = candidates.select(*(F.col(x).alias(n) for x, n in zip(candidate, ("candidate_id", "_clat", "_clon")))).dropna(subset=["_clat", "_clon"])
    here = Window.partitionBy("_clat", "_clon").orderBy("candidate_id")
    c = c.withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= k).drop("_n").select("*", *_on_sphere("_clat", "_clon")).persist()
    rest = a.select("*", *_on_sphere("_lat", "_lon")).persist()
    side = 2 * math.sqrt(4 * k / max(c.count(), 4 * k))
    while side > FINEST and (c.groupBy(*_cell(side)).count().agg(F.max("count")).first()[0] or 0) > FULL_CELL * k:
        side /= 4
    around = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(ds, "ijk"))) for ds in itertools.product((-1, 0, 1), repeat=3)))
    order = Window.partitionBy("anchor_id").orderBy("distance_m", "candidate_id")
    columns, out = ["anchor_id", "rank", "candidate_id", "distance_m"], None
    while True:
        spread = rest.withColumn("_d", F.explode(around)).select("anchor_id", "_lat", "_lon", *_cell(side, [F.col(f"_d.{n}") for n in "ijk"]))
        met = spread.join(c.select("candidate_id", "_clat", "_clon", *_cell(side)), ["_c_x", "_c_y", "_c_z"])
        met = met.withColumn("distance_m", haversine_m(F.col("_lat"), F.col("_lon"), F.col("_clat"), F.col("_clon")))
        top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*columns)
        if side >= 2:  # every place is in one of the cells around
            return top if out is None else out.unionByName(top)
        top = top.persist()
        reach = 2 * EARTH_RADIUS_M * math.asin(min(1.0, side / 2)) * (1 - 1e-9) - 1e-3
        done = top.groupBy("anchor_id").agg(F.count("*").alias("n"), F.max("distance_m").alias("far")).where((F.col("n") == k) & (F.col("far") <= reach)).select("anchor_id")
        kept = top.join(done, "anchor_id", "left_semi").select(*columns)
        out = kept if out is None else out.unionByName(kept)
        rest = rest.join(done, "anchor_id", "left_anti").persist()
        if rest.isEmpty():
            return out
        side *= 4


def reconcile(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(kind, key, check, left_value, right_value): a one-to-one comparison of two sources.

    Kinds: matched, equal, different, missing (either value null), left_only, right_only, ambiguous_key, left_missing_key,
    right_missing_key. Checks compare exact decimals. Keys that repeat on either side are ambiguous, never multiplied."""
    values = lambda n: F.array(*(F.col(f"_{n}{i}") for i in range(len(checks))))
    l = left.select(left_key.cast("string").alias("key"), *(c.alias(f"_l{i}") for i, (_, c, _) in enumerate(checks)))
    r = right.select(right_key.cast("string").alias("key"), *(c.alias(f"_r{i}") for i, (_, _, c) in enumerate(checks)))
    blank = lambda: F.col("key").isNull() | (trimmed(F.col("key")) == "")
    one = lambda df, n: df.where(~blank()).groupBy("key").agg(F.count("*").alias(f"n{n}"), *(F.first(f"_{n}{i}").alias(f"_{n}{i}") for i in range(len(checks))))
    both = one(l, "l").join(one(r, "r"), "key", "full_outer")
    kind = F.when(F.coalesce("nl", F.lit(0)) + F.coalesce("nr", F.lit(0)) == 0, None).when((F.coalesce("nl", F.lit(0)) > 1) | (F.coalesce("nr", F.lit(0)) > 1), "ambiguous_key").when(F.col("nr").isNull(), "left_only").when(F.col("nl").isNull(), "right_only").otherwise("matched")
    both = both.withColumn("kind", kind)
    text = lambda c: c.cast("string")
    alone = both.where("kind != 'matched'").select("kind", "key", F.lit(None).cast("string").alias("check"), text(F.col("nl")).alias("left_value"), text(F.col("nr")).alias("right_value"))
    tests = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"_l{i}").alias("a"), F.col(f"_r{i}").alias("b")) for i, (name, _, _) in enumerate(checks)))
    each = both.where("kind = 'matched'").select("key", F.explode(tests).alias("t"))
    result = F.when(F.col("t.a").isNull() | F.col("t.b").isNull(), "missing").when(F.col("t.a") == F.col("t.b"), "equal").otherwise("different")
    each = each.select(result.alias("kind"), "key", "t.check", text(F.col("t.a")).alias("left_value"), text(F.col("t.b")).alias("right_value"))
    lost = [df.where(blank()).select(F.lit(f"{side}_missing_key").alias("kind"), "key", *(F.lit(None).cast("string").alias(c) for c in ("check", "left_value", "right_value"))) for df, side in ((l, "left"), (r, "right"))]
    return alone.unionByName(each).unionByName(lost[0]).unionByName(lost[1])


def reconcile_summary(report: DataFrame) -> DataFrame:
    """(kind, rows) of a reconciliation."""
    return report.groupBy("kind").agg(F.count("*").alias("rows"))


def overlap_statistics(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of each side, how many they share, joined rows, and the most rows of a key."""
    l = keyed(left, [left_key], False, "_k").where("_k0 is not null").groupBy("_k0").agg(F.count("*").alias("nl"))
    r = keyed(right, [right_key], False, "_k").where("_k0 is not null").groupBy("_k0").agg(F.count("*").alias("nr"))
    both = l.join(r, "_k0", "full_outer")
    return both.agg(
        F.count("nl").alias("left_distinct"), F.count("nr").alias("right_distinct"), F.count_if(F.col("nl").isNotNull() & F.col("nr").isNotNull()).alias("overlap"),
        F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("joined_rows"), F.max("nl").alias("most_left"), F.max("nr").alias("most_right"),
    )
