"""Relations that know their original records.

A relation is a frame with a slot for each original source that its rows come from: a column with the record's position there. Joins merge
the slots of both sides, and where both sides come from one source, only pairs of the same record match: the shared slots are keys of the
equi-join, so other pairs are never made. What can't be traced is refused when the plan is made, before anything runs:

- one name for two revisions of a source;
- a reduced source joined to its own members, or to another reduction of them (raw and grouped amounts can't be mixed);
- the reduction of anything but one original source;
- a measure over fields of different original records;
- a sum over a field without a slot (a reduction's output is a record of its own).

A reduction closes its source's slot. Its members are kept as row sets beside it, not as lists in its rows: for each group and block of
BLOCK positions the sorted runs (first, last), so that no row holds more than BLOCK / 2 runs, whatever a group holds, and no task more than
a block of a group. Positions are longs, not null; a position that comes twice is found by `check_records` and by `check_members`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import Measure, digest, guarded_sum
from .joins import JoinRule, join

#: Positions of a block of a row set.
BLOCK = 32768


@dataclass(frozen=True)
class Closed:
    """A source that a reduction has closed: its row sets (group, block, runs), by the values it was grouped by."""

    revision: str
    members: DataFrame


@dataclass(frozen=True)
class Relation:
    rows: DataFrame
    slots: dict[str, str]  # open slots: source -> revision; positions are in the column at(source)
    origins: dict[str, str]  # field -> the slot its values come from
    closed: dict[str, Closed] = field(default_factory=dict)  # the group of a row is in the column group_of(source)

    @property
    def fields(self) -> list[str]:
        hidden = {at(s) for s in self.slots} | {group_of(s) for s in self.closed}
        return [c for c in self.rows.columns if c not in hidden]

    def frame(self) -> DataFrame:
        """The fields alone."""
        return self.rows.select(*(F.col(f"`{c}`") for c in self.fields))


def at(source: str) -> str:
    return f"_at__{source}"


def group_of(source: str) -> str:
    return f"_group__{source}"


def revision_of(df: DataFrame) -> str:
    """A name for the rows as they are: their number and the sum of their hashes, in any order."""
    found = digest(df).first()
    return f"{found['rows']}:{found['sum'] or 0}"


def original(df: DataFrame, source: str, position: Column, revision: str = "") -> Relation:
    """A source whose records are at positions; its fields become source__field."""
    named = df.select(*(F.col(f"`{c}`").alias(f"{source}__{c}") for c in df.columns), position.cast("long").alias(at(source)))
    known = F.when(F.col(at(source)).isNull(), F.raise_error(F.lit(f"a record of {source} has no position")).cast("long")).otherwise(F.col(at(source)))
    return Relation(named.withColumn(at(source), known), {source: revision}, {f"{source}__{c}": source for c in df.columns})


def paired(df: DataFrame, source: str, slots: dict[str, tuple[str, str]], origins: dict[str, str]) -> Relation:
    """Computed pairs (nearest places, matches) that inherit the slots of what they pair: {source: (position column, revision)}.

    `origins` says which fields are copies from which of them; other fields belong to the pair and have no slot."""
    if len(slots) < 2 or set(origins.values()) - set(slots):
        raise ValueError("pairs inherit two sources or more, and copy from those alone")
    positions = {p for p, _ in slots.values()}
    named = df.select(*(F.col(f"`{c}`").alias(f"{source}__{c}") for c in df.columns if c not in positions), *(F.col(f"`{p}`").cast("long").alias(at(s)) for s, (p, _) in slots.items()))
    return Relation(named, {s: r for s, (_, r) in slots.items()}, {f"{source}__{c}": s for c, s in origins.items()})


def compatible(left: Relation, right: Relation) -> list[str]:
    """The open slots that both sides have; refuses sides that can't be traced together."""
    for source, mine in left.closed.items():
        if source in right.closed or source in right.slots:
            raise ValueError(f"{source} is reduced: its groups can't be joined to its records or to another reduction of it")
    for source in right.closed:
        if source in left.slots:
            raise ValueError(f"{source} is reduced: its records can't be joined to its groups")
    shared = [s for s in right.slots if s in left.slots]
    for s in shared:
        if left.slots[s] != right.slots[s]:
            raise ValueError(f"two revisions of {s}")
    return shared


def traced_join(left: Relation, right: Relation, rule: JoinRule) -> Relation:
    """Joins by a rule; pairs that share an original record agree on it (J6). Fields of both sides keep their slots.

    Fields that both sides have (copies of a shared source's) are taken from the left."""
    shared = compatible(left, right)
    twice = [c for c in right.fields if c in left.fields]
    foreign = [c for c in twice if right.origins.get(c) not in shared or left.origins.get(c) != right.origins.get(c)]
    if foreign:
        raise ValueError(f"both sides have a field {foreign[0]}")
    copy = lambda c: f"_right__{c}"
    moved = right.rows.withColumnsRenamed({c: copy(c) for c in [*twice, *(at(s) for s in shared)]})
    there = lambda c: copy(c) if c in twice else c
    if len(rule.left) + len(shared) > 8:
        raise ValueError("a join has 1 to 8 pairs of keys, shared records among them")
    full = replace(rule, left=[*rule.left, *(at(s) for s in shared)], right=[*map(there, rule.right), *(copy(at(s)) for s in shared)])
    full.scopes = [replace(s, right=[*map(there, s.right)]) for s in rule.scopes]
    if rule.periods:
        full.periods = (rule.periods[0], tuple(map(there, rule.periods[1])))
    both = join(left.rows, moved, full).drop(*(copy(c) for c in [*twice, *(at(s) for s in shared)]))
    return Relation(both, left.slots | right.slots, right.origins | left.origins, left.closed | right.closed)


def measured(rel: Relation, name: str, fields: Sequence[str], value: Column) -> Relation:
    """Adds a value made from fields of one original record; it has their slot."""
    lost = [f for f in fields if f not in rel.fields]
    if not fields or lost:
        raise ValueError(f"no field {lost[0]}" if lost else "a measure is made from fields")
    if name in rel.rows.columns:
        raise ValueError(f"a measure may not overwrite {name}")
    slots = {rel.origins.get(f) for f in fields}
    if len(slots) != 1:
        raise ValueError(f"{name} is made from fields of different records")
    slot = slots.pop()
    return replace(rel, rows=rel.rows.withColumn(name, value), origins=rel.origins | ({name: slot} if slot else {}))


def traced_aggregate(rel: Relation, group_by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Groups in the order of their keys, nulls first (W7); a record that counts twice in a group's sum is an error."""
    names = [*group_by, *(m.name for m in measures)]
    if not measures or len(set(names)) != len(names):
        raise ValueError("aggregates need names of their own")
    made = []
    for m in measures:
        if m.op == "count":
            made.append((F.count(F.col(m.column)) if m.column else F.count("*")).alias(m.name))
        elif m.op != "sum":
            raise ValueError(f"no aggregate {m.op}")
        elif rel.origins.get(m.column) not in rel.slots:
            raise ValueError(f"{m.column} has no original record")
        else:
            made.append(guarded_sum(rel.rows, m.column, m.scale, F.col(at(rel.origins[m.column]))).alias(m.name))
    out = rel.rows.groupBy(*group_by).agg(*made)
    return out.orderBy(*(F.asc_nulls_first(g) for g in group_by)) if group_by else out


# --- row sets ----------------------------------------------------------------------------------------------------


def _bound(value: Column, then) -> Column:
    """then(value) with the value computed once, where the expression would repeat it."""
    return F.transform(F.array(value), then)[0]


def runs_of(positions: Column) -> Column:
    """Sorted distinct positions as runs (first, last)."""

    def runs(a: Column) -> Column:
        firsts = F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x - 1))
        lasts = F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1) != x + 1))
        return F.zip_with(firsts, lasts, lambda f, t: F.struct(f.alias("first"), t.alias("last")))

    return _bound(positions, runs)


def row_sets(df: DataFrame, group: Sequence[Column], position: str) -> DataFrame:
    """(group, block, runs): the positions of each group. Blocks of a group are made apart, so a hot group is many rows, not one."""
    block = F.floor(F.col(position) / BLOCK).alias("block")
    sets = df.select(F.struct(*group).alias("group"), block, F.col(position).alias("_p")).groupBy("group", "block").agg(F.array_sort(F.collect_set("_p")).alias("_p"))
    return sets.select("group", "block", runs_of(F.col("_p")).alias("runs"))


def merged(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., block, runs): the union of row sets, block by block; a block's runs hold at most BLOCK positions."""
    apart = sets.select(*by, "block", F.explode("runs").alias("r"))
    spread = F.flatten(F.transform(F.collect_set("r"), lambda r: F.sequence(r["first"], r["last"])))
    return apart.groupBy(*by, "block").agg(F.array_sort(F.array_distinct(spread)).alias("_p")).select(*by, "block", runs_of(F.col("_p")).alias("runs"))


def size_of(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def positions_of(sets: DataFrame, *keep: str) -> DataFrame:
    """A row for each position of row sets."""
    return sets.select(*keep, F.explode("runs").alias("r")).select(*keep, F.explode(F.sequence("r.first", "r.last")).alias("record"))


def reduce_traced(rel: Relation, name: str, group_by: Sequence[str], measures: Sequence[Measure], period: tuple[str, str] | None = None, revision: str | None = None) -> Relation:
    """Reduces one original source before it is joined (A5, A6). Its fields become name__field, its slot is closed, and its members are
    row sets that later joins don't carry. `revision`, if given, must be the source's."""
    if rel.closed or len(rel.slots) != 1:
        raise ValueError("only one original source can be reduced")
    ((source, known),) = rel.slots.items()
    if revision is not None and revision != known:
        raise ValueError(f"another revision of {source}")
    if not group_by or len(group_by) > 8 or not 1 <= len(measures) <= 8 or name == source:
        raise ValueError("a reduction has a name of its own, 1 to 8 groups and 1 to 8 measures")
    short = [g.removeprefix(f"{source}__") for g in group_by]
    names = [*short, *(m.name for m in measures), *(p.removeprefix(f"{source}__") for p in period or ())]
    if len(set(names)) != len(names):
        raise ValueError("a reduction's outputs need names of their own")
    made = [(F.count(F.col(m.column) if m.column else F.lit(1)) if m.op == "count" else guarded_sum(rel.rows, m.column, m.scale, F.col(at(source)))).alias(f"{name}__{m.name}") for m in measures]
    if period:
        whole = F.count_if(F.col(period[0]).isNull() | F.col(period[1]).isNull()) == 0
        made += [F.when(whole, f(p)).alias(f"{name}__{p.removeprefix(f'{source}__')}") for f, p in zip((F.max, F.min), period)]
    keys = [F.col(g).alias(f"{name}__{s}") for g, s in zip(group_by, short)]
    out = rel.rows.groupBy(*keys).agg(*made).withColumn(group_of(source), F.struct(*(F.col(f"{name}__{s}").alias(s) for s in short)))
    sets = row_sets(rel.rows, [F.col(g).alias(s) for g, s in zip(group_by, short)], at(source))
    return Relation(out, {}, {}, {source: Closed(known, sets)})


def members_used(rel: Relation, source: str) -> DataFrame:
    """The row sets (group, block, runs) of the groups that take part in a relation."""
    taking_part = rel.rows.select(F.col(group_of(source)).alias("group")).distinct()
    return rel.closed[source].members.join(taking_part, "group", "left_semi")


def used_originals(rel: Relation) -> DataFrame:
    """(source, record): each original record that a relation rests on, through its reductions too."""
    out = None
    for source in rel.slots:
        found = rel.rows.select(F.lit(source).alias("source"), F.col(at(source)).alias("record")).distinct()
        out = found if out is None else out.union(found)
    for source in rel.closed:
        # a record is in one group only, so its position comes once
        found = positions_of(members_used(rel, source)).select(F.lit(source).alias("source"), "record")
        out = found if out is None else out.union(found)
    return out


def check_records(rel: Relation, source: str) -> DataFrame:
    """Positions of an original source that come more than once."""
    return rel.rows.groupBy(F.col(at(source)).alias("record")).agg(F.count("*").alias("times")).where("times > 1")


def check_members(members: DataFrame, records: DataFrame, position: str) -> DataFrame:
    """(block, members, overlapping, records): blocks whose row sets aren't each record of the source once (E5); none if all is well."""
    inside = Window.partitionBy("block").orderBy("r.first", "r.last")
    runs = members.select("block", F.explode("runs").alias("r")).withColumn("before", F.lag("r.last").over(inside))
    sets = runs.groupBy("block").agg(F.sum(F.col("r.last") - F.col("r.first") + 1).alias("members"), F.count_if(F.col("before") >= F.col("r.first")).alias("overlapping"))
    there = records.select(F.col(position).cast("long").alias("_p")).groupBy(F.floor(F.col("_p") / BLOCK).alias("block")).agg(F.count("*").alias("records"), F.array_sort(F.collect_set("_p")).alias("_p"))
    union = merged(members).select("block", F.col("runs").alias("_merged"))
    both = sets.join(union, "block").join(there.select("block", "records", runs_of(F.col("_p")).alias("_there")), "block", "full")
    wrong = ~F.coalesce((F.col("members") == F.col("records")) & (F.col("overlapping") == 0) & (F.col("_merged") == F.col("_there")), F.lit(False))
    return both.where(wrong).select("block", "members", "overlapping", "records")
