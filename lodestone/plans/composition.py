"""A composition recipe as data: sources, ordered joins, measures, grouping and projection, run as one DataFrame.

Fields are named source.field; nothing runs until the result does, except the guards that the recipe asks for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import Measure, aggregate, at_most, not_empty
from ..operators.joins import JoinRule, Scope, expansion, join

MOST_JOINS, MOST_GROUPS, MOST_MEASURES = 7, 8, 16


def qualify(df: DataFrame, name: str) -> DataFrame:
    """Every field under its source's name (P1); dots become double underscores, so no quoting is needed."""
    return df.select(*(F.col(f"`{c}`").alias(f"{name}__{c}") for c in df.columns))


def column_name(qualified: str) -> str:
    source, _, name = qualified.partition(".")
    return f"{source}__{name}" if name else source


@dataclass
class Step:
    """Joins one more source; left keys may come from any source before it."""

    right: str
    left_keys: Sequence[str]
    right_keys: Sequence[str]
    trim: bool = False
    scopes: Sequence[Scope] = ()
    periods: tuple[tuple[str, str], tuple[str, str]] | None = None


@dataclass
class Composition:
    base: str
    steps: Sequence[Step] = ()
    measures: dict[str, Column] = field(default_factory=dict)  # computed after all joins
    group_by: Sequence[str] = ()
    aggregates: Sequence[Measure] = ()
    select: dict[str, str] = field(default_factory=dict)  # output name -> field
    where: Column | None = None
    most_rows: int | None = None
    most_pairs: int | None = None  # a join that would make more is refused before it is made
    refuse_empty: bool = False

    def check(self) -> None:
        rights = [self.base, *(s.right for s in self.steps)]
        if len(self.steps) > MOST_JOINS or len(self.group_by) > MOST_GROUPS or len(self.measures) > MOST_MEASURES:
            raise ValueError("the recipe is larger than a recipe may be")
        if len(set(rights)) != len(rights):
            raise ValueError("each source is joined once")
        if self.group_by and not self.aggregates:
            raise ValueError("a grouping needs aggregates")

    def run(self, sources: dict[str, DataFrame]) -> DataFrame:
        self.check()
        out = qualify(sources[self.base], self.base)
        for s in self.steps:
            rule = JoinRule([column_name(c) for c in s.left_keys], [column_name(f"{s.right}.{c}") for c in s.right_keys], s.trim, s.scopes, s.periods)
            right = qualify(sources[s.right], s.right)
            if self.most_pairs is not None:
                pairs = expansion(out, right, rule.left, rule.right, rule.trim).first()["joined_rows"]
                if pairs > self.most_pairs:
                    raise ValueError(f"joining {s.right} makes {pairs} pairs, over {self.most_pairs}")  # J7
            out = join(out, right, rule)
        if self.where is not None:
            out = out.where(self.where)
        for name, value in self.measures.items():
            if name in out.columns:
                raise ValueError(f"a measure may not overwrite {name}")
            out = out.withColumn(name, value)
        if self.aggregates:
            out = aggregate(out, [column_name(g) for g in self.group_by], self.aggregates)
        if self.select:
            lost = [c for c in self.select.values() if column_name(c) not in out.columns]
            if lost:
                raise ValueError(f"no field {lost[0]}")  # P3
            out = out.select(*(F.col(column_name(c)).alias(n) for n, c in self.select.items()))
        if self.refuse_empty:
            out = not_empty(out)
        return at_most(out, self.most_rows) if self.most_rows else out
