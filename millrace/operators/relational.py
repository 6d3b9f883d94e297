"""Relational operators on inputs whose columns are known by qualifier and name.

An input column gets an inner name of its own, so joins never clash; projections like these
disappear in the optimizer, and pruning and pushdown reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import UnknownName
from millrace.functions.typed import DAY_OF, Typed, kind_of


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Field:
    qualifier: str
    name: str
    inner: str
    kind: str
    day_of: str | None = None


@dataclass(frozen=True)
class Relation:
    frame: DataFrame
    fields: tuple[Field, ...]

    def find(self, text: str) -> Field:
        """`column`, `qualifier.column`, or a column whose own name has a dot."""
        qualifier, _, name = text.partition(".")
        for fits in (lambda f: name and (f.qualifier, f.name) == (qualifier, name), lambda f: f.name == text):
            found = [f for f in self.fields if fits(f)]
            if len(found) > 1:
                raise UnknownName(f"column {text} is ambiguous")
            if found:
                return found[0]
        raise UnknownName(f"unknown column {text}")

    def column(self, text: str) -> Typed:
        f = self.find(text)
        return Typed(quoted(f.inner), f.kind, day_of=quoted(f.day_of) if f.day_of else None)


def scan(frame: DataFrame, qualifier: str, number: int) -> Relation:
    inner = {s.name: f"{number}_{i}_{s.name}" for i, s in enumerate(frame.schema)}
    fields = tuple(Field(qualifier, s.name, f"{number}_{i}_{s.name}", kind_of(s.dataType), inner.get(s.metadata.get(DAY_OF))) for i, s in enumerate(frame.schema))
    plain = frame.toDF(*(f.inner for f in fields))
    return Relation(plain, fields)


def inner_join(left: Relation, right: Relation, condition) -> Relation:
    """condition: from the joined relation to its predicate. Spark takes equality conjuncts as
    keys and keeps the rest as a filter of the join; it chooses the strategy by size."""
    both = left.fields + right.fields
    return Relation(left.frame.join(right.frame, condition(Relation(left.frame, both)), "inner"), both)


def where(relation: Relation, predicate: Column) -> Relation:
    return Relation(relation.frame.filter(predicate), relation.fields)


def group(relation: Relation, keys: list[Column], measures: list[Column]) -> DataFrame:
    """Keys, then measures. Without measures the distinct keys; without keys one row."""
    if keys:
        return relation.frame.groupBy(*keys).agg(*measures) if measures else relation.frame.select(*keys).distinct()
    return relation.frame.agg(*measures)


def sort(frame: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    return frame.orderBy(*(quoted(k).asc() if up else quoted(k).desc() for k, up in keys)) if keys else frame


def fold(relations: list[Relation], conditions: list) -> Relation:
    return reduce(lambda left, step: inner_join(left, *step), zip(relations[1:], conditions, strict=True), relations[0])
