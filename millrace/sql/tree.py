"""Syntax tree. Nodes are frozen, so equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass

AGGREGATES = ("SUM", "COUNT", "AVG")


class Expr:
    """An expression; str() gives its text with explicit parentheses."""

    def children(self) -> tuple[Expr, ...]:
        return ()


@dataclass(frozen=True)
class Name(Expr):
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Number(Expr):
    value: int | float

    def __str__(self) -> str:
        return f"{self.value:g}" if isinstance(self.value, float) else str(self.value)


@dataclass(frozen=True)
class Text(Expr):
    value: str

    def __str__(self) -> str:
        return f"'{self.value}'"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"

    def children(self) -> tuple[Expr, ...]:
        return self.left, self.right


@dataclass(frozen=True)
class Negative(Expr):
    operand: Expr

    def __str__(self) -> str:
        return f"(-{self.operand})"

    def children(self) -> tuple[Expr, ...]:
        return (self.operand,)


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr

    def __str__(self) -> str:
        return f"({self.value} BETWEEN {self.low} AND {self.high})"

    def children(self) -> tuple[Expr, ...]:
        return self.value, self.low, self.high


@dataclass(frozen=True)
class Call(Expr):
    """An aggregate; no argument means all rows, COUNT(*)."""

    function: str
    argument: Expr | None

    def __str__(self) -> str:
        return f"{self.function}({'*' if self.argument is None else self.argument})"

    def children(self) -> tuple[Expr, ...]:
        return () if self.argument is None else (self.argument,)


@dataclass(frozen=True)
class Item:
    """A select item; without an expression it is `*`."""

    expr: Expr | None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (str(self.expr) if isinstance(self.expr, (Name, Call)) else "expr")

    def __str__(self) -> str:
        shown = "*" if self.expr is None else str(self.expr)
        return f"{shown} AS {self.alias}" if self.alias else shown


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    table: Table
    on: Expr


@dataclass(frozen=True)
class OrderKey:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: Table
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[OrderKey, ...] = ()
    limit: int | None = None

    @property
    def is_aggregate(self) -> bool:
        outputs = [i.expr for i in self.items if i.expr is not None] + [k.expr for k in self.order_by]
        return bool(self.group_by) or self.having is not None or any(aggregates(e) for e in outputs)


def walk(expr: Expr):
    yield expr
    for child in expr.children():
        yield from walk(child)


def aggregates(expr: Expr) -> list[Call]:
    return [e for e in walk(expr) if isinstance(e, Call)]
