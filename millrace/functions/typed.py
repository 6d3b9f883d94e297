"""Column expressions whose meaning depends on the operands' types.

Kinds: int (64-bit integers, dates as yyyymmdd and smaller integers), double, text, flag (the
outcome of a comparison, 0 or 1 as a number) and other (types that can be shown but not computed
with). NULL operands give NULL, but a zero divisor decides alone, also under a NULL.
"""

from __future__ import annotations

import calendar
import datetime
import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import TypeProblem


class Typed(NamedTuple):
    """An expression; its number if it is a literal; the timestamp or date that it is the day of."""

    column: Column
    kind: str
    value: int | float | None = None
    day_of: Column | None = None


def kind_of(field: T.DataType) -> str:
    if isinstance(field, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(field, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(field, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "flag" if isinstance(field, T.BooleanType) else "other"


def literal(value: int | float | str) -> Typed:
    if isinstance(value, str):
        return Typed(F.lit(value), "text")
    if isinstance(value, float):
        return Typed(F.lit(value), "double", value)
    if not -(2**63) <= value < 2**63:
        raise TypeProblem(f"{value} is no 64-bit integer")
    return Typed(F.lit(value).cast("bigint"), "int", value)


def as_number(x: Typed, of: str) -> Typed:
    if x.kind == "flag":
        return Typed(x.column.cast("bigint"), "int")
    if x.kind not in ("int", "double"):
        raise TypeProblem(f"{of} takes numbers")
    return Typed(x.column.cast("bigint" if x.kind == "int" else "double"), x.kind)


def as_flag(x: Typed) -> Column:
    if x.kind == "flag":
        return x.column
    if x.kind not in ("int", "double"):
        raise TypeProblem("a condition has to be a comparison or a number")
    return x.column != F.lit(0)


def shown(x: Typed) -> Column:
    """As a result column: flags as 0 and 1."""
    return x.column.cast("bigint") if x.kind == "flag" else x.column


def integer_quotient(a: Column, b: Column) -> Column:
    """Truncates toward zero; a zero divisor is an error, whatever the session's mode."""
    return F.when(b == 0, F.raise_error(F.lit("Division by zero")).cast("bigint")).otherwise(F.call_function("div", a, b))


def double_quotient(a: Column, b: Column) -> Column:
    """Positive infinity for a zero divisor, whatever the dividend, NULL too."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    a, b = as_number(left, op), as_number(right, op)
    kind = "double" if "double" in (a.kind, b.kind) else "int"
    x, y = (v.column.cast("double" if kind == "double" else "bigint") for v in (a, b))
    if op == "/":
        return Typed((double_quotient if kind == "double" else integer_quotient)(x, y), kind)
    return Typed({"+": x.__add__, "-": x.__sub__, "*": x.__mul__}[op](y), kind)


def _apply(op: str, x: Column, y) -> Column:
    return {"=": x.__eq__, "!=": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y)


def _as_range(op: str, x: Column, bound, after, exact: bool) -> Column:
    """x op v, where `bound` is the least value not under v, `after` the next value that isn't v, and
    `exact` tells whether v itself is a value."""
    if op in (">=", "<"):
        return _apply(op, x, bound)
    if op in (">", "<="):
        return _apply(">=" if op == ">" else "<", x, after if exact else bound)
    inside = (x >= bound) & (x < after) if exact else x != x
    return inside if op == "=" else ~inside


def _day_from(number: int) -> datetime.date:
    """The first day whose yyyymmdd is not under `number`."""
    year, month, day = number // 10000, number // 100 % 100, number % 100
    if month > 12:
        year, month, day = year + 1, 1, 1
    elif month < 1:
        month, day = 1, 1
    if day > calendar.monthrange(year, month)[1]:
        year, month, day = year + month // 12, month % 12 + 1, 1
    return datetime.date(year, month, max(1, day))


def _pushed(op: str, x: Typed, v: Typed) -> Column | None:
    """A comparison with a literal that the scan can take, where plain operators give it a cast or a
    function of a column instead."""
    if x.day_of is not None and isinstance(v.value, int) and 10101 <= v.value < 99991231:
        bound, after = _day_from(v.value), _day_from(v.value + 1)
        return _as_range(op, x.day_of, F.lit(bound), F.lit(after), bound != after)
    if x.kind == "int" and x.value is None and isinstance(v.value, float) and abs(v.value) < 2**53:
        bound = math.ceil(v.value)
        exact = bound == v.value
        if exact and op in ("=", "!="):
            return _apply(op, x.column, F.lit(bound))
        return _as_range(op, x.column, F.lit(bound), F.lit(bound + 1), exact)
    return None


def compare(op: str, left: Typed, right: Typed) -> Typed:
    """Integers and doubles compare as doubles; a literal on one side becomes a bound of the other."""
    for x, v, way in ((left, right, op), (right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op))):
        pushed = _pushed(way, x, v)
        if pushed is not None:
            return Typed(pushed, "flag")
    if left.kind == right.kind == "text":
        x, y = left.column, right.column
    elif "text" in (left.kind, right.kind):
        raise TypeProblem(f"{op} compares a text with a number")
    else:
        a, b = as_number(left, op), as_number(right, op)
        wide = "double" if "double" in (a.kind, b.kind) else "bigint"
        x, y = a.column.cast(wide), b.column.cast(wide)
        if left.kind == right.kind == "int":
            x, y = left.column, right.column  # without casts the filter reaches the scan
    return Typed(_apply(op, x, y), "flag")


def aggregate(function: str, argument: Typed | None) -> Typed:
    if function == "COUNT":
        return Typed(F.count(F.lit(1) if argument is None else argument.column), "int")
    x = as_number(argument, function)
    if function == "SUM":
        return Typed(F.sum(x.column), x.kind)
    return Typed(F.avg(x.column.cast("double")), "double")


def yyyymmdd(date: Column) -> Column:
    """A date or timestamp as an integer of the form yyyymmdd, marked as such."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int").alias("yyyymmdd", metadata=DATE)


#: Metadata of columns that hold yyyymmdd; DAY_OF names the column of the table that it is the day of.
DAY_OF = "day_of"
DATE = {"logical": "DATE32"}
