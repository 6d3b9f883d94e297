"""CSV files as tables.

The first line names the columns; fields are split at commas and, unless a quote character is
given, quotes mean nothing. Empty lines are skipped, and a row of another width is an error. Each
column gets the narrowest type that fits all its values: DATE32 (eight digits from 19000000 to
21000000, kept as yyyymmdd), INT64, DOUBLE, else STRING. One pass over all columns finds the
types, and meets every malformed row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import SPARK_ERRORS, DataProblem
from millrace.functions.typed import DATE
from millrace.operators.relational import quoted

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INTEGER = r"^\s*[+-]?\d+$"
_NOT_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)$"
_INT_LIMIT = 9.223372036854775e18


def load_csv(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    try:
        head = spark.read.text(path).filter(F.length("value") > 0).limit(1).collect()
    except SPARK_ERRORS as e:
        raise DataProblem(f"cannot open file: {path}") from e
    return _typed(spark, path, head[0][0] if head else "", quote, path)


def csv_lines(spark: SparkSession, lines: Iterable[str], quote: str = "") -> DataFrame:
    """A table from lines in memory, such as standard input."""
    kept = [x for x in (line.rstrip("\r\n") for line in lines) if x]
    return _typed(spark, spark.sparkContext.parallelize(kept), kept[0] if kept else "", quote, "the lines")


def _typed(spark: SparkSession, source, header: str, quote: str, shown: str) -> DataFrame:
    names = header.rstrip("\r").split(",")
    if not header:
        raise DataProblem(f"{shown} has no header")
    if len(set(names)) < len(names):
        raise DataProblem(f"{shown} names a column twice")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(source, schema=schema, header=True, quote=quote, mode="FAILFAST", enforceSchema=True, escape=quote or "\u0000")
    raw = raw.select(*(F.coalesce(quoted(f.name), F.lit("")).alias(f.name) for f in schema))
    kinds = _kinds(raw, shown)
    return raw.select(*(_cast(quoted(f"c{i}"), kind).alias(name, metadata=DATE if kind == "DATE32" else {}) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))))


def _kinds(raw: DataFrame, shown: str) -> list[str]:
    tests = {"DATE32": _is_date, "INT64": _is_integer, "DOUBLE": lambda c: c.rlike(_NUMBER) | c.rlike(_NOT_FINITE)}
    measures = [F.min(test(quoted(c))).alias(f"{c}_{kind}") for c in raw.columns for kind, test in tests.items()]
    try:
        row = raw.agg(*measures).first()
    except SPARK_ERRORS as e:
        if "MALFORMED" in str(e).upper():
            raise DataProblem(f"row size mismatch in {shown}") from e
        raise
    return [next((kind for kind in tests if row[f"{c}_{kind}"]), "STRING") for c in raw.columns]


def _is_date(c: Column) -> Column:
    return c.rlike(r"^\d{8}$") & (c >= "19000000") & (c <= "21000000")


def _is_integer(c: Column) -> Column:
    number = c.try_cast("double")
    return F.coalesce(F.when(c.rlike(_INTEGER), F.trim(c).try_cast("bigint").isNotNull()).otherwise(c.rlike(_NUMBER) & (number == F.floor(number)) & (F.abs(number) < _INT_LIMIT)), F.lit(False))


def _cast(c: Column, kind: str) -> Column:
    if kind == "DATE32":
        return c.cast("int")
    if kind == "INT64":
        return F.when(c.rlike(_INTEGER), F.trim(c).try_cast("bigint")).otherwise(c.try_cast("double").cast("bigint"))
    return F.trim(c).cast("double") if kind == "DOUBLE" else c


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except SPARK_ERRORS as e:
        raise DataProblem(f"cannot open file: {path}") from e
