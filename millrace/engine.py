"""The engine: a catalog of tables and the statements on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import UnknownName
from millrace.functions.typed import DATE, kind_of
from millrace.operators.relational import quoted
from millrace.plans.compiler import compile_select
from millrace.plans.outline import outline
from millrace.sources import csv_source
from millrace.sql.grammar import parse


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    ndv: int
    min: object = None
    max: object = None


@dataclass(frozen=True)
class TableInfo:
    name: str
    rows: int
    columns: tuple[ColumnInfo, ...]


def type_name(field: T.StructField) -> str:
    if field.metadata.get("logical") == DATE["logical"]:
        return "DATE32"
    return {"int": "INT64", "double": "DOUBLE", "text": "STRING"}.get(kind_of(field.dataType), field.dataType.simpleString().upper())


def _as_text(field: T.StructField):
    """A text that is the same for equal values only."""
    c = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0).cast(field.dataType)).otherwise(c)  # zero has two signs
    if isinstance(field.dataType, T.TimestampType):
        c = F.unix_micros(c)
    if isinstance(field.dataType, T.BinaryType):
        c = F.hex(c)
    return F.to_json(F.struct(c)) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


class Engine:
    """Tables are DataFrames; a statement gives a lazy DataFrame."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._info: dict[str, TableInfo] = {}

    def register(self, name: str, frame: DataFrame, widen: bool = True) -> None:
        """Adds or replaces a table. With `widen`, integers and floats become 64 bits wide; dates
        kept as yyyymmdd stay as they are."""
        if widen:
            frame = frame.select(*(self._wide(f) for f in frame.schema))
        self._tables[name] = frame
        self._info.pop(name, None)

    @staticmethod
    def _wide(field: T.StructField):
        kind = kind_of(field.dataType)
        if kind in ("int", "double") and field.metadata.get("logical") is None:
            return quoted(field.name).cast("bigint" if kind == "int" else "double").alias(field.name)
        return quoted(field.name)

    def load_csv(self, name: str, path: str, quote: str = "") -> None:
        self.register(name, csv_source.load_csv(self.spark, path, quote))

    def load_lines(self, name: str, lines) -> None:
        self.register(name, csv_source.csv_lines(self.spark, lines))

    def load_parquet(self, name: str, path: str, widen: bool = True) -> None:
        self.register(name, csv_source.load_parquet(self.spark, path), widen)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise UnknownName(f"table '{name}' not found")
        return self._tables[name]

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def describe(self, name: str) -> TableInfo:
        """Row count, and for each column the number of distinct values and the range: one pass for
        counts and ranges, one over (column, value) pairs, combined before their shuffle, for exact
        distinct counts."""
        if name in self._info:
            return self._info[name]
        frame = self.table(name)
        fields = frame.schema.fields
        ranged = [i for i, f in enumerate(fields) if kind_of(f.dataType) in ("int", "double")]
        total, *ranges = frame.agg(F.count(F.lit(1)), *(m(quoted(fields[i].name)) for i in ranged for m in (F.min, F.max))).first()
        pairs = frame.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _as_text(f).alias("v")) for i, f in enumerate(fields)))).alias("p")).filter("p.v is not null")
        ndv = {r["i"]: r["count"] for r in pairs.distinct().groupBy("p.i").count().collect()}  # a row a column
        span = {i: ranges[2 * n : 2 * n + 2] for n, i in enumerate(ranged)}
        columns = (ColumnInfo(f.name, type_name(f), ndv.get(i, 0), *span.get(i, (None, None))) for i, f in enumerate(fields))
        self._info[name] = TableInfo(name, total, tuple(columns))
        return self._info[name]

    def sql(self, text: str) -> DataFrame:
        return compile_select(parse(text), self.table)

    def explain(self, text: str) -> str:
        """The logical plan as text."""
        return outline(parse(text))

    def explain_physical(self, text: str) -> str:
        """Spark's plan of the statement."""
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
