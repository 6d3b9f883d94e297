"""Queries that go through files: driver tables written as CSV and loaded again, described, and
results written by the sinks. Each has its twin in DuckDB SQL on the driver's tables."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine import Engine, TableInfo
from millrace.functions.typed import yyyymmdd
from millrace.sinks import render
from millrace.sources.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _loaded(frame: DataFrame, quote: str = "") -> Engine:
    """An engine with the frame as table `t`, by way of CSV files."""
    spark = frame.sparkSession
    path = scratch_path(spark, "csv")
    options = {"quote": quote, "escape": quote} if quote else {"quote": "", "escape": "\u0000"}
    frame.write.csv(path, header=True, emptyValue="", **options)
    engine = Engine(spark)
    engine.load_csv("t", path, quote)
    return engine


def _info_rows(spark: SparkSession, info: TableInfo) -> DataFrame:
    rows = [(c.name, c.type, info.rows, c.ndv, None if c.min is None else float(c.min), None if c.max is None else float(c.max)) for c in info.columns]
    return spark.createDataFrame(rows, "name string, type string, n long, ndv long, low double, high double")


def _info_sql(table: str, columns: dict[str, tuple[str, str]]) -> str:
    """`columns`: type and SQL expression by name."""
    parts = []
    for name, (kind, value) in columns.items():
        span = ("NULL", "NULL") if kind == "STRING" else (f"CAST(min({value}) AS DOUBLE)", f"CAST(max({value}) AS DOUBLE)")
        parts.append(f"SELECT '{name}' AS name, '{kind}' AS type, count(*) AS n, count(DISTINCT {value}) AS ndv, {span[0]} AS low, {span[1]} AS high FROM {table}")
    return " UNION ALL ".join(parts)


_ORDERS = {name: (kind, name) for name, kind in (("o_orderkey", "INT64"), ("o_custkey", "INT64"), ("o_orderstatus", "STRING"), ("o_totalprice", "DOUBLE"), ("o_orderpriority", "STRING"))}


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(_table(spark, sf_dir, "customer")).sql("SELECT * FROM t")


def csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    day = yyyymmdd(F.col("o_orderdate")).alias("o_day")
    return _info_rows(spark, _loaded(orders.select(*_ORDERS, day)).describe("t"))


def csv_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", yyyymmdd(F.col("o_orderdate")).alias("o_day"))
    return _loaded(orders).sql("SELECT o_day, COUNT(*) AS n FROM t WHERE o_day BETWEEN 19970101 AND 19970630 GROUP BY o_day")


def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return _loaded(events, '"').sql("SELECT event_id, event_type, props FROM t")


def csv_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(_table(spark, sf_dir, "customer"))
    engine.register("nation", _table(spark, sf_dir, "nation"))
    return engine.sql("SELECT n_name, COUNT(*) AS n, SUM(c_custkey) AS s FROM t JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as the CSV sink writes it, read back from its text."""
    engine = Engine(spark)
    engine.register("supplier", _table(spark, sf_dir, "supplier"))
    out = io.StringIO()
    render.delimited(engine.sql("SELECT s_suppkey, s_name, s_acctbal, s_acctbal / 3 AS third FROM supplier"), out)
    engine.load_lines("t", out.getvalue().splitlines())
    return engine.sql("SELECT * FROM t")


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", _table(spark, sf_dir, "nation"))
    out = io.StringIO()
    render.markdown(engine.sql("SELECT n_nationkey, n_name, n_nationkey * 1.5 AS more FROM nation ORDER BY n_nationkey"), out)
    return spark.createDataFrame([(i, x) for i, x in enumerate(out.getvalue().splitlines())], "line long, text string")


def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("events", _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    return _info_rows(spark, engine.describe("events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (csv_scan, csv_types, csv_dates, csv_quoted, csv_join, csv_sink, markdown_lines, describe_events)
}

_DAY = "CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER)"

ORACLE_SQL = {
    "csv_scan": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "csv_types": _info_sql("orders", {**_ORDERS, "o_day": ("DATE32", _DAY)}),
    "csv_dates": f"SELECT {_DAY} AS o_day, count(*) AS n FROM orders WHERE {_DAY} BETWEEN 19970101 AND 19970630 GROUP BY 1",
    "csv_quoted": "SELECT event_id, event_type, props FROM events",
    "csv_join": "SELECT n_name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "csv_sink": "SELECT s_suppkey, s_name, CAST(format('{:.6f}', s_acctbal) AS DOUBLE) AS s_acctbal, CAST(format('{:.6f}', s_acctbal / 3) AS DOUBLE) AS third FROM supplier",
    "markdown_lines": """
WITH c AS (
  SELECT -2 AS k, 'n_nationkey' AS a, 'n_name' AS b, 'more' AS c
  UNION ALL SELECT n_nationkey, CAST(n_nationkey AS VARCHAR), n_name, format('{:.6f}', n_nationkey * CAST(1.5 AS DOUBLE)) FROM nation
), w AS (SELECT max(length(a)) AS wa, max(length(b)) AS wb, max(length(c)) AS wc FROM c),
x AS (SELECT * FROM c UNION ALL SELECT -1, repeat('-', wa), repeat('-', wb), repeat('-', wc) FROM w)
SELECT row_number() OVER (ORDER BY k) - 1 AS line, '| ' || rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || rpad(b, CAST(wb AS INTEGER), ' ') || ' | ' || rpad(c, CAST(wc AS INTEGER), ' ') || ' |' AS text FROM x, w""",
    "describe_events": _info_sql("events", {"event_id": ("INT64", "event_id"), "user_id": ("INT64", "user_id"), "event_type": ("STRING", "event_type"), "value": ("DOUBLE", "value")}),
}
