"""The engine's queries over the driver's tables, each with the same query in DuckDB SQL.

Statements go through the engine's own language. Tables are registered without widening, so that
result types are those of the files; dates come as yyyymmdd columns made by a function, as the
language has none. Sums of doubles depend on the order of additions and are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.functions.typed import DATE, DAY_OF, yyyymmdd
from millrace.operators.relational import quoted
from millrace.sql.grammar import parse


class Query(NamedTuple):
    sql: str
    oracle: str
    rounded: tuple[str, ...] = ()


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
DATES = {"orders": ("o_orderdate", "o_day"), "lineitem": ("l_shipdate", "l_day"), "events": ("ts", "day")}


def _day(column: str) -> str:
    return f"CAST(strftime({column}, '%Y%m%d') AS INTEGER)"


CATALOGUE: dict[str, Query] = {
    "scan_all": Query("SELECT * FROM nation", "SELECT * FROM nation"),
    "scan_events": Query("SELECT event_id, user_id, event_type, value FROM events", "SELECT event_id, user_id, event_type, value FROM events"),
    "project_arith": Query(
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS dq, l_extendedprice - l_discount AS net FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS dq, l_extendedprice - l_discount AS net FROM lineitem",
    ),
    "project_unary_decimal": Query("SELECT c_custkey, -c_acctbal AS minus, c_acctbal * 1.5 AS more FROM customer", "SELECT c_custkey, -c_acctbal AS minus, c_acctbal * CAST(1.5 AS DOUBLE) AS more FROM customer"),
    "project_alias_shadow": Query("SELECT o_orderkey, o_custkey * 2 AS o_custkey FROM orders", "SELECT o_orderkey, o_custkey * 2 AS o_custkey FROM orders"),
    "int_div": Query("SELECT o_orderkey, o_orderkey / 7 AS q FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q FROM orders"),
    "int_div_negative": Query("SELECT o_orderkey, (0 - o_orderkey) / 7 AS q FROM orders", "SELECT o_orderkey, -(o_orderkey // 7) AS q FROM orders"),
    "double_div": Query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem"),
    "double_div_zero_inf": Query(
        "SELECT l_orderkey, l_linenumber, l_quantity / l_discount AS r FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity / l_discount END AS r FROM lineitem",
    ),
    "cmp_as_int": Query("SELECT o_orderkey, o_totalprice > 100000 AS big FROM orders", "SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS big FROM orders"),
    "logic_as_int": Query(
        "SELECT o_orderkey, o_totalprice > 100000 AND o_orderkey / 2 AS both FROM orders", "SELECT o_orderkey, CAST(o_totalprice > 100000 AND o_orderkey // 2 <> 0 AS BIGINT) AS both FROM orders"
    ),
    "filter_and_or": Query(
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice >= 200000",
        "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice >= 200000",
    ),
    "filter_ne": Query("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'"),
    "filter_less": Query("SELECT p_partkey FROM part WHERE p_size < 10 AND p_retailprice <= 1500", "SELECT p_partkey FROM part WHERE p_size < 10 AND p_retailprice <= 1500"),
    "filter_string_order": Query("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment < 'N'", "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment < 'N'"),
    "filter_truthy": Query("SELECT o_orderkey FROM orders WHERE o_orderkey / 10000", "SELECT o_orderkey FROM orders WHERE o_orderkey // 10000 <> 0"),
    "filter_between": Query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12"),
    "filter_days": Query(
        "SELECT o_orderkey FROM orders WHERE o_day > 19970231 AND o_day != 19970401 AND 19991340 > o_day OR o_day = 19950230 OR o_day < 19950100 OR o_day = 20000229",
        f"SELECT o_orderkey FROM orders WHERE {_day('o_orderdate')} > 19970231 AND {_day('o_orderdate')} <> 19970401 AND 19991340 > {_day('o_orderdate')} OR {_day('o_orderdate')} = 20000229",
    ),
    "filter_int_by_decimal": Query(
        "SELECT o_orderkey FROM orders WHERE o_orderkey > 10.5 AND o_orderkey <= 900.0 AND o_custkey != 17.5 OR o_custkey = 30.0 OR 2.5 >= o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_orderkey > 10.5 AND o_orderkey <= 900.0 AND o_custkey <> 17.5 OR o_custkey = 30.0 OR 2.5 >= o_orderkey",
    ),
    "filter_yyyymmdd": Query("SELECT o_orderkey, o_day AS d FROM orders WHERE o_day >= 19970101 AND o_day <= 19971231", f"SELECT o_orderkey, {_day('o_orderdate')} AS d FROM orders WHERE {_day('o_orderdate')} BETWEEN 19970101 AND 19971231"),
    "join_equi": Query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_chain": Query(
        "SELECT n_name, r_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey INNER JOIN region ON r_regionkey = n_regionkey",
        "SELECT n_name, r_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_residual": Query(
        "SELECT l_orderkey, l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice",
        "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice",
    ),
    "join_string_key": Query("SELECT a.r_regionkey AS k, b.r_name AS n FROM region a JOIN region AS b ON a.r_name = b.r_name", "SELECT a.r_regionkey AS k, b.r_name AS n FROM region a JOIN region b ON a.r_name = b.r_name"),
    "join_many_many": Query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "join_agg": Query(
        "SELECT n_name, COUNT(*) AS n, SUM(c_custkey) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "agg_global": Query(
        "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS nk, SUM(o_orderkey) AS s, AVG(o_totalprice) AS a FROM orders",
        "SELECT count(*) AS n, count(o_orderkey) AS nk, CAST(sum(o_orderkey) AS BIGINT) AS s, round(avg(o_totalprice), 2) AS a FROM orders",
        ("a",),
    ),
    "agg_group_multi": Query(
        "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, AVG(l_extendedprice) AS ap, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS ap, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
        ("q", "ap"),
    ),
    "agg_group_expr": Query("SELECT o_orderkey / 1000 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_orderkey / 1000", "SELECT o_orderkey // 1000 AS bucket, count(*) AS n FROM orders GROUP BY 1"),
    "agg_group_alias": Query("SELECT o_orderkey / 1000 AS bucket, COUNT(*) AS n FROM orders GROUP BY bucket", "SELECT o_orderkey // 1000 AS bucket, count(*) AS n FROM orders GROUP BY 1"),
    "agg_distinct_keys": Query("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "agg_having": Query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "agg_nested": Query(
        "SELECT o_orderpriority, SUM(o_totalprice) / COUNT(*) AS mean FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(sum(o_totalprice) / count(*), 2) AS mean FROM orders GROUP BY o_orderpriority", ("mean",)
    ),
    "agg_over_expression": Query(
        "SELECT l_returnflag, SUM(l_quantity * l_extendedprice) AS rev FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice), 2) AS rev FROM lineitem GROUP BY l_returnflag", ("rev",)
    ),
    "agg_group_key_not_selected": Query("SELECT SUM(o_totalprice) AS s FROM orders GROUP BY o_orderpriority", "SELECT round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority", ("s",)),
    "agg_global_empty": Query(
        "SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, AVG(o_orderkey) AS a FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_orderkey) AS a FROM orders WHERE o_orderkey < 0"
    ),
    "agg_names": Query("SELECT COUNT(*), SUM(o_custkey) FROM orders", 'SELECT count(*) AS "COUNT(*)", CAST(sum(o_custkey) AS BIGINT) AS "SUM(o_custkey)" FROM orders'),
    "sort_string": Query("SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC"),
    "sort_multi": Query(
        "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey",
        "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey",
    ),
    "sort_unselected": Query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "sort_by_aggregate": Query(
        "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10"
    ),
    "topk": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "limit_zero": Query("SELECT * FROM nation LIMIT 0", "SELECT * FROM nation LIMIT 0"),
    "rev_by_day": Query(
        "SELECT o_day AS order_date, SUM(o_totalprice) AS rev FROM orders WHERE o_orderstatus = 'F' AND o_day BETWEEN 19970101 AND 19970131 GROUP BY o_day ORDER BY o_day",
        f"SELECT {_day('o_orderdate')} AS order_date, round(sum(o_totalprice), 2) AS rev FROM orders WHERE o_orderstatus = 'F' AND {_day('o_orderdate')} BETWEEN 19970101 AND 19970131 GROUP BY 1 ORDER BY 1",
        ("rev",),
    ),
    "top_parts_by_rev": Query(
        "SELECT l.l_partkey AS l_partkey, SUM(l.l_quantity * l.l_extendedprice) AS rev FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY l.l_partkey ORDER BY rev DESC, l_partkey LIMIT 20",
        "SELECT l_partkey, round(sum(l_quantity * l_extendedprice), 2) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_partkey ORDER BY sum(l_quantity * l_extendedprice) DESC, l_partkey LIMIT 20",
        ("rev",),
    ),
}


def engine(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> Engine:
    """An engine with the named tables; each costs a look at its files' schema."""
    out = Engine(spark)
    for name in names:
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in DATES:
            source, day = DATES[name]
            date = yyyymmdd(F.col(source))
            out.register(name, frame.select("*", date.alias(day, metadata={**DATE, DAY_OF: source})), widen=False)
        else:
            out.register(name, frame, widen=False)
    return out


def _run(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    parsed = parse(query.sql)
    names = {parsed.table.name, *(j.table.name for j in parsed.joins)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir, names).sql(query.sql)
        return out.select(*(F.round(quoted(c), 2).alias(c) if c in query.rounded else quoted(c) for c in out.columns))

    return run


QUERIES = {name: _run(query) for name, query in CATALOGUE.items()}
ORACLE_SQL = {name: query.oracle for name, query in CATALOGUE.items()}
