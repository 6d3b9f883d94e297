"""Statements over small tables."""

import math

import pytest

from millrace.engine import Engine
from millrace.errors import SPARK_ERRORS, EngineError, SyntaxProblem, TypeProblem, UnknownName


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("stock", spark.createDataFrame([(1, 10, 0.5, "b"), (2, 20, 0.0, "a"), (3, 30, -1.5, "B")], "id int, qty int, rate double, tag string"))
    e.register("place", spark.createDataFrame([(1, "north"), (2, "south"), (4, "west")], "id bigint, region string"))
    e.register("dotted", spark.createDataFrame([(1, 7)], "`dotted.id` bigint, `a b` bigint"))
    return e


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT id FROM stock WHERE qty > 15 ORDER BY id", [(2,), (3,)]),
        ("SELECT id, qty * 2 FROM stock ORDER BY id", [(1, 20), (2, 40), (3, 60)]),
        ("SELECT id FROM stock ORDER BY qty DESC LIMIT 1", [(3,)]),
        ("SELECT id, region FROM stock JOIN place ON place.id = stock.id ORDER BY region", None),
        ("SELECT stock.id, region FROM stock JOIN place ON place.id = stock.id ORDER BY region", [(1, "north"), (2, "south")]),
        ("SELECT region, SUM(qty) AS total FROM stock s JOIN place p ON s.id = p.id GROUP BY region ORDER BY total DESC LIMIT 1", [("south", 20)]),
        ("SELECT COUNT(*), AVG(qty) FROM stock", [(3, 20.0)]),
        ("SELECT COUNT(*), SUM(qty) FROM stock WHERE id > 9", [(0, None)]),
        ("SELECT qty / 7, (0 - qty) / 7 FROM stock WHERE id = 1", [(1, -1)]),
        ("SELECT rate / 0 FROM stock WHERE id = 3", [(math.inf,)]),
        ("SELECT id > 1, id > 1 AND qty FROM stock ORDER BY id", [(0, 0), (1, 1), (1, 1)]),
        ("SELECT id FROM stock WHERE id - 1 ORDER BY id", [(2,), (3,)]),
        ("SELECT tag FROM stock ORDER BY tag", [("B",), ("a",), ("b",)]),
        ("SELECT id FROM stock WHERE tag >= 'a' ORDER BY id", [(1,), (2,)]),
        ("SELECT qty * 2 AS qty FROM stock ORDER BY qty DESC LIMIT 1", [(60,)]),
        ("SELECT id FROM stock WHERE rate BETWEEN -2 AND 0.0 ORDER BY id", [(2,), (3,)]),
        ("SELECT SUM(qty) / COUNT(*) FROM stock HAVING COUNT(*) > 2", [(20,)]),
        ("SELECT qty / 20 AS g, COUNT(*) FROM stock GROUP BY g ORDER BY g", [(0, 1), (1, 2)]),
        ("SELECT stock.id FROM stock GROUP BY id HAVING SUM(qty) >= 20 ORDER BY SUM(qty) DESC", [(3,), (2,)]),
        ("SELECT a.id FROM stock a JOIN stock b ON a.id < b.id ORDER BY a.id", [(1,), (1,), (2,)]),
        ("SELECT dotted.id FROM dotted", [(1,)]),
        ("SELECT id, * FROM place ORDER BY id LIMIT 1", [(1, 1, "north")]),
        ("SELECT * FROM place LIMIT 0", []),
        ("select count(*) from stock where id <> 2;", [(2,)]),
        ("SELECT id FROM stock WHERE id = 1.0", [(1,)]),
    ],
)
def test_results(engine, sql, expected):
    if expected is None:
        with pytest.raises(UnknownName):
            engine.sql(sql)
    else:
        assert rows(engine.sql(sql)) == expected


def test_result_names(engine):
    assert engine.sql("SELECT id, qty + 1, COUNT(*), SUM(qty * 2) AS s FROM stock GROUP BY id, qty").columns == ["id", "expr", "COUNT(*)", "s"]
    assert engine.sql("SELECT * FROM stock s JOIN place p ON s.id = p.id").columns == ["id", "qty", "rate", "tag", "id", "region"]


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT nope FROM stock", UnknownName),
        ("SELECT ID FROM stock", UnknownName),
        ("SELECT id FROM nowhere", UnknownName),
        ("SELECT id FROM stock JOIN stock ON id = id", UnknownName),
        ("SELECT tag + 1 FROM stock", TypeProblem),
        ("SELECT SUM(tag) FROM stock", TypeProblem),
        ("SELECT id FROM stock WHERE tag", TypeProblem),
        ("SELECT id FROM stock WHERE tag = 1", TypeProblem),
        ("SELECT id FROM stock WHERE SUM(qty) > 1", EngineError),
        ("SELECT id, SUM(qty) FROM stock", TypeProblem),
        ("SELECT * FROM stock GROUP BY id", EngineError),
        ("SELECT id FROM stock GROUP BY 1", EngineError),
        ("SELECT id FROM stock GROUP BY SUM(id)", EngineError),
        ("SELECT 99999999999999999999 FROM stock", TypeProblem),
        ("SELECT id FROM stock trailing words", SyntaxProblem),
    ],
)
def test_refused(engine, sql, error):
    with pytest.raises(error):
        engine.sql(sql)


@pytest.mark.parametrize("sql", ["SELECT id / 0 FROM stock", "SELECT id * 9223372036854775807 FROM stock"])
def test_arithmetic_errors_at_run_time(engine, sql):
    with pytest.raises(SPARK_ERRORS):
        engine.sql(sql).collect()


def test_filter_and_columns_reach_the_scan(spark, data_dir):
    e = Engine(spark)
    e.load_parquet("orders", f"{data_dir}/orders.parquet", widen=False)
    plan = e.explain_physical("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
    assert "GreaterThan(o_totalprice,1000" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_limit_after_order_is_one_operator(engine):
    assert "TakeOrderedAndProject" in engine.explain_physical("SELECT id FROM stock ORDER BY qty LIMIT 2")


def test_describe(engine):
    info = engine.describe("stock")
    assert info.rows == 3
    assert [(c.name, c.type, c.ndv, c.min, c.max) for c in info.columns] == [("id", "INT64", 3, 1, 3), ("qty", "INT64", 3, 10, 30), ("rate", "DOUBLE", 3, -1.5, 0.5), ("tag", "STRING", 3, None, None)]
