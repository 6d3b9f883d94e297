"""Every query of the catalogue against DuckDB, and random statements against it."""

import random
import re

import duckdb
import pytest

from millrace import catalogue, files


@pytest.fixture(scope="module")
def duck(data_dir):
    c = duckdb.connect()
    for name in catalogue.TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return c


def canonical(rows):
    return sorted((tuple("nan" if v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalogue.CATALOGUE)
def test_query(spark, duck, data_dir, name):
    frame = catalogue.QUERIES[name](spark, data_dir)
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    assert frame.columns == expected.columns
    assert canonical(map(tuple, frame.collect())) == canonical(expected.fetchall())


@pytest.mark.parametrize("name", [n for n, q in catalogue.CATALOGUE.items() if q.rounded])
def test_unrounded_values(spark, duck, data_dir, name):
    """Sums and averages as they are, within what the order of additions may change."""
    query = catalogue.CATALOGUE[name]
    got = sorted((tuple(r) for r in catalogue.engine(spark, data_dir).sql(query.sql).collect()), key=repr)
    expected = sorted(duck.sql(re.sub(r"round\((.+?), 2\) AS", r"\1 AS", query.oracle)).fetchall(), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == pytest.approx(y, rel=1e-12) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_double_quotients_of_nulls_and_zeros(spark, tmp_path):
    values = ["NULL", "0.0", "-0.0", "'nan'", "'inf'", "'-inf'", "5.0", "-5.0"]
    rows = ", ".join(f"({i}, {j}, {a}::DOUBLE, {b}::DOUBLE, TIMESTAMP '2000-01-01')" for i, a in enumerate(values) for j, b in enumerate(values))
    c = duckdb.connect()
    c.execute(f"CREATE TABLE lineitem AS SELECT * FROM (VALUES {rows}) t(l_orderkey, l_linenumber, l_quantity, l_discount, l_shipdate)")
    c.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    got = catalogue.QUERIES["double_div_zero_inf"](spark, str(tmp_path)).collect()
    assert canonical(map(tuple, got)) == canonical(c.sql(catalogue.ORACLE_SQL["double_div_zero_inf"]).fetchall())


@pytest.mark.parametrize("name", files.QUERIES)
def test_query_through_files(spark, duck, data_dir, name):
    frame = files.QUERIES[name](spark, data_dir)
    expected = duck.sql(files.ORACLE_SQL[name])
    assert frame.columns == expected.columns
    assert canonical(map(tuple, frame.collect())) == canonical(expected.fetchall())


def test_day_and_decimal_predicates_reach_the_scan(spark, data_dir):
    e = catalogue.engine(spark, data_dir)
    plan = e.explain_physical("SELECT o_orderkey FROM orders WHERE o_day BETWEEN 19970101 AND 19970131 AND o_orderkey > 10.5")
    pushed = plan.split("PushedFilters")[1].splitlines()[0]
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in pushed and "LessThan(o_orderdate,1997-02-01" in pushed and "GreaterThanOrEqual(o_orderkey,11)" in pushed
    assert e.sql("SELECT COUNT(*) FROM orders WHERE o_day = 19970101 OR o_day != 19970101").first()[0] == e.table("orders").count()


def _expression(r, depth=2):
    if depth == 0 or r.random() < 0.3:
        return r.choice(["o_orderkey", "o_custkey", "o_totalprice", str(r.randint(1, 2000)), f"{r.randint(1, 9)}.5"])
    return f"({_expression(r, depth - 1)} {r.choice('+-*')} {_expression(r, depth - 1)})"


def _condition(r, depth=2):
    if depth == 0 or r.random() < 0.4:
        return r.choice([f"{_expression(r, 1)} {r.choice(['=', '!=', '<', '<=', '>', '>=', '<>'])} {_expression(r, 1)}", f"{_expression(r, 1)} BETWEEN {r.randint(0, 500)} AND {r.randint(500, 90000)}", "o_orderstatus = 'F'"])
    return f"({_condition(r, depth - 1)} {r.choice(['AND', 'OR'])} {_condition(r, depth - 1)})"


@pytest.mark.parametrize("seed", range(12))
def test_random_statement(spark, duck, data_dir, seed):
    r = random.Random(seed)
    where = f" WHERE {_condition(r)}" if r.random() < 0.8 else ""
    if seed % 2:
        sql = f"SELECT o_orderkey, {_expression(r)} AS e FROM orders{where}"
    else:
        key = r.choice(["o_orderstatus", "o_orderpriority"])
        sql = f"SELECT {key}, COUNT(*) AS n, AVG({_expression(r)}) AS a FROM orders{where} GROUP BY {key}" + r.choice(["", " HAVING COUNT(*) > 10"])
    got = [tuple(float(v) if isinstance(v, float) else v for v in x) for x in catalogue.engine(spark, data_dir).sql(sql).collect()]
    expected = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in x) for x in duck.sql(sql.replace(".5", ".5::DOUBLE")).fetchall()]
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=repr), sorted(expected, key=repr), strict=True):
        assert all(x == (y if isinstance(y, str) else pytest.approx(y, rel=1e-9)) for x, y in zip(a, b, strict=True))
