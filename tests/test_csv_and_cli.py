"""CSV files, rendering and the command line."""

import io
import subprocess
import sys

import pytest

from millrace.cli import main
from millrace.engine import Engine
from millrace.errors import DataProblem
from tests.conftest import ROOT


@pytest.fixture
def csv(tmp_path):
    def write(text, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)

    return write


def load(spark, path, **options):
    e = Engine(spark)
    e.load_csv("t", path, **options)
    return e


def types(e):
    return [c.type for c in e.describe("t").columns]


@pytest.mark.parametrize(
    ("values", "kind", "first"),
    [
        (["20240101", "19991231"], "DATE32", 20240101),
        (["20240101", "21000001"], "INT64", 20240101),
        (["20240101", "x"], "STRING", "20240101"),
        (["1.0", "1e3"], "INT64", 1),
        (["1.5", " 2"], "DOUBLE", 1.5),
        (["9007199254740993", "-1"], "INT64", 9007199254740993),
        (["99999999999999999999", "1"], "DOUBLE", 1e20),
        (["inf", "1"], "DOUBLE", float("inf")),
        (["12abc", "1"], "STRING", "12abc"),
        (["2024-01-01", "1"], "STRING", "2024-01-01"),
        (["0x10", "1"], "STRING", "0x10"),
        (["", "1"], "STRING", ""),
    ],
)
def test_inference(spark, csv, values, kind, first):
    e = load(spark, csv("k,v\n" + "".join(f"{i},{v}\n" for i, v in enumerate(values))))
    assert types(e) == ["INT64", kind]
    assert e.sql("SELECT v FROM t ORDER BY k LIMIT 1").first()[0] == first


def test_shapes(spark, csv):
    assert types(load(spark, csv("a,b\n", "head.csv"))) == ["STRING", "STRING"]
    assert load(spark, csv("a,b,c\r\n\r\n1,2,\r\n", "crlf.csv")).sql("SELECT * FROM t").collect() == [(1, 2, "")]
    assert load(spark, csv('a,b\n"x,y"\n', "plain.csv")).sql("SELECT b FROM t").collect() == [('y"',)]
    assert load(spark, csv('a,b\n"x,y",1\n', "quoted.csv"), quote='"').sql("SELECT a FROM t").collect() == [("x,y",)]
    assert load(spark, csv("o.id,o.q\n1,2\n", "dots.csv")).sql("SELECT o.q FROM t WHERE o.id = 1").collect() == [(2,)]


@pytest.mark.parametrize("text", ["a,b\n1\n", "a,b\n1,2,3\n", "a,a\n1,2\n", ""])
def test_refused(spark, csv, text):
    with pytest.raises(DataProblem):
        load(spark, csv(text))


def test_missing_file(spark, tmp_path):
    with pytest.raises(DataProblem, match="cannot open file"):
        load(spark, str(tmp_path / "none.csv"))


def run(spark, argv, stdin=""):
    out, err = io.StringIO(), io.StringIO()
    code = main(argv, io.StringIO(stdin), out, err, spark)
    return code, out.getvalue(), err.getvalue()


def test_one_statement(spark, csv):
    path = csv("id,name,value\n1,Ann,1.5\n2,Bo,20.25\n")
    assert run(spark, [path, "--sql", "SELECT * FROM table ORDER BY id"]) == (0, "| id | name | value     |\n| -- | ---- | --------- |\n| 1  | Ann  | 1.500000  |\n| 2  | Bo   | 20.250000 |\n", "")
    assert run(spark, ["--sql", "SELECT name FROM table", "--output-format", "CSV"], 'name\n"q"\n') == (0, 'name\n"""q"""\n', "")
    assert run(spark, [path, "--sql", "SELECT id FROM table WHERE id > 5"])[1] == "(no results)\n"
    assert run(spark, [path, "--sql", "SELECT id FROM table WHERE id > 5", "--output-format", "csv"])[1] == "id\n"
    code, out, err = run(spark, [path, "--sql", "SELECT nope FROM table"])
    assert code == 1 and not out and "unknown column nope" in err


@pytest.mark.parametrize("argv", [["--sql"], ["--output-format"], ["--what"], ["a.csv", "b.csv"], ["--output-format", "xml"]])
def test_bad_arguments(spark, argv):
    assert run(spark, argv)[0] == 1


def test_prompt(spark, csv):
    path = csv("id,name\n1,Ann\n2,Bo\n")
    lines = ["SHOW TABLES;", f"LOAD TABLE p FROM '{path}';", "SHOW TABLES", "DESCRIBE p;", "SET FORMAT csv", "select name from p order by id;", "EXPLAIN SELECT id FROM p", "SELECT x FROM p", "DESCRIBE q", "HELLO", "SET FORMAT xml", "", "EXIT", "SHOW TABLES"]
    code, out, _ = run(spark, [], "\n".join(lines) + "\n")
    assert code == 0
    for part in ("No tables loaded", "Loaded table 'p' with 2 rows", "Table: p (2 rows)", "  id INT64 (ndv: 2, min: 1, max: 2)", "  name STRING (ndv: 2)", "name\nAnn\nBo\n", "LogicalScan(table=p, cols=id)", "Error: unknown column x", "Error: table 'q' not found", "Unknown command", "Unsupported output format 'xml'"):
        assert part in out


def test_program(csv):
    """The program as it is started, with a file and with standard input."""
    path = csv("id,name\n1,Ann\n2,Bo\n")
    for argv, stdin in (([path], None), ([], "id,name\n1,Ann\n2,Bo\n")):
        command = [sys.executable, "-m", "millrace", *argv, "--sql", "SELECT name FROM table WHERE id = 2", "--output-format", "csv"]
        done = subprocess.run(command, input=stdin, capture_output=True, text=True, timeout=300, cwd=ROOT)
        assert (done.returncode, done.stdout) == (0, "name\nBo\n"), done.stderr[-2000:]
