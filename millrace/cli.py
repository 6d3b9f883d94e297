"""Command line: one statement over a CSV file or standard input, or a prompt."""

from __future__ import annotations

import re
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from millrace.engine import Engine, TableInfo
from millrace.errors import SPARK_ERRORS, EngineError
from millrace.sinks.render import FORMATS

USAGE = "usage: python -m millrace [file.csv] [--sql STATEMENT] [--output-format markdown|csv]"
COMMANDS = "LOAD TABLE <name> FROM 'file.csv', SHOW TABLES, DESCRIBE <table>, EXPLAIN <sql>, SELECT <sql>, SET FORMAT <markdown|csv>, EXIT"


# What the command line says.
SAYS = {
    "no value": "{} requires an argument",
    "no option": "Unknown option: {}",
    "many": "Too many positional arguments",
    "no format": "Unsupported output format '{}'. Use 'markdown' or 'csv'.",
    "no command": "Unknown command. Available: {}",
    "not shown": "Unknown command",
    "error": "Error: {}",
    "explain": "Syntax: EXPLAIN <sql>",
    "load": "Syntax: LOAD TABLE <name> FROM 'file.csv'",
    "loaded": "Loaded table '{}' with {} rows",
    "no tables": "No tables loaded",
    "no setting": "Unknown setting",
    "set": "Syntax: SET FORMAT <markdown|csv>",
    "format": "Output format set to {}",
    "file": "Loaded table from {}",
}


class BadArguments(Exception):
    pass


def arguments(argv: list[str]) -> tuple[str | None, str | None, str]:
    """File, statement and format."""
    file = sql = None
    form = "markdown"
    rest = iter(argv)
    for arg in rest:
        if arg in ("--sql", "--output-format"):
            value = next(rest, None)
            if value is None:
                raise BadArguments(SAYS["no value"].format(arg))
            if arg == "--sql":
                sql = value
            else:
                form = value.lower()
        elif arg.startswith("--"):
            raise BadArguments(SAYS["no option"].format(arg))
        elif file is not None:
            raise BadArguments(SAYS["many"])
        else:
            file = arg
    if form not in FORMATS:
        raise BadArguments(SAYS["no format"].format(form))
    return file, sql, form


def described(info: TableInfo) -> str:
    lines = [f"Table: {info.name} ({info.rows} rows)", "Columns:"]
    for c in info.columns:
        span = "" if c.min is None else f", min: {c.min}, max: {c.max}"
        lines.append(f"  {c.name} {c.type} (ndv: {c.ndv}{span})")
    return "\n".join(lines)


class Prompt:
    """One command a line; errors are shown and the prompt goes on."""

    def __init__(self, engine: Engine, out: TextIO, form: str = "markdown"):
        self.engine, self.out, self.form = engine, out, form

    def say(self, text: str) -> None:
        self.out.write(text + "\n")

    def run(self, line: str) -> bool:
        """False when the line ends the session."""
        line = line.strip().rstrip(";").rstrip()
        word = line.split(None, 1)[0].upper() if line else ""
        if word in ("EXIT", "QUIT"):
            return False
        action = getattr(self, f"_{word.lower()}", None) if word in ("LOAD", "SHOW", "DESCRIBE", "EXPLAIN", "SELECT", "SET") else None
        if action is None:
            if word:
                self.say(SAYS["no command"].format(COMMANDS))
            return True
        try:
            action(line)
        except (EngineError, *SPARK_ERRORS) as e:
            self.say(SAYS["error"].format(e))
        return True

    def _select(self, line: str) -> None:
        FORMATS[self.form](self.engine.sql(line), self.out)

    def _explain(self, line: str) -> None:
        statement = line[len("EXPLAIN") :].strip()
        self.say(self.engine.explain(statement) if statement else SAYS["explain"])

    def _load(self, line: str) -> None:
        m = re.fullmatch(r"LOAD\s+TABLE\s+(\S+)\s+FROM\s+(?:'([^']*)'|(\S+))", line, re.IGNORECASE)
        if m is None:
            self.say(SAYS["load"])
            return
        self.engine.load_csv(m[1], m[2] if m[2] is not None else m[3])
        self.say(SAYS["loaded"].format(m[1], self.engine.table(m[1]).count()))

    def _show(self, line: str) -> None:
        if not re.fullmatch(r"SHOW\s+TABLES", line, re.IGNORECASE):
            self.say(SAYS["not shown"])
            return
        self.say("\n".join(self.engine.tables()) or SAYS["no tables"])

    def _describe(self, line: str) -> None:
        self.say(described(self.engine.describe(line[len("DESCRIBE") :].strip())))

    def _set(self, line: str) -> None:
        m = re.fullmatch(r"SET\s+(\w+)(?:\s+(\S+))?", line, re.IGNORECASE)
        if m is None or m[1].upper() != "FORMAT":
            self.say(SAYS["no setting"])
        elif m[2] is None:
            self.say(SAYS["set"])
        elif m[2].lower() not in FORMATS:
            self.say(SAYS["no format"].format(m[2].lower()))
        else:
            self.form = m[2].lower()
            self.say(SAYS["format"].format(self.form))


def main(argv: list[str], stdin: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr, spark: SparkSession | None = None) -> int:
    try:
        file, sql, form = arguments(argv)
    except BadArguments as e:
        err.write(f"{e}\n{USAGE}\n")
        return 1
    engine = Engine(spark or SparkSession.builder.appName("millrace").getOrCreate())
    try:
        if file is not None:
            engine.load_csv("table", file)
        elif sql is not None:
            engine.load_lines("table", stdin)
        if sql is not None:
            FORMATS[form](engine.sql(sql), out)
            return 0
    except (EngineError, *SPARK_ERRORS) as e:
        err.write(SAYS["error"].format(e) + "\n")
        return 1
    if file is not None:
        out.write(SAYS["file"].format(file) + "\n")
    prompt = Prompt(engine, out, form)
    out.write("> ")
    for line in stdin:
        if not prompt.run(line):
            break
        out.write("> ")
    return 0
