"""Errors that a user of the engine can cause."""

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

#: What Spark raises, by itself or for a failed job.
SPARK_ERRORS = (PySparkException, Py4JError)


class EngineError(Exception):
    """Anything that the engine refuses."""


class SyntaxProblem(EngineError):
    """The text is no statement of the language."""


class UnknownName(EngineError):
    """A table, column or function that isn't there, or more than one that fits."""


class TypeProblem(EngineError):
    """An operation on types that don't go with it."""


class DataProblem(EngineError):
    """Input that can't be read as a table."""
