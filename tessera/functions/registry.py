"""Functions and table functions by name, for use in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from . import scalar


#: Functions that users have added.
OWN: dict[str, Callable] = {}


class Runs:
    """A table function: runs of equal values of an array, as (start, copies, value)."""

    def eval(self, values: list[int]):
        start = 0
        for k in range(1, len(values or []) + 1):
            if k == len(values) or values[k] != values[start]:
                yield start, k - start, values[start]
                start = k


def register_table_function(spark: SparkSession, name: str, function: type, returns: str) -> None:
    """Makes a class with eval() (rows from arguments) a table function of spark.sql() and of the language's sources."""
    spark.udtf.register(name, F.udtf(function, returnType=returns))


def register_function(name: str, function: Callable) -> None:
    """Adds a function from columns to a column; scalar_function() finds it by name. Names of this package stay as they are."""
    if name in OWN or callable(getattr(scalar, name, None)):
        raise KeyError(f"{name} is taken")
    OWN[name] = function


def register(spark: SparkSession) -> None:
    """Makes the table functions available to spark.sql()."""
    spark.udtf.register("runs", F.udtf(Runs, returnType="start int, copies int, value bigint"))


def scalar_function(name: str) -> Callable:
    """A column function of this package by name."""
    found = OWN.get(name) or getattr(scalar, name, None)
    if not callable(found) or name.startswith("_"):
        raise KeyError(name)
    return found
