"""Keyed tables: lookups, ordered lookups, and changes by key, each a plan over whole DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with exactly this key (a prefix is no match)."""
    return df.filter(F.col(key) == F.lit(value))


def at_position(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.filter(F.col(position) == n)


def matching(df: DataFrame, **values) -> DataFrame:
    """Rows equal in all given columns."""
    return df.filter(reduce(and_, [F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True)))


#: A comparator is a function from a key to what it sorts by, in Spark's own functions; several parts make a struct.
Comparator = Callable[[Column], Column]


def plainly(key: Column) -> Column:
    return key


def ordered_lookup(df: DataFrame, key: str, mode: str, value=None, compare: Comparator = plainly) -> DataFrame:
    """At most one row by its place in key order.

    Modes: equal, gteq, lteq, greater, less (nearest to ``value``; next and prev are other names of the
    last two), first, last. One aggregation with partial minima; nothing is sorted. ``compare`` sets the order.
    """
    k, value = compare(F.col(key)), compare(F.lit(value))
    tests = {"equal": lambda: k == value, "gteq": lambda: k >= value, "lteq": lambda: k <= value, "greater": lambda: k > value, "less": lambda: k < value, "first": lambda: F.lit(True), "last": lambda: F.lit(True)}
    mode = {"next": "greater", "prev": "less"}.get(mode, mode)
    if mode not in tests:
        raise ValueError(f"no mode {mode}")
    best = F.max_by if mode in ("lteq", "less", "last") else F.min_by
    row = F.struct(*df.columns)
    return df.filter(tests[mode]()).agg(best(row, k).alias("_row")).where("_row is not null").select("_row.*")


def neighbours(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """df with the value before and after each row in its group."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"prev_" + value: F.lag(value).over(w), "next_" + value: F.lead(value).over(w)})


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """left and the value of right's nearest row at or before (forward: after) ``on`` in the same group.

    One shuffle of the union on the group; a running last value finds the match.
    """
    sides = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    other = right.select(*by, on, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    order = [F.desc(on), "_side"] if forward else [F.asc(on), "_side"]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = sides.unionByName(other, allowMissingColumns=True)
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, out)


def page_in_order(df: DataFrame, order: Sequence[str], after: Sequence | None = None, rows: int = 100) -> DataFrame:
    """The next ``rows`` rows in order of these columns behind the given place (its values; none: from the start).

    Only rows of the page leave a task; to go on, give the last row's values. Null values come first.
    """
    if after is not None:
        past = F.lit(False)
        for c, v in reversed(list(zip(order, after, strict=True))):
            at = F.lit(v).cast(df.schema[c].dataType)
            past = (F.col(c) > at if v is not None else F.col(c).isNotNull()) | F.col(c).eqNullSafe(at) & past
        df = df.filter(past)
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(rows)


def in_order(df: DataFrame, order: Sequence[str], compare: Comparator = plainly) -> DataFrame:
    """All rows in order: dealt out by ranges of the columns and sorted in each."""
    return df.orderBy(*[compare(F.col(c)).asc_nulls_first() for c in order])


def sorted_keys(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys in order."""
    return df.select(key).distinct().orderBy(key)


def tail_columns(df: DataFrame, start: int) -> DataFrame:
    """The columns from a position on."""
    return df.select(*df.columns[start:])


def positional_length(table: DataFrame, position: str) -> DataFrame:
    """The length of a positional table: one more than its last position."""
    return table.agg(F.coalesce(F.max(position) + 1, F.lit(0)).cast("long").alias("length"))


def truncated(table: DataFrame, position: str, length: int) -> DataFrame:
    """A positional table cut to a length."""
    return table.filter(F.col(position) < length)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows told in the program as a table; they become part of the plan."""
    return spark.createDataFrame(list(rows), schema)


def prefix_scan(df: DataFrame, key: str, prefix: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key starts with the prefix and that pass the predicate; ``limit`` stops early."""
    found = df.filter(F.col(key).startswith(prefix))
    found = found if where is None else found.filter(where)
    return found if limit is None else found.limit(limit)


def one_per_key(rows: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """One row of each key: the one with the largest ``newest``, or else the largest in all columns."""
    by = dict.fromkeys([*([newest] if newest else []), *[c for c in rows.columns if c != key], key])
    return rows.groupBy(key).agg(F.max(F.struct(*by)).alias("_row")).select("_row.*").select(*rows.columns)


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; null is a key like any other."""
    told = keys.select(F.col(key).alias("_key"))
    return table.join(told, F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those with their key and are added otherwise; of several with a key one is taken, see one_per_key().

    Null is a key like any other.
    """
    rows = one_per_key(changes, key, newest).select(*table.columns)
    return without_keys(table, rows, key).unionByName(rows)


def upsert_told(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes with ``replaced``: whether the key was there."""
    there = table.select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    return changes.join(there, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("replaced", F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def insert_absent(table: DataFrame, rows: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Adds rows whose key is not there yet; of several with a key one, as for upsert()."""
    return table.unionByName(without_keys(one_per_key(rows, key, newest), table, key).select(*table.columns))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return without_keys(table, keys, key)


def remove_first(table: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with each of these keys, the first in order goes; copies of the key after it stay."""
    firsts = table.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(order).alias("_first")).withColumnRenamed(key, "_key")
    return table.join(firsts, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_first")), "left_anti")


def delete_matching(table: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Deletes a key only where its value is the one told."""
    told = rows.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    return table.join(told, (F.col(key) == F.col("_key")) & (F.col(value) == F.col("_value")), "left_anti")


def move_keys(source: DataFrame, target: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after the rows with these keys went from one to the other."""
    return delete_keys(source, keys, key), target.unionByName(source.join(keys.select(key).distinct(), key, "left_semi").select(*target.columns))


def overwrite_range(df: DataFrame, column: str, offset: int, data: Column, length: int) -> DataFrame:
    """Bytes or characters from ``offset`` (from 0) replaced."""
    return df.withColumn(column, F.overlay(column, data, F.lit(offset + 1), F.lit(length)))


def counters(table: DataFrame, steps: DataFrame, key: str, value: str, step: str) -> DataFrame:
    """Adds each key's sum of steps (+1, -1, ...) to its value."""
    sums = steps.groupBy(F.col(key).alias("_key")).agg(F.sum(step).alias("_sum"))
    return table.join(sums, F.col(key) == F.col("_key"), "left").withColumn(value, F.col(value) + F.coalesce("_sum", F.lit(0))).select(*table.columns)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def children_of(entries: DataFrame, path: str, key: str, children: str) -> DataFrame:
    """A path's entry lists its children's keys; their own entries, in one join."""
    listed = entries.filter(F.col(key) == path).select(F.explode(children).alias("_child"))
    return entries.join(listed, F.col(key) == F.col("_child"), "left_semi")


def appended(table: DataFrame, position: str, value: Column, count: int) -> DataFrame:
    """A positional table extended by so many rows of one value; positions go on from the last."""
    last = table.agg(F.coalesce(F.max(position), F.lit(-1)).alias("_last"))
    more = table.sparkSession.range(count).crossJoin(F.broadcast(last))  # one row
    return table.unionByName(more.select((F.col("_last") + 1 + F.col("id")).alias(position), value.alias(next(c for c in table.columns if c != position))))


def for_each_matching(df: DataFrame, key: str, prefix: str, where: Column | None, apply) -> None:
    """Runs a function on the executors for every row with the prefix that passes the predicate."""
    prefix_scan(df, key, prefix, where).foreach(apply)
