"""Visible forms of column encodings, and interval coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import floor_div, rounded_down, rounded_up
from .ordering import running_sum


def run_lengths(df: DataFrame, by: Sequence[str], order: str, value: str, longest: int | None = None) -> DataFrame:
    """Runs of equal values along the order of each group: by, run (from 0), start, copies, value.

    ``longest`` cuts runs, as a counter of bounded size does. Groups are pages, which bound a task's rows.
    """
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(F.struct(value)).over(w) == F.struct(value), 0).otherwise(1)
    runs = df.select(*by, order, F.col(value).alias("value"), new.alias("_new"), (F.row_number().over(w) - 1).alias("_at"))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    if longest:
        within = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order)) - 1
        runs = runs.withColumn("_part", floor_div(within, longest))
    else:
        runs = runs.withColumn("_part", F.lit(0))
    out = runs.groupBy(*by, "_run", "_part").agg(F.min("_at").alias("start"), F.count(F.lit(1)).alias("copies"), F.first("value").alias("value"))
    return out.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("start")) - 1).alias("run"), "start", "copies", "value")


def expanded_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The inverse: by, position, value."""
    return runs.select(*by, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1)).alias("position"), "value")


def read_slot(runs: DataFrame, slot: int) -> DataFrame:
    """The value at a position of each page, found in its runs without expanding them."""
    return runs.where(F.lit(slot).between(F.col("start"), F.col("start") + F.col("copies") - 1)).drop("run", "start", "copies").withColumn("slot", F.lit(slot))


def frame_of_reference(df: DataFrame, by: Sequence[str], order: str, value: str, largest: int) -> DataFrame:
    """df with base (the page's first value), delta, and whether the delta is an exception (negative or too large)."""
    base = F.first(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    delta = F.col(value) - F.col("base")
    out = df.withColumn("base", base).withColumn("exception", ~delta.between(0, largest))
    return out.withColumn("delta", F.when(~F.col("exception"), delta))


def pages(df: DataFrame, order: str, rows: int) -> DataFrame:
    """df with ``page``: so many consecutive values of a dense order column each."""
    return df.withColumn("page", floor_div(F.col(order), rows))


def coverage(intervals: DataFrame, start: str = "start", stop: str = "stop", weight: str | None = None, quantum: int = 1) -> DataFrame:
    """Where the number of covering intervals [start, stop) changes: position, delta, pins (those before it).

    Ends are rounded outwards to the quantum; ``weight`` -1 takes an interval back. Changes that
    cancel out are no transitions. The running sum works range by range (see ordering.py).
    """
    w = F.col(weight) if weight else F.lit(1)
    ends = F.array(F.struct(rounded_down(F.col(start), quantum).alias("position"), w.alias("delta")), F.struct(rounded_up(F.col(stop), quantum).alias("position"), (-w).alias("delta")))
    changes = intervals.select(F.inline(ends)).groupBy("position").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    return running_sum(changes, "position", "delta", "_after").select("position", "delta", (F.col("_after") - F.col("delta")).alias("pins"))


def covered_length(transitions: DataFrame) -> DataFrame:
    """Total length of positions with at least one pin."""
    from .ordering import shifted

    spans = shifted(transitions, "position", "position", "_next")
    return spans.where(F.col("pins") + F.col("delta") > 0).agg(F.coalesce(F.sum(F.col("_next") - F.col("position")), F.lit(0)).alias("covered"))
