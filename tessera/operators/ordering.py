"""Work along one global order without one global task.

Positions are cut into ranges at approximate quantiles; a range is a function of the position alone.
Running sums are taken within ranges by a window and shifted by the ranges' totals, of which there are
``ranges`` at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .graph import settled

RANGES = 200


def ranged(df: DataFrame, position: str, ranges: int = RANGES) -> DataFrame:
    """df, written to the checkpoint folder so that it is computed once, with ``_range``: the number of the range that a numeric position is in."""
    df = settled(df)
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(position, shares, 10_000)).first()[0] if shares else None
    cuts = sorted(set(found or []))
    # The number of cuts before the position, by bisection of the constant list.
    out, step = df.withColumn("_range", F.lit(0)), 1 << max(0, len(cuts).bit_length() - 1)
    while cuts and step:
        ahead = F.col("_range") + step
        out = out.withColumn("_range", F.when((ahead <= len(cuts)) & (F.get(F.lit(cuts), ahead - 1) < F.col(position)), ahead).otherwise(F.col("_range")))
        step >>= 1
    return out


def running_sum(df: DataFrame, position: str, value: str, out: str, ranges: int = RANGES) -> DataFrame:
    """df and the sum of ``value`` over all rows at or before each row's position (positions must be distinct)."""
    dealt = ranged(df, position, ranges)
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(position))
    joined = dealt.withColumn("_within", within).join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return joined.withColumn(out, F.col("_within") + F.col("_before")).select(*df.columns, out)


def shifted(df: DataFrame, position: str, value: str, out: str, by: int = 1, ranges: int = RANGES) -> DataFrame:
    """df and the value of the row next in order (``by`` 1) or before (-1); null at the end."""
    dealt = ranged(df, position, ranges)
    edge = (F.min_by if by > 0 else F.max_by)(value, position)
    edges = dealt.groupBy("_range").agg(edge.alias("_edge"))
    over_ranges = Window.orderBy("_range")
    near = edges.select(F.col("_range").alias("_of"), (F.lead("_edge") if by > 0 else F.lag("_edge")).over(over_ranges).alias("_near"))
    within = Window.partitionBy("_range").orderBy(position)
    own = (F.lead(F.struct(value)) if by > 0 else F.lag(F.struct(value))).over(within)
    joined = dealt.withColumn("_own", own).join(F.broadcast(near), F.col("_range") == F.col("_of"))
    return joined.withColumn(out, F.when(F.col("_own").isNotNull(), F.col(f"_own.{value}")).otherwise(F.col("_near"))).select(*df.columns, out)
