"""Connected components of a large sparse graph by alternating stars.

Edges point from the larger node to the smaller. A round hooks each node's larger neighbours to the least of all its
neighbours and itself (large star), then each node and its smaller neighbours to the least of these (small star), so edges contract
towards roots and chains fold up in a number of rounds that grows as the logarithm of their length; the edges never become more. The end is
a star for each component. Minima are aggregated before the shuffle, so a hub costs one row a task, and where a hub's edges meet its
minimum, Spark can split them; edges stay in tables, and only a digest of them comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settled


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of ``edges`` with the least node that it reaches.

    Edges may repeat, point either way or loop; rows with a null end are no edges. Nodes without an
    edge are absent. No edges give no rows.
    """
    told = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    stars = settled(told.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = digest(stars)
    while seen[0]:
        stars = settled(small_stars(large_stars(stars)))
        now = digest(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def large_stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, with the least of its neighbours and itself."""
    both = edges.unionAll(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_stars(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours, all smaller, with the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
