"""Reachability by frontier expansion.

Each hop joins the frontier with the edges, drops what is visited, and keeps distinct nodes; hops are
written to the checkpoint folder, so lineage stays short and lost executors cost one hop.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark) -> str:
    """The checkpoint folder, which all executors see; one of our own in local mode only, where none is named."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-graph-"))
    return context._jsc.sc().getCheckpointDir().get()


def edges_of(nodes: DataFrame, node: str, neighbours: str) -> DataFrame:
    """Adjacency lists as edges (src, dst)."""
    return nodes.select(F.col(node).alias("src"), F.explode(neighbours).alias("dst"))


def reachable(edges: DataFrame, sources: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(node, hop): every node that can be reached from the sources (column node) and the least number of hops."""
    edges = edges.select("src", "dst").distinct()
    frontier = settled(sources.select("node").distinct().withColumn("hop", F.lit(0)))
    parts, visited, hop = [frontier], frontier, 0
    while most_hops is None or hop < most_hops:
        hop += 1
        found = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = settled(found.join(visited, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        visited = visited.unionByName(frontier)
        if len(parts) % 8 == 0:
            visited = settled(visited)
    return visited


def hop_counts(edges: DataFrame, sources: DataFrame, most_hops: int | None = None) -> DataFrame:
    """How many nodes each hop found."""
    return reachable(edges, sources, most_hops).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def partitioned_traversal(edges: DataFrame, sources: DataFrame, partitions: int, most_hops: int | None = None) -> DataFrame:
    """Counts of each hop and partition of a traversal whose nodes are dealt to partitions by number.

    (hop, partition, visited, local, sent): nodes first seen in this hop, and their edges to nodes of their own partition and
    of others. Edges are dealt by their source once, so a hop moves the frontier alone.
    """
    part = lambda node: F.pmod(F.col(node), F.lit(partitions)).cast("int")
    visited = reachable(edges, sources, most_hops)
    out = edges.distinct().groupBy("src").agg(F.count_if(part("dst") == part("src")).alias("local"), F.count_if(part("dst") != part("src")).alias("sent"))
    met = visited.join(out, F.col("node") == F.col("src"), "left")
    return met.groupBy("hop", part("node").alias("partition")).agg(F.count(F.lit(1)).alias("visited"), F.coalesce(F.sum("local"), F.lit(0)).alias("local"), F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"))


def reference_edges(objects: DataFrame, key: str, references: list[str]) -> DataFrame:
    """Edges (src, dst) of objects that name others in some of their columns, single keys or lists of them; nulls name none."""
    one = lambda c: F.col(c) if objects.schema[c].dataType.typeName() == "array" else F.array(c)
    return reduce(DataFrame.unionAll, [objects.select(F.col(key).alias("src"), F.explode(one(c)).alias("dst")) for c in references]).where("dst is not null")


def persisted(objects: DataFrame, key: str, references: list[str], roots: DataFrame) -> DataFrame:
    """The objects that the roots (column node) reach by references, themselves included."""
    found = reachable(reference_edges(objects, key, references), roots)
    return objects.join(found, F.col(key) == F.col("node"), "left_semi")


def traversal_counters(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Of a finished traversal: nodes visited, edges followed, and edges that led to a node seen already."""
    followed = edges.join(visited, edges["src"] == visited["node"], "left_semi").agg(F.count(F.lit(1)).alias("followed"))
    return visited.agg(F.count(F.lit(1)).alias("visited")).crossJoin(followed).withColumn("skipped", F.col("followed") - F.col("visited") + 1)


def ring_graph(spark, nodes: int, outdegree: int, seed: int = 0) -> DataFrame:
    """(id, neighbors): neighbour 0 is the next node around the ring, the others are random."""
    rest = [draw(F.col("id"), seed + k, nodes) for k in range(outdegree - 1)]
    return spark.range(nodes).select("id", F.array((F.col("id") + 1) % nodes, *rest).alias("neighbors"))


def random_graph(spark, nodes: int, outdegree: int, seed: int = 0) -> DataFrame:
    """All neighbours are random; a node's own come from its number and the seed."""
    return spark.range(nodes).select("id", F.array(*[draw(F.col("id"), seed + k, nodes) for k in range(outdegree)]).alias("neighbors"))


def draw(item, seed: int, n: int):
    """A number below n that follows from the item and the seed alone, so that any task can draw it again."""
    return F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(n))


def hot_set_graph(spark, nodes: int, outdegree: int, hot: int, chance: float, seed: int = 0) -> DataFrame:
    """Neighbours fall into the first ``hot`` nodes with the given chance."""
    share = round(chance * (1 << 30))
    pick = lambda k: F.when(draw(F.col("id"), seed + 2 * k, 1 << 30) < share, draw(F.col("id"), seed + 2 * k + 1, hot)).otherwise(hot + draw(F.col("id"), seed + 2 * k + 1, nodes - hot))
    return spark.range(nodes).select("id", F.array(*[pick(k) for k in range(outdegree)]).alias("neighbors"))
