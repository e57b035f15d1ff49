"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a ring, which cut it into arcs. A key falls into an arc by
its hash and belongs to the shard that owns the arc's end. A shard takes no more than its bound; keys
over it go on clockwise to the next point whose shard has room. With ``load_factor`` 1 the bounds are
the floor or ceiling of rows / shards, so row counts differ by one at most.

How it is distributed: keys of an arc are alike as far as the ring is concerned, so the walk needs
counts only. The driver gets one count per arc (shards * virtual_nodes rows, whatever the input) and
returns runs "ranks lo..hi of arc a go to shard s". Ranks within an arc come from counts of small
hash buckets (prefix sums) plus a row number in each bucket, so no task holds an arc.

Results for odd input: a null text has size 1 and the CRC of no bytes; null ids are hashed as such;
rows that are alike are counted together per input partition and expanded at the end, so that a row
repeated any number of times neither meets in one task nor gets lost. An empty table gives no rows.
Ties between rows are broken by (ring hash, id, size, CRC), so shards and slots depend on the rows alone, whatever
the input's partitions. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settled, utf8

#: Ring points per shard.
VIRTUAL_NODES = 64
#: Rows of a rank bucket, about.
BUCKET_ROWS = 256
#: Buckets of an arc at least, so that small inputs are spread as well.
LEAST_BUCKETS = 4
RING = 1 << 32


def _word(hex_digest: Column, start: int) -> Column:
    """Eight hex digits as a number in [0, 2^32)."""
    return F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("long")


def ring_points(spark, shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) around the ring; a function of the two numbers alone."""
    points = spark.range(shards * virtual_nodes).select(
        _word(F.md5(F.concat(F.lit("node "), (F.col("id") % shards).cast("string"), F.lit(" "), F.floor(F.col("id") / shards).cast("string"))), 1).alias("at"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )
    return sorted((r["at"], r["shard"]) for r in points.collect())


def walk(owners: list[int], counts: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where each arc's keys go: (arc, first rank, last rank + 1, shard, first slot there).

    All arcs move together, one ring point a round: what an arc still holds is offered to the owner of
    the point reached, which takes as much as it has room for.
    """
    points, room, filled = len(owners), list(bounds), [0] * len(bounds)
    taken = [0] * points
    runs = []
    step = 0
    while step < points and any(taken[a] < counts[a] for a in range(points)):
        for arc in range(points):
            left = counts[arc] - taken[arc]
            shard = owners[(arc + step) % points]
            n = min(left, room[shard])
            if n:
                runs.append((arc, taken[arc], taken[arc] + n, shard, filled[shard]))
                taken[arc] += n
                room[shard] -= n
                filled[shard] += n
        step += 1
    if any(taken[a] < counts[a] for a in range(points)):
        raise ValueError("the shards' bounds hold fewer rows than there are")
    return runs


def bounded_shards(keys: DataFrame, key: str, carried: list[str], shards: int, virtual_nodes: int = VIRTUAL_NODES, load_factor: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``keys``: key, the carried columns, ``shard`` and a gapless ``slot`` in it.

    ``carried`` should be narrow (ids, sizes, digests): it is what gets shuffled.
    """
    spark = keys.sparkSession
    points = ring_points(spark, shards, virtual_nodes)
    owners = [s for _, s in points]
    digest = F.md5(F.concat(F.lit("key "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # Rows that are alike are interchangeable: one row and a count stands for those of an input partition.
    alike = keys.groupBy(key, *carried, F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_copies"))
    ends = F.lit([at for at, _ in points])
    position = _word(digest, 1)
    # The number of points before the position, found by bisection of the constant list of points.
    arc, half = F.lit(0), 1 << max(0, (len(points) - 1).bit_length())
    placed = alike.withColumn("_at", position).withColumn("_arc", arc)
    while half:
        ahead = F.col("_arc") + half
        placed = placed.withColumn("_arc", F.when((ahead <= len(points)) & (F.get(ends, ahead - 1) < F.col("_at")), ahead).otherwise(F.col("_arc")))
        half >>= 1
    placed = settled(placed.withColumn("_arc", F.col("_arc") % len(points)).withColumn("_order", F.xxhash64("_at", key, *carried)))
    counts = [0] * len(points)
    for r in placed.groupBy("_arc").agg(F.sum("_copies").alias("n")).collect():  # as many rows as ring points
        counts[r["_arc"]] = r["n"]
    rows = sum(counts)
    if load_factor == 1:
        bounds = [rows // shards + (s < rows % shards) for s in range(shards)]
    else:
        bounds = [math.ceil(rows * load_factor / shards)] * shards
    runs = walk(owners, counts, bounds) or [(0, 0, 0, 0, 0)]
    per_arc = max(LEAST_BUCKETS, math.ceil(rows / len(points) / bucket_rows))
    placed = placed.withColumn("_bucket", F.pmod(F.col("_order"), F.lit(per_arc)))
    in_bucket = Window.partitionBy("_arc", "_bucket").orderBy("_order", key, *carried, "_part")
    before = Window.partitionBy("_arc").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_arc", "_bucket").agg(F.sum("_copies").alias("_n")).select("_arc", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_within", F.sum("_copies").over(in_bucket) - F.col("_copies")).join(starts, ["_arc", "_bucket"])
    rank = F.col("_start") + F.col("_within") + F.col("_copy")
    # The runs: at most (ring points + shards * rounds) rows, set by the parameters and not by the input.
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}, {lo}L, {hi}L, {s}, {base}L)" for a, lo, hi, s, base in runs) + " AS t(_arc, _lo, _hi, shard, _base)")
    return (
        ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .withColumn("_rank", rank)
        .join(F.broadcast(table).withColumnRenamed("_arc", "_of"), (F.col("_arc") == F.col("_of")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .select(key, *carried, "shard", (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, under the law "rows"."""
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(utf8("text"), F.lit(b""))).alias("text_crc32"),
    )
    return bounded_shards(keys, "doc_id", ["size", "text_crc32"], shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
