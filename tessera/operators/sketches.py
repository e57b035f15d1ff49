"""Minima under retraction, Bloom filters, and log-scale histograms."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalar import floor_div, log2_floor

NO_MIN = (1 << 63) - 1


def net_counts(changes: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Values that are left of a stream of +1 and -1, with how often."""
    return changes.groupBy(*by, value).agg(F.sum(weight).alias("n")).where("n > 0")


def retractable_min(changes: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Each group's least value after all changes; null where none is left."""
    net = changes.groupBy(*by, value).agg(F.sum(weight).alias("_n"))
    return net.groupBy(*by).agg(F.min(F.when(F.col("_n") > 0, F.col(value))).alias("min"))


def multiset_min(changes: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """The same with the largest long where none is left."""
    return retractable_min(changes, by, value, weight).withColumn("min", F.coalesce(F.col("min").cast("long"), F.lit(NO_MIN)))


def running_min(changes: DataFrame, by: Sequence[str], order: str, value: str, weight: str) -> DataFrame:
    """changes with the least value after each of them (and after all others of the same place in the order).

    One scan of each group in order, with a heap of the values seen and their net counts; equal changes stay apart. A group
    must fit a task's memory, so groups should be bounded (pages, keys).
    """
    schema = StructType([*changes.schema, StructField("min", changes.schema[value].dataType)])

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        places, values, weights = (group.column(c).to_pylist() for c in (order, value, weight))
        net: dict = {}
        heap, out, at = [], [], 0
        while at < len(places):
            end = at
            while end < len(places) and places[end] == places[at]:
                v = values[end]
                if v is not None:
                    was = net.get(v, 0)
                    net[v] = was + weights[end]
                    if was <= 0 < net[v]:  # a value is pushed each time that it appears
                        heapq.heappush(heap, v)
                end += 1
            while heap and net[heap[0]] <= 0:
                heapq.heappop(heap)
            out += [heap[0] if heap else None] * (end - at)
            at = end
        return group.append_column("min", pa.array(out, group.schema.field(value).type))

    return changes.groupBy(*by).applyInArrow(scan, schema)


#: Items are hashed twice; the k-th position is the first hash and k times the second. Other pairs may be given.
Hashes = Callable[[Column], tuple[Column, Column]]


def by_xxhash(item: Column) -> tuple[Column, Column]:
    return F.xxhash64(item), F.xxhash64(item, F.lit(1))


def by_md5(item: Column) -> tuple[Column, Column]:
    """Slower, and the same in any engine."""
    digest = F.md5(item.cast("string").cast("binary"))
    return tuple(F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9))


def bloom_size(items: int, false_positives: float) -> tuple[int, int]:
    """Bits and hashes for so many items (fixed value: the logarithm's argument)."""
    bits = math.ceil(items * math.log(false_positives) / math.log(0.6185))
    return bits, max(1, math.floor(math.log(2) * bits / items))


def bloom_pair(item: Column, bits: int, pair: Hashes = by_xxhash) -> dict[str, Column]:
    """What an item's positions follow from: both hashes modulo the bits."""
    return {name: F.pmod(h, F.lit(bits)) for name, h in zip(("_a", "_b"), pair(item), strict=True)}


def bloom_places(pairs: DataFrame, bits: int, hashes: int) -> DataFrame:
    """pairs with ``_p``, a row a bit position by double hashing; items are not hashed anew for each of them."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("_k")
    return pairs.select("*", numbers).withColumn("_p", F.pmod(F.col("_a") + F.col("_k") * F.col("_b"), F.lit(bits))).drop("_k")


def bloom_filter(df: DataFrame, item: str, bits: int, hashes: int, pair: Hashes = by_xxhash) -> DataFrame:
    """(word, mask): the filter as words of 32 bits; bits / 32 rows at most, merged before the shuffle."""
    set_bits = bloom_places(df.select(*(h.alias(name) for name, h in bloom_pair(F.col(item), bits, pair).items())), bits, hashes)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_p", F.lit(32)).cast("int"))
    return set_bits.select(floor_div(F.col("_p"), 32).alias("word"), bit.alias("_bit")).groupBy("word").agg(F.bit_or("_bit").alias("mask"))


def bloom_stats(bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """bits, hashes, how many bits are set, and the share of false positives to expect from that."""
    filled = bloom.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).cast("long").alias("bits_set"))
    return filled.select(F.lit(bits).cast("long").alias("bits"), F.lit(hashes).alias("hashes"), "bits_set", F.pow(F.col("bits_set") / bits, F.lit(hashes)).alias("false_positives"))


def bloom_maybe(df: DataFrame, item: str, bloom: DataFrame, bits: int, hashes: int, pair: Hashes = by_xxhash, most_bytes: int = 64 << 20) -> DataFrame:
    """df with ``maybe``: false where the item was surely not inserted; null items were not.

    The filter stays a table. Distinct pairs of hashes are looked up, a row a bit position, and only pairs with a bit that is
    not set go on to df; no row carries more than a word of the filter, so work grows with df and the filter, not with their
    product. A filter of up to ``most_bytes`` in a hash table (96 bytes a word at most) is sent to all tasks, a larger one is
    met in a shuffle.
    """
    words = bits // 32 + 1
    told = df.withColumns({name: F.coalesce(h, F.lit(-1)) for name, h in bloom_pair(F.col(item), bits, pair).items()})  # never null, so no join tests it for null by hashing twice
    hashed = F.col(item).isNotNull() & (F.col("_a") >= 0) & (F.col("_b") >= 0)
    places = bloom_places(told.select("_a", "_b").distinct(), bits, hashes)
    is_set = (floor_div(F.col("_p"), 32) == F.col("word")) & (F.getbit("mask", F.pmod("_p", F.lit(32)).cast("int")) == 1)
    unset = places.join(F.broadcast(bloom) if 96 * words <= most_bytes else bloom, is_set, "left_anti")
    missed = unset.select(F.col("_a").alias("_missed_a"), F.col("_b").alias("_missed_b")).distinct()
    met = told.join(missed, (F.col("_a") == F.col("_missed_a")) & (F.col("_b") == F.col("_missed_b")), "left")
    return met.select(*df.columns, (hashed & F.col("_missed_a").isNull()).alias("maybe"))


def log2_histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, bucket, n): rows by the highest bit of their value."""
    return df.groupBy(*by, log2_floor(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(histogram: DataFrame, percent: int, by: Sequence[str] = ()) -> DataFrame:
    """The first bucket that reaches percent of the total (in whole numbers), and its lower bound in millionths."""
    w = Window.partitionBy(*by)  # 64 buckets a group at most
    run = histogram.select(*by, "bucket", F.sum("n").over(w.orderBy("bucket")).alias("_run"), F.sum("n").over(w).alias("_all"))
    reached = run.where(F.col("_run") >= floor_div(F.col("_all") * percent, 100)).groupBy(*by).agg(F.min("bucket").alias("bucket"))
    return reached.withColumn("value", F.pow(F.lit(2.0), F.col("bucket")) / 1e6)


def histogram_distance(a: DataFrame, b: DataFrame, logarithmic: bool = False) -> DataFrame:
    """Earth mover's distance of two histograms (bucket, n); ``logarithmic`` compares the counts' highest bits.

    Otherwise a's counts are scaled by b's mass, so the distance is symmetric where masses are equal.
    """
    both = a.select("bucket", F.col("n").alias("_a")).join(b.select("bucket", F.col("n").alias("_b")), "bucket", "full").select("bucket", F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    if logarithmic:
        differ = both.withColumn("_d", log2_floor(F.col("_a")) - log2_floor(F.col("_b")))
    else:
        differ = both.withColumn("_d", F.sum("_b").over(Window.partitionBy()) * F.col("_a") - F.col("_b"))
    moved = differ.withColumn("_moved", F.sum("_d").over(Window.partitionBy().orderBy("bucket")))
    return moved.agg(F.coalesce(F.sum(F.abs("_moved")), F.lit(0)).alias("distance"))
