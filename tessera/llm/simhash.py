"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: A-Z lowered, words at ASCII white space, 3-word shingles with repeats joined by a space
(all words if there are fewer than three), XXH64 with seed 42; a bit is 1 if it is set in over half the
hashes. No words give fingerprint zero.

Candidates: 64 bits are cut into ``blocks`` parts, of which a pair at 3 bits or fewer agrees in all but
three, so sharing one of the C(blocks, blocks - 3) combinations of parts is necessary. More blocks give
longer keys; the number is chosen by the count of fingerprints so that buckets stay small. No pair is
lost at any choice. Each distinct fingerprint takes part once, whatever the number of its documents.

Comparison: a task holds its buckets' fingerprints sorted by bucket, as 64 vertical bit planes. All
rows are compared with the row ``d`` places on at once, for d = 1, 2, ...: each plane is xored with
itself moved by d, and the differences go through carry-save counters (ones, twos, and an overflow that
stays set). Words of 64 rows that are all over the radius, or past their bucket's end, are abandoned
between groups of planes, and words without rows in a bucket longer than d drop out for good. A bucket beyond
``SPLIT`` rows is cut further by the same principle, in the task, before comparison.

What leaves a task is a star for each group it found, not its pairs; components join the stars.

Results for odd input: a null text has no words; rows that repeat have one fingerprint; null ids have a
component of their own fingerprint's group and are no candidate for its smallest id (null if all are); an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import field, row_of, settled
from .components import connected_components
from .packed import group_starts

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Keys get about this many rows each, for evenly spread fingerprints.
KEY_ROWS = 8
#: Rows of a bucket that are compared directly; larger ones are cut further.
SPLIT = 2048
#: Rows a comparing task takes, about.
TASK_ROWS = 1 << 17
#: Planes between two checks for words to abandon.
STEP = 8
U64 = np.uint64


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_digest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(line)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, *carried: Column) -> DataFrame:
    """(doc_id, fp) and the carried columns: fp is the fingerprint as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = b"".join(fingerprint(t.as_py() or b"") for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fp, ">i8").astype(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    extra = docs.select(*carried)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carried)
    return rows.mapInArrow(of, StructType([*StructType.fromDDL("doc_id long, fp long"), *extra.schema]))


def key_masks(n: int) -> list[int]:
    """Masks of which one at least is agreed on by any pair within the radius."""
    blocks = RADIUS + 1
    while blocks < 16 and n > KEY_ROWS << 64 * (blocks - RADIUS) // blocks:
        blocks += 1
    return masks_of(list(range(64)), blocks)


def masks_of(bits: list[int], blocks: int) -> list[int]:
    parts = [sum(1 << b for b in bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks]) for k in range(blocks)]
    return [sum(kept) for kept in itertools.combinations(parts, blocks - RADIUS)]


def planes(rows: np.ndarray) -> np.ndarray:
    """Bit b of all rows as row b of words of 64 rows each; the first row is the lowest bit."""
    n = -(-len(rows) // 64) * 64
    padded = np.zeros(n, U64)
    padded[: len(rows)] = rows
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U64)


def moved(words: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """The words ``at`` of a bit string moved down by so many bits; words past the end are 0."""
    jump, bits = divmod(by, 64)
    low = words[at + jump]
    return low if not bits else low >> U64(bits) | words[at + jump + 1] << U64(64 - bits)


def close_pairs(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within the radius and the same bucket; rows must be sorted by bucket."""
    n = len(rows)
    starts = group_starts(bucket)
    sizes = np.diff(np.append(starts, n))
    ahead = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows after this one in its bucket
    longest = int(ahead.max(initial=0))
    if not longest:
        return
    pad = longest // 64 + 2
    sliced = np.concatenate([planes(rows), np.zeros((64, pad), U64)], axis=1)
    reach = np.zeros(-(-n // 64) * 64, np.int64)
    reach[:n] = ahead
    last = reach.reshape(-1, 64).max(axis=1)
    active = np.flatnonzero(last > 0)
    for d in range(1, longest + 1):
        active = active[last[active] >= d]
        inside = np.packbits((reach.reshape(-1, 64)[active] >= d).astype(np.uint8), axis=1, bitorder="little").view(U64)[:, 0]
        at, over = active, ~inside
        ones = twos = np.zeros(len(at), U64)
        for k in range(64):
            plane = sliced[k]
            differs = plane[at] ^ moved(plane, at, d)
            carry = ones & differs
            ones = ones ^ differs
            over = over | twos & carry
            twos = twos ^ carry
            if k % STEP == STEP - 1:
                left = over != ~U64(0)
                if not left.all():
                    at, over, ones, twos = at[left], over[left], ones[left], twos[left]
                    if not len(at):
                        break
        if len(at):
            close = np.unpackbits((~over)[:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
            word, bit = np.nonzero(close)
            first = at[word] * 64 + bit
            yield first, first + d


class Forest:
    """Union-find over positions; a root is its group's smallest position."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs: each round points the larger root of every pair still apart at a smaller one."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            z = self.up[y]
            if np.array_equal(y, z):
                return y
            self.up[x] = z
            x = z


def bucket_links(rows: np.ndarray, bucket: np.ndarray, forest: Forest, where: np.ndarray, free: int) -> None:
    """Joins all pairs of rows within the radius that share a bucket. ``where``: their positions in the forest; ``free``: mask of the bits not fixed by the bucket."""
    order = np.lexsort((rows, bucket))
    rows, bucket, where = rows[order], bucket[order], where[order]
    starts = group_starts(bucket)
    sizes = np.diff(np.append(starts, len(rows)))
    large = np.repeat(sizes > SPLIT, sizes)
    bits = [b for b in range(64) if free >> b & 1]
    if large.any() and len(bits) > 2 * (RADIUS + 1):
        part, ids = rows[large], np.unique(bucket[large], return_inverse=True)[1].astype(U64)
        for mask in masks_of(bits, RADIUS + 1):
            keys = part & U64(mask)
            finer = np.lexsort((keys, ids))
            number = np.zeros(len(part), U64)
            first = group_starts(ids[finer], keys[finer])
            number[finer] = np.repeat(np.arange(len(first), dtype=U64), np.diff(np.append(first, len(part))))
            bucket_links(part, number, forest, where[large], free & ~mask)
        rows, bucket, where = rows[~large], bucket[~large], where[~large]
    for a, b in close_pairs(rows, bucket):
        forest.join(where[a], where[b])


def close_stars(distinct: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (column fp) within the radius."""
    masks = key_masks(n)
    tasks = max(1, n * len(masks) // TASK_ROWS)

    def compare(group: pa.Table) -> pa.Table:
        table = group.column("_table").to_numpy()
        rows = group.column("fp").to_numpy().view(U64)
        own, place = np.unique(rows, return_inverse=True)
        forest = Forest(len(own))
        for k in np.unique(table).tolist():
            of = table == k
            bucket_links(rows[of], rows[of] & U64(masks[k]), forest, place[of], ~masks[k] & (1 << 64) - 1)
        root = forest.roots(np.arange(len(own)))
        linked = np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"a": pa.array(own[root[linked]].view(np.int64)), "b": pa.array(own[linked].view(np.int64))})

    tables = F.array(*[F.struct(F.lit(k).alias("_table"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("_key")) for k, m in enumerate(masks)])
    dealt = distinct.select("fp", F.inline(tables)).select("fp", "_table", F.pmod(F.xxhash64("_table", "_key"), F.lit(tasks)).alias("_task"))
    return dealt.groupBy("_task").applyInArrow(compare, "a long, b long")


def grouped(prints: DataFrame, rank: Column) -> DataFrame:
    """The rows of ``prints`` with _root, the same for a group of close fingerprints, and _least, the least rank in the group."""
    distinct = settled(prints.groupBy("fp").agg(F.min(rank).alias("least")))
    roots = connected_components(close_stars(distinct, distinct.count()))
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("_least"))
    classes = nodes.join(least, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), "_least")
    return prints.join(classes, prints["fp"] == classes["_fp"]).drop("_fp")


def dedup_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for every document."""
    found = grouped(settled(fingerprints(docs)), F.col("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group: the smallest id's (null ids last), by the text's digest where rows share it.

    Rows are told apart by id and digest, and rows alike in both are in one group. What is joined with the documents
    are the rows to drop, and the chosen ones that are repeated.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest"))
    found = grouped(settled(fingerprints(docs, digest.alias("digest"))), rank).withColumn("_lost", rank != F.col("_least"))
    lost = found.where("_lost").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.lit(None).cast("long").alias("_root")).distinct()
    chosen = found.where("not _lost").groupBy("_root").agg(F.min("doc_id").alias("_id"), F.min("digest").alias("_digest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = settled(lost.unionByName(chosen.drop("n")))
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_own_id"), digest.alias("_own_digest"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest"))
    repeated = rows.join(marks.where("_root is not null"), same).groupBy("_root").agg(F.first("_row").alias("_row"))
    kept = rows.join(marks, same, "left_anti").select("_row").unionByName(repeated.select("_row"))
    return kept.select(*[field(docs, c).alias(c) for c in docs.columns])
