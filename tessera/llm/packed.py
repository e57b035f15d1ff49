"""Names (hashes) of text windows by the block, and their exchange in packed form.

Documents are dealt into blocks of some megabytes. A Python task sees a block as a few numpy arrays,
names its windows by doubling, and keeps each name once a block. Names travel as arrays, one row
per (block, bucket of names), to the bucket's task, which sorts all its blocks' names at once and
answers each block with those of its names that matter. So a passage that every document shares costs
one entry a block, not one a document, and no task holds a document's or a passage's copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import apart, named, text_bytes

#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 3 << 20
#: Blocks whose names one bucket's task sorts together, about.
BLOCKS_A_BUCKET = 24
#: Up to so many buckets, fewer blocks make one.
LEAST_BLOCKS, MOST_SMALL = 6, 32

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one (splitmix64's finalizer)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def table(seed: int, n: int = 256) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for two names in this order; mixing, unlike a sum of powers, leaves no structure that texts could share."""
    return mix(left * U64(0x9FB21C651E98DF25) + right)


def chained(names: np.ndarray, length: int, span: int = 1) -> np.ndarray:
    """Names of all stretches of ``length`` entries by their start, from those of ``span`` entries each.

    Names double, two of them becoming one, and overlap the last time. Every second step and the last one mix.
    """
    n = len(names) - length + span
    if n <= 0:
        return np.empty(0, U64)
    out, plain = names, False
    while 2 * span <= length:
        plain = not plain
        if plain and 2 * span < length:
            left = out[:-span] * U64(0xD6E8FEB86659FD93)
            left += out[span:]
            out = left
        else:
            out = joined(out[:-span], out[span:])
        span *= 2
    if span < length:
        out = joined(out[:n], out[length - span : length - span + n])
    return out


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.known = [np.ones(1, U64), np.ones(1, U64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < n:
            size = max(n, 1 << 20)
            for k, base in enumerate(self.bases):
                steps = np.full(size, base, U64)
                steps[0] = 1
                self.known[k] = np.cumprod(steps, dtype=U64)
        return self.known[0][:n], self.known[1][:n]


class Prefixes:
    """Names of any stretch of a sequence of 64-bit values in constant time. Structured texts may share them: for use beside another name."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


PRIME = (1 << 31) - 1


def folded(x: np.ndarray) -> np.ndarray:
    """Smaller numbers, equal modulo PRIME: from below 2^62 to below 2^32."""
    out = x >> U64(31)
    out += x & U64(PRIME)
    return out


def below_prime(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo PRIME, by shifts."""
    x = folded(folded(x))
    x[x == U64(PRIME)] = 0
    return x


class PrimePowers:
    """Powers of a number and of its inverse modulo PRIME, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, PRIME)
        self.known = [np.ones(1, U64), np.ones(1, U64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.known[0]) < n:
            for k, base in enumerate(self.bases):
                have = self.known[k]
                self.known[k] = np.concatenate([have, below_prime(have * U64(pow(base, len(have), PRIME)))])
        return self.known[0][:n], self.known[1][:n]


class PrimePrefixes:
    """Names below PRIME of any stretch of a sequence of values below it. Two texts share a name for few bases only, however they are built."""

    def __init__(self, values: np.ndarray, powers: PrimePowers) -> None:
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(folded(values * up[:-1]), out=self.sums[1:])

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return below_prime(below_prime(self.sums[ends] - self.sums[starts]) * self.down[starts])


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``_block``, doc_id as ``_id``, text as ``_text`` and the other columns as one, ``_rest``; and the number of blocks.

    A row's block depends on its id, its text and its place in the input, so that a row that is repeated any number of times
    is dealt to all blocks alike. Input must come in the same order when a task is run again, as tables, files and
    checkpoints do. All rounds should use all these columns: then Spark deals the rows out once and rereads that exchange.
    """
    n = max(1, math.ceil(text_bytes(docs) / block_bytes))
    others = [named(c).alias(f"c{k}") for k, c in enumerate(other_columns(docs))]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    block = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n))
    return docs.select(block.alias("_block"), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), rest.alias("_rest")), n


def other_columns(docs: DataFrame) -> list[str]:
    return apart(docs.columns, ["doc_id", "text"])


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in an order that depends on ids and texts alone."""
    return table.sort_by([("_id", "ascending"), ("_text", "ascending")])


def paired(df: DataFrame, docs: DataFrame, results: list[str]) -> DataFrame:
    """(_row, _found): the row as common.row_of() makes it, and the results."""
    rest = {c.lower(): F.col("_rest").getField(f"c{k}") for k, c in enumerate(other_columns(docs))}
    own = {"doc_id": F.col("_id"), "text": F.col("_text")} | rest
    row = F.struct(*[own[c.lower()].cast(docs.schema[k].dataType).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    return df.select(row.alias("_row"), F.struct(*results).alias("_found"))


def buckets(n_blocks: int) -> int:
    """Few for few blocks, so that all cores have work; then BLOCKS_A_BUCKET blocks each."""
    return max(min(math.ceil(n_blocks / LEAST_BLOCKS), MOST_SMALL), math.ceil(n_blocks / BLOCKS_A_BUCKET), 1)


def bucket_of(names: np.ndarray, n: int) -> np.ndarray:
    """A bucket 0..n-1 from the names' upper halves; grows with the name, so sorted names fall into slices."""
    return ((names >> U64(32)) * U64(n)) >> U64(32)


def cells(block: int, names: np.ndarray, n_buckets: int, parts: list[Callable[[slice], bytes]], fields: list[str]) -> pa.Table:
    """Rows (_bucket, _block, one binary a field) of a block's names, which must be sorted."""
    at = np.searchsorted(bucket_of(names, n_buckets), np.arange(n_buckets + 1, dtype=U64))
    full = np.flatnonzero(np.diff(at))
    slices = [slice(int(at[k]), int(at[k + 1])) for k in full]
    return pa.table({"_bucket": pa.array(full, pa.int64()), "_block": pa.array(np.full(len(full), block), pa.int64())} | {f: pa.array([part(s) for s in slices], pa.binary()) for f, part in zip(fields, parts, strict=True)})


CELL = "_bucket long, _block long"


def gathered(group: pa.Table, field: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary field of all rows as one array, and the row of each of its entries."""
    parts = [np.frombuffer(x, dtype) for x in group.column(field).to_pylist() if x is not None]
    lengths = [len(x) for x in parts]
    return (np.concatenate(parts) if parts else np.empty(0, dtype)), np.repeat(np.arange(len(parts), dtype=np.int32), lengths)


def isin_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array of known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in arrays sorted by them."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
