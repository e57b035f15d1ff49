"""Substring dedup over bytes by distributed prefix doubling.

Every byte is removed that a string of ``length`` (200) bytes covers which also starts anywhere else, in
the same document or another; overlapping occurrences count. Matches stay within documents.

Ranks. The rank of a position at length h stands for the h bytes from there; equal ranks mean equal
bytes. As only equality matters here, a rank is a hash name of 64 bits. Ranks start at pairs of bytes and
double: the rank at 2h mixes the pair of ranks of the position and of the position h further on. Spark sorts ranks
(in buckets, see packed.py) at half the length and at the whole length; positions whose rank is unique
drop out of what follows. Results are exact up to collisions of 96 bits:
ranks, which no structure of a text defeats, and a name of another family beside them.

At half the length sorting every position would shuffle several times the input. But of a string of
200 bytes one half-length position is enough to tell that it is unique, so each window names the
position in it whose rank is smallest (the leftmost of equals): equal windows name equal ranks. Neighbouring
windows name the same position, so about one position in 50 is sorted. Together with its rank goes the
name of the whole stretch that its windows cover.

1. Half length: a position whose rank is unique drops out with its windows. If the rank and the stretch both
   occur again, all windows of the stretch occur again (they are covered without further sorting).
2. Whole length: the windows of the other positions, typically at the edges of matches, and of one copy of each
   covered stretch with their position's rank, get their rank by the last doubling; Spark sorts these, and those that are not unique are covered.
3. Covered bytes are removed.

Text is shuffled once, by block; the rounds read that exchange. Ranks are kept once a block, so a
string that every document shares costs an entry a block. A row repeated any number of times is dealt to all blocks alike.

Results for odd input: a null text is as an empty one; texts shorter than 200 bytes lose nothing; rows
that repeat lose all their bytes (from 200 on) as other copies do; ids are not used in matching; removal may cut
within a character, so what is left is bytes; an empty table gives no rows. Further columns are carried
along, but for those with the name of a result column, whatever its case.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import flattened
from .packed import CELL, U64, Powers, Prefixes, blocks, buckets, cells, chained, gathered, group_starts, in_order, isin_sorted, joined, mix, paired, table as values

LENGTH = 200
BLOCK_BYTES = 2 << 20
#: First ranks: of pairs of bytes for the ranks that double, of single bytes for the names beside them. The two have nothing in common.
PAIRS, BYTES, POWERS = values(1, 1 << 16), values(2), Powers(0x369DEA0F31A53F85)
RESULT = ["n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"]


class Block:
    """The bytes of a block's documents, and the ranks of its positions."""

    def __init__(self, texts: list[bytes | None], length: int) -> None:
        self.texts = [t or b"" for t in texts]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.length = length
        fits = np.zeros(len(self.bytes) + 1, np.int64)
        long = self.sizes >= length
        np.add.at(fits, self.first[:-1][long], 1)
        np.add.at(fits, self.first[1:][long] - length + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(fits)[:-1] > 0)  # of windows within a document

    def rank(self) -> None:
        """Ranks of all positions at half the length; prefix sums for names beside them."""
        pairs = self.bytes[:-1].astype(np.uint16) << np.uint16(8) | self.bytes[1:]
        self.half = chained(PAIRS[pairs], self.length // 2, 2)
        self.prefixes = Prefixes(BYTES[self.bytes], POWERS)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that name the same position: its rank, the stretch's name, first and last window."""
        if not len(self.starts):
            return (np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.rank()
        n = len(self.half)
        place = U64((1 << n.bit_length()) - 1)
        least = self.half & ~place | np.arange(n, dtype=U64)
        width, span = self.length // 2 + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        named = (least[self.starts] & place).astype(np.int64)
        new = np.ones(len(named), bool)
        new[1:] = (named[1:] != named[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
        at = np.flatnonzero(new)
        lo, hi = self.starts[at], self.starts[np.append(at[1:], len(named)) - 1]
        # Mixed again, as ranks that are the smallest of many would meet in the first buckets.
        return mix(self.half[named[at]]), self.stretch_names(lo, hi), lo, hi

    def stretch_names(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Names of the bytes that windows lo to hi cover, from both families; no more than half a length lies between lo and hi."""
        half = self.length // 2
        ranks = joined(joined(self.half[lo], self.half[lo + half]), self.half[hi + half])
        return joined(ranks, self.prefixes.names(lo, hi + self.length))

    def whole(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at the whole length from the pairs at half of it, and 32 bits of the other family."""
        beside = self.prefixes.names(starts, starts + self.length)
        return joined(self.half[starts], self.half[starts + self.length // 2]), (beside >> U64(32)).astype(np.uint32)


def positions(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each lo to its hi."""
    sizes = hi - lo + 1
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)


def once_a_block(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low), sorted, and which of them occur more than once."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    starts = group_starts(high, low)
    return high[starts], low[starts], np.diff(np.append(starts, len(high))) > 1


def repeated(keys: tuple[np.ndarray, ...], several: np.ndarray) -> np.ndarray:
    """Which entries have a key that occurs twice, where ``several`` entries stand for more than one occurrence."""
    order = np.lexsort(keys)
    starts = group_starts(*[k[order] for k in keys])
    if not len(order):
        return several
    total = np.add.reduceat(1 + several[order].astype(np.int64), starts)
    found = np.empty(len(order), bool)
    found[order] = np.repeat(total > 1, np.diff(np.append(starts, len(order))))
    return found


def per_row(of: np.ndarray, n: int, *values: np.ndarray) -> list[list[bytes]]:
    """Values as binaries by row; ``of`` must be sorted."""
    at = np.searchsorted(of, np.arange(n + 1))
    return [[v[at[k] : at[k + 1]].tobytes() for k in range(n)] for v in values]


def dedup_bytes(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_removed, n_spans, kept_bytes (binary), kept_sha256."""
    if length < 4 or length % 2:
        raise ValueError("the length must be even, and 4 at least")
    dealt, n_blocks = blocks(docs, block_bytes)
    n_buckets = buckets(n_blocks)
    by_block = dealt.groupBy("_block")

    def block_of(table: pa.Table) -> Block:
        return Block(table.column("_text").cast(pa.binary()).to_pylist(), length)

    def sort_half(table: pa.Table) -> pa.Table:
        rank, stretch, _, _ = block_of(in_order(table.select(["_id", "_text"]))).stretches()
        order = np.lexsort((stretch, rank))
        rank, stretch = rank[order], stretch[order]
        first = group_starts(rank, stretch)
        several = np.diff(np.append(first, len(rank))) > 1
        rank, stretch = rank[first], stretch[first]
        return cells(table.column("_block")[0].as_py(), rank, n_buckets, [lambda s: rank[s].astype(np.uint32).tobytes(), lambda s: stretch[s].tobytes(), lambda s: several[s].tobytes()], ["rank", "stretch", "several"])

    def judge_half(group: pa.Table) -> pa.Table:
        rank, of = gathered(group, "rank", "u4")
        stretch, _ = gathered(group, "stretch", "u8")
        several, _ = gathered(group, "several", "?")
        again, whole = repeated((rank,), several), repeated((stretch, rank), several)
        # A stretch that occurs again is covered, but an open one may share windows with it: one copy of it is sorted too.
        model = whole & isin_sorted(rank, np.unique(rank[again & ~whole]))
        order = np.flatnonzero(model)
        order = order[np.lexsort((stretch[order], rank[order]))]
        model[:] = False
        model[order[group_starts(rank[order], stretch[order])]] = True
        n = group.num_rows
        lists = {k: pa.array(per_row(of[at], n, stretch[at])[0], pa.binary()) for k, at in (("done", whole), ("open", again & ~whole), ("model", model))}
        return pa.table({"_block": group.column("_block")} | lists)

    halves = by_block.applyInArrow(sort_half, CELL + ", rank binary, stretch binary, several binary")
    judged = halves.groupBy("_bucket").applyInArrow(judge_half, "_block long, done binary, open binary, model binary")

    def sort_whole(table: pa.Table, answers: pa.Table) -> pa.Table:
        fields = ["high", "low", "several"]
        sent = np.sort(np.concatenate([gathered(answers, "open", "u8")[0], gathered(answers, "model", "u8")[0]]))
        if not table.num_rows or not len(sent):
            return pa.table({k: pa.array([], t) for k, t in zip(["_bucket", "_block", *fields], [pa.int64(), pa.int64(), *[pa.binary()] * 3], strict=True)})
        block = block_of(in_order(table.select(["_id", "_text"])))
        _, stretch, lo, hi = block.stretches()
        left = isin_sorted(stretch, sent)
        high, low, several = once_a_block(*block.whole(positions(lo[left], hi[left])))
        return cells(table.column("_block")[0].as_py(), high, n_buckets, [lambda s: high[s].tobytes(), lambda s: low[s].tobytes(), lambda s: several[s].tobytes()], fields)

    def judge_whole(group: pa.Table) -> pa.Table:
        high, of = gathered(group, "high", "u8")
        low, _ = gathered(group, "low", "u4")
        several, _ = gathered(group, "several", "?")
        found = np.flatnonzero(repeated((low, high), several))
        return pa.table({"_block": group.column("_block"), "done": pa.array(per_row(of[found], group.num_rows, high[found])[0], pa.binary()), "open": pa.array([None] * group.num_rows, pa.binary()), "model": pa.array([None] * group.num_rows, pa.binary()), "windows": pa.array([True] * group.num_rows)})

    wholes = by_block.cogroup(judged.groupBy("_block")).applyInArrow(sort_whole, CELL + ", high binary, low binary, several binary")
    windows = wholes.groupBy("_bucket").applyInArrow(judge_whole, "_block long, done binary, open binary, model binary, windows boolean")
    answers = judged.selectExpr("*", "false as windows").unionAll(windows)
    kinds = dict(zip(RESULT, [LongType(), LongType(), LongType(), BinaryType(), StringType()], strict=True))
    schema = StructType([*dealt.schema.fields[1:], *[StructField(k, t) for k, t in kinds.items()]])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        block = block_of(table)
        edges = np.zeros(len(block.bytes) + 1, np.int64)
        flags = answers.column("windows")
        stretches, windows = (answers.filter(f) for f in (pc.invert(flags), flags))
        done = np.sort(gathered(stretches, "done", "u8")[0])
        open_ = np.sort(gathered(stretches, "open", "u8")[0])
        if len(done) or len(open_):
            _, stretch, lo, hi = block.stretches()
            covered = isin_sorted(stretch, done)
            np.add.at(edges, lo[covered], 1)
            np.add.at(edges, hi[covered] + length, -1)
            left = isin_sorted(stretch, open_)
            at = positions(lo[left], hi[left])
            if len(at):
                at = at[isin_sorted(block.whole(at)[0], np.sort(gathered(windows, "done", "u8")[0]))]
            edges[at] += 1
            edges[at + length] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        firsts = block.first[:-1][block.sizes > 0]
        opens[firsts] = gone[firsts]
        sums, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(opens)])
        n_removed, n_spans = np.diff(sums[block.first]), np.diff(spans[block.first])
        kept = [t if not n else block.bytes[a:b][~gone[a:b]].tobytes() for t, n, a, b in zip(block.texts, n_removed.tolist(), block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)]
        values = [block.sizes, n_removed, n_spans, kept, [hashlib.sha256(k).hexdigest() for k in kept]]
        added = {k: pa.array(v, t) for k, v, t in zip(RESULT, values, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()], strict=True)}
        return pa.table({c: table.column(c) for c in table.column_names if c != "_block"} | added)

    done = by_block.cogroup(answers.groupBy("_block")).applyInArrow(remove, schema)
    return flattened(paired(done, docs, RESULT), docs)
