"""Substring dedup with difference-cover anchors.

A window is ``window`` (13) consecutive words of one document. A word is removed if it is covered by a
window whose words also start in a document with a smaller id.

Method. D = {0, 1, 3} is a difference cover modulo 7: for any two positions there is a shift below 7
that takes both into D. So two equal windows of 13 words share an aligned anchor: the 7 words that
start at a position in D (counted from each document's start, modulo 7) inside both. Three rounds:

1. anchors: each block names the 7-word windows at cover positions only (3 in 7), keeps 32 bits of each
   name besides its bucket, and learns which occur in two documents or more;
2. extension: positions within reach of a shared anchor are extended to whole windows, named with 96
   bits; for each name the smallest document id over all blocks comes back where it is below the block's;
3. covered words are cut out of the text.

Anchors are a filter only (a false match costs one name more in round 2); round 2 decides. Its names are exact up to
collisions of 96 bits. They come from two names of each word, a sum of powers modulo 2^64 and one modulo a prime: structured words
can share the first, but not the other. Windows join the words' names by mixing, twice and apart from each other.

Text is shuffled once, by block; all three rounds read that exchange. See packed.py for why hot
passages and groups of copies stay small.

Results for odd input: a null or empty text has no words; words are split at ASCII white space only; a
document of fewer than 13 words loses nothing; rows that share an id are no smaller than each other, so
rows that repeat stay (and are dealt to all blocks alike); a null id counts as larger than any other, so such a row removes nothing from
others; an empty table gives no rows. Further columns are carried along as they are, but for those with
the name of a result column, whatever its case.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import flattened
from .packed import BLOCK_BYTES, CELL, PRIME, U64, Powers, Prefixes, PrimePowers, PrimePrefixes, bucket_of, buckets, blocks, cells, chained, gathered, group_starts, in_order, isin_sorted, joined, paired, table as values

#: A difference cover and its period.
COVER, PERIOD = (0, 1, 3), 7
WINDOW = 13
NO_ID = np.iinfo(np.int64).max
RESULT = ["n_words", "n_removed", "kept_text", "kept_sha256"]
WORD = re.compile(rb"[^ \t-\r]+")


#: Bytes' values for sums of powers modulo 2^64, and modulo a prime.
BYTES, POWERS = values(1), Powers(0x5851F42D4C957F2D)
PRIME_BYTES, PRIME_POWERS = values(2) % U64(PRIME), PrimePowers(0x2545F491)


class Words:
    """The words of a block's documents, in order of (id, text)."""

    def __init__(self, ids: list, texts: list[bytes | None]) -> None:
        self.docs = [(t or b"").split() for t in texts]
        self.counts = np.array([len(d) for d in self.docs], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.of = np.repeat(np.arange(len(self.docs)), self.counts)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        line = np.frombuffer(b" ".join(b" ".join(d) for d in self.docs if d), np.uint8)
        gaps = np.flatnonzero(line == 32)
        starts, ends = (np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])) if len(line) else (gaps, gaps)
        names = Prefixes(BYTES[line], POWERS).names(starts, ends)
        primes = PrimePrefixes(PRIME_BYTES[line], PRIME_POWERS).names(starts, ends)
        self.names, self.check = joined(names, primes), joined(primes, names)

    def fitting(self, length: int) -> np.ndarray:
        """Which words start a window of that length in their document."""
        return np.arange(len(self.of)) + length <= self.first[1:][self.of]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors, and their names."""
        length = window - PERIOD + 1
        at = np.arange(len(self.of))
        ok = np.isin((at - self.first[self.of]) % PERIOD, COVER) & self.fitting(length)
        at = at[ok]
        return at, chained(self.names, length)[at]

    def candidates(self, window: int, shared: np.ndarray, n_buckets: int) -> np.ndarray:
        """Starts of windows that hold a shared anchor."""
        at, names = self.anchors(window)
        hit = np.zeros(len(self.of) + 1, np.int64)
        hit[at[isin_sorted(short(names, n_buckets), shared)]] = 1
        sums = np.concatenate([[0], np.cumsum(hit)])
        start = np.flatnonzero(self.fitting(window))
        return start[sums[start + PERIOD] > sums[start]]

    def windows(self, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of name in two arrays."""
        return chained(self.names, window)[starts], (chained(self.check, window)[starts] >> U64(32)).astype(np.uint32)


def without(text: bytes, removed: list[bool]) -> bytes:
    """The text without these of its words; of the gaps around a removed run the one before stays if it ends a line, else the one after."""
    spans = [m.span() for m in WORD.finditer(text)]
    parts, at, k, n = [], 0, 0, len(spans)
    while k < n:
        if not removed[k]:
            k += 1
            continue
        first = k
        while k < n and removed[k]:
            k += 1
        before, start = spans[first - 1][1] if first else 0, spans[first][0]
        end, after = spans[k - 1][1], spans[k][0] if k < n else len(text)
        lo, hi = (start, after) if b"\n" in text[before:start] or not first else (before, end)
        parts.append(text[at:lo])
        at = hi
    return b"".join(parts) + text[at:]


def short(names: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a name."""
    return bucket_of(names, n_buckets) << U64(32) | names & U64(0xFFFFFFFF)


def smallest(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by name, and for each entry in that order the smallest id under its name."""
    order = np.lexsort((low, high))
    starts = group_starts(high[order], low[order])
    if not len(order):
        return order, ids
    least = np.minimum.reduceat(ids[order], starts)
    return order, np.repeat(least, np.diff(np.append(starts, len(order))))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept_text (the text without the removed words), kept_sha256 (of the kept words, joined by spaces)."""
    return flattened(substring_rows(docs, window, block_bytes), docs)


def substring_rows(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same as (_row, _found), see common.row_of()."""
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    dealt, n_blocks = blocks(docs, block_bytes)
    n_buckets = buckets(n_blocks)
    by_block = dealt.groupBy("_block")

    def words(table: pa.Table) -> Words:
        return Words(table.column("_id").to_pylist(), table.column("_text").cast(pa.binary()).to_pylist())

    def name_anchors(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        w = words(in_order(table.select(["_id", "_text"])))
        at, names = w.anchors(window)
        order = np.lexsort((w.ids[w.of[at]], names))
        names, ids = names[order], w.ids[w.of[at]][order]
        starts = group_starts(names)
        ends = np.append(starts[1:], len(names)) - 1
        several = ids[starts] != ids[ends] if len(starts) else np.empty(0, bool)
        names = names[starts]
        low = names.astype(np.uint32)
        return cells(block, names, n_buckets, [lambda s: low[s][~several[s]].tobytes(), lambda s: low[s][several[s]].tobytes()], ["one", "more"])

    def share_anchors(group: pa.Table) -> pa.Table:
        bucket = group.column("_bucket")[0].as_py()
        one, of_one = gathered(group, "one", "u4")
        more, of_more = gathered(group, "more", "u4")
        every = np.sort(np.concatenate([one, more]))
        shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], more]))
        known = isin_sorted(one, shared)
        out, block = [], group.column("_block").to_pylist()
        keep = np.concatenate([one[known], more])
        of = np.concatenate([of_one[known], of_more])
        order = np.argsort(of, kind="stable")
        keep, of = keep[order], of[order]
        at = np.searchsorted(of, np.arange(len(block) + 1))
        rows = [k for k in range(len(block)) if at[k] < at[k + 1]]
        out = [keep[at[k] : at[k + 1]].tobytes() for k in rows]
        return pa.table({"_block": pa.array([block[k] for k in rows], pa.int64()), "_bucket": pa.array([bucket] * len(rows), pa.int64()), "shared": pa.array(out, pa.binary())})

    anchored = by_block.applyInArrow(name_anchors, CELL + ", one binary, more binary")
    shared = anchored.groupBy("_bucket").applyInArrow(share_anchors, "_block long, _bucket long, shared binary")

    def name_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        fields = ["high", "low", "ids"]
        if not answers.num_rows or not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(["_bucket", "_block", *fields], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)})
        block = table.column("_block")[0].as_py()
        low, of = gathered(answers, "shared", "u4")
        known = np.sort(np.array(answers.column("_bucket").to_pylist(), U64)[of] << U64(32) | low.astype(U64))
        w = words(in_order(table.select(["_id", "_text"])))
        starts = w.candidates(window, known, n_buckets)
        high, low = w.windows(window, starts)
        order, ids = smallest(high, low, w.ids[w.of[starts]])
        high, low = high[order], low[order]
        first = group_starts(high, low)
        high, low, ids = high[first], low[first], ids[first]
        # Within a bucket by id, so that ids come in runs.
        order = np.lexsort((ids, bucket_of(high, n_buckets)))
        high, low, ids = high[order], low[order], ids[order]
        return cells(block, high, n_buckets, [lambda s: high[s].tobytes(), lambda s: low[s].tobytes(), lambda s: ids[s].tobytes()], fields)

    def smaller_ids(group: pa.Table) -> pa.Table:
        high, of = gathered(group, "high", "u8")
        low, _ = gathered(group, "low", "u4")
        ids, _ = gathered(group, "ids", "i8")
        order, least = smallest(high, low, ids)
        told = least < ids[order]
        order, least = order[told], least[told]
        by_row = np.lexsort((least, of[order]))
        order, least = order[by_row], least[by_row]
        block = group.column("_block").to_pylist()
        at = np.searchsorted(of[order], np.arange(len(block) + 1))
        rows = [k for k in range(len(block)) if at[k] < at[k + 1]]
        part = lambda a: pa.array([a[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary())
        return pa.table({"_block": pa.array([block[k] for k in rows], pa.int64()), "high": part(high[order]), "low": part(low[order]), "ids": part(least)})

    named = by_block.cogroup(shared.groupBy("_block")).applyInArrow(name_windows, CELL + ", high binary, low binary, ids binary")
    smaller = named.groupBy("_bucket").applyInArrow(smaller_ids, "_block long, high binary, low binary, ids binary")
    schema = StructType([*dealt.schema.fields[1:], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), StructField("kept_sha256", StringType())])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        w = words(table)
        starts = np.flatnonzero(w.fitting(window))
        high, low = w.windows(window, starts)
        told_high, _ = gathered(answers, "high", "u8")
        told_low, _ = gathered(answers, "low", "u4")
        told_ids, _ = gathered(answers, "ids", "i8")
        own = w.ids[w.of[starts]]
        order, least = smallest(np.concatenate([high, told_high]), np.concatenate([low, told_low]), np.concatenate([own, told_ids]))
        all_least = np.empty(len(order), np.int64)
        all_least[order] = least
        gone = starts[all_least[: len(starts)] < own]
        edges = np.zeros(len(w.of) + window + 1, np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + window, -1)
        removed = np.cumsum(edges)[: len(w.of)] > 0
        sums = np.concatenate([[0], np.cumsum(removed)])
        n_removed = sums[w.first[1:]] - sums[w.first[:-1]]
        kept, digests = [], []
        for k, (doc, text) in enumerate(zip(w.docs, table.column("_text").cast(pa.binary()).to_pylist(), strict=True)):
            if n_removed[k]:
                gone = removed[w.first[k] : w.first[k + 1]].tolist()
                doc = [x for x, r in zip(doc, gone, strict=True) if not r]
                text = without(text, gone)
            kept.append(text)
            digests.append(hashlib.sha256(b" ".join(doc)).hexdigest())
        added = {"n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({c: table.column(c) for c in table.column_names if c != "_block"} | added)

    done = by_block.cogroup(smaller.groupBy("_block")).applyInArrow(remove, schema)
    return paired(done, docs, RESULT)


#: The same in SQL: windows are compared as text.
SUBSTRINGS_SQL = r"""
WITH parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM parts WHERE len(ws) >= 13),
named AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS name FROM windows),
told AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY name) AS least FROM named),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM told, range(13) AS t(k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM parts),
kept AS (
  SELECT words.doc_id, count(covered.i) AS n_removed, string_agg(CASE WHEN covered.i IS NULL THEN w END, ' ' ORDER BY words.i) AS text
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.i = covered.i GROUP BY words.doc_id)
SELECT p.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM parts p LEFT JOIN kept k ON p.doc_id = k.doc_id
"""
