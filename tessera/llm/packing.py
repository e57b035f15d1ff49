"""Packing by power-of-two decomposition.

A document of n ids (its own and one final id 0) is cut at the binary digits of n: as many pieces of
the longest length as fit, then one piece for each binary digit of the rest, longest first. A piece is
a sequence of its own, so no sequence crosses documents and none is padded; equal lengths form a
bucket, and the ids of a bucket's sequences lie in one range of ``sequence_id``.

There is no shuffle: ids are made and cut where the document is read. ``sequence_id`` joins the
bucket, the task's partition and a counter in it.

Results for odd input: a null or empty text is the single id 0, one piece of length 1; an empty table
gives no rows; rows that repeat are packed each. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .characters import agreed

#: Longest sequence.
LENGTH = 1024
END = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pre-tokens kept by a Python worker; the memory of ids is emptied beyond that.
MEMO = 400_000
#: How the byte-level vocabulary cuts text into pre-tokens, for ASCII and for the rest.
ASCII_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
WIDE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_CUT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WIDE_SPACE}\p{{L}}\p{{N}}]+|[{WIDE_SPACE}]+(?![^{WIDE_SPACE}])|[{WIDE_SPACE}]+"


class Pretokens(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers; what is missing is merged and kept."""

    def __init__(self, merge: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self.merge = merge

    def __missing__(self, token: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.merge(token.encode()))
        if len(token) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[token] = ids
        return ids


def id_encoder(tokenizer_file: str, ranks_file: str) -> Callable[[str], bytes]:
    """A function from a text to its packed ids, the same as the tokenizer in ``tokenizer_file`` gives.

    Words repeat, so ids are kept by pre-token; unknown pre-tokens are merged by the same vocabulary as
    ranks. Texts with a special token's string, or a character assigned too lately for all tables, take the tokenizer.
    """
    import base64

    import regex
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    bpe = tiktoken.Encoding("byte level", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    memo = Pretokens(lambda piece: [ranks[piece]] if piece in ranks else bpe.encode_single_piece(piece))
    ascii_cut, wide_cut = re.compile(ASCII_CUT).findall, regex.compile(WIDE_CUT).findall

    def encode(text: str) -> bytes:
        if any(s in text for s in special) or not agreed(text):
            return b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(memo.__getitem__, (ascii_cut if text.isascii() else wide_cut)(text)))

    return encode


def binary_pieces(n: int, longest: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length) of n's pieces: whole ``longest`` ones, then the binary digits of the rest."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    rest = n - start
    while rest:
        length = 1 << rest.bit_length() - 1
        yield start, length
        start += length
        rest -= length


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str, longest: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids, which the columns of digests stand for otherwise."""
    if longest & longest - 1:
        raise ValueError("the longest length must be a power of two")
    schema = PIECES + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer_file, ranks_file)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END
                n = len(ids) // 4
                for start, length in binary_pieces(n, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(piece), n)
                    out.append((*row, memoryview(piece).cast("I").tolist()) if with_ids else row)
            columns = list(zip(*out, strict=True)) if out else [[]] * (5 + with_ids)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, schema)
    bucket = F.length(F.bin("length")) - 1
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(bucket.cast("long"), 58) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
