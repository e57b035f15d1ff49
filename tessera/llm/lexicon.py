"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The lexicon maps whole words to their token ids. Its words are compiled into a minimal acyclic
automaton (states with equal suffixes are shared); each state knows how many words lie beyond it, so
walking a word sums up to the word's number in sorted order, under which its ids and their strings are stored. All of it
is a few flat arrays in one file, which Spark ships to the executors and every Python worker maps
into memory, so workers of a machine share its pages.

A worker cuts some megabytes of texts into words, and walks their distinct words through the automaton together, a
byte a step. Words that the lexicon lacks are merged exactly, by the library's model of the vocabulary's merges; these alone are kept
for later texts (``MEMO`` of them).

Frequent words: words are counted over the whole corpus, and the ``max_words`` most
frequent enter the lexicon, which bounds what reaches the driver. The lexicon changes speed alone, never ids.

Texts that hold the string of a special token, or a character assigned too lately for all Unicode tables to agree (see
characters.py), are encoded by the tokenizer itself.

Results for odd input: a null or empty text has no ids and decodes to the empty text; an empty
table gives no rows; rows that repeat are encoded each. Other columns are not read.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import json
import mmap
import os
import re
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .characters import agreed, lowered
from .common import settled

MAX_WORDS = 60_000
#: Merged words that a worker keeps: those the lexicon lacks.
MEMO = 200_000
#: Longer words are not looked up in the lexicon.
LONGEST = 48
#: Characters of text whose words are looked up together, about.
TOGETHER = 12 << 20
#: The vocabulary's cut of lower-case text, for ASCII and for the rest.
ASCII_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
WIDE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WIDE_SPACE}\p{{L}}\p{{N}}]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Automaton:
    """A minimal acyclic automaton over byte strings, with the number of each of its strings in sorted order.

    State s has the edges first[s] to first[s + 1] - 1: a byte, the target, and how many strings sort
    before those through this edge within the state. ``final`` tells whether a string ends at s.
    """

    FIELDS = ("first", "byte", "target", "before", "final")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.first, self.byte, self.target, self.before, self.final = (arrays[f] for f in self.FIELDS)
        # Edges are in order of (state, byte), so one sorted array finds them.
        states = np.repeat(np.arange(len(self.first) - 2), np.diff(self.first[:-1]))
        self.edges = states.astype(np.int64) << 8 | self.byte

    @classmethod
    def compiled(cls, strings: list[bytes]) -> Automaton:
        """From sorted distinct strings: a state is settled, and shared with its equal, once no later string can pass it."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []

        def settle(final: bool, edges: list[tuple[int, int]]) -> int:
            key = (final, *edges)
            if key not in known:
                known[key] = len(states)
                states.append((final, edges))
            return known[key]

        path: list[list] = [[False, []]]  # from the root: final, settled edges; the edge to the next one is open
        last = b""
        for string in [*strings, b""]:
            same = len(os.path.commonprefix([last, string]))
            while len(path) - 1 > same:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final, edges)))
            path += [[False, []] for _ in string[same:]]
            if string:
                path[-1][0] = True
            last = string
        root = settle(*path[0])
        sizes = [0] * len(states)
        for s, (final, edges) in enumerate(states):  # targets are settled before their sources
            sizes[s] = final + sum(sizes[t] for _, t in edges)
        first, byte, target, before = [0], [], [], []
        for final, edges in states:
            passed = int(final)
            for b, t in edges:
                byte.append(b)
                target.append(t)
                before.append(passed)
                passed += sizes[t]
            first.append(len(byte))
        first.append(root)  # the last entry names the root
        kinds = (np.int32, np.uint8, np.int32, np.int32, np.bool_)
        return cls({f: np.array(x, k) for f, x, k in zip(cls.FIELDS, (first, byte, target, before, [f for f, _ in states]), kinds, strict=True)})

    def numbers(self, strings: list[bytes]) -> np.ndarray:
        """Each string's place among all in sorted order, or -1; all are walked at once, a byte a step."""
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings], np.int64)
        at, passed = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        state = np.full(len(sizes), self.first[-1], np.int64)
        going, step = np.flatnonzero(sizes), 0
        while len(going) and len(self.edges):
            wanted = state[going] << 8 | data[at[going] + step]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            found = self.edges[edge] == wanted
            state[going[~found]] = -1
            going, edge = going[found], edge[found]
            passed[going] += self.before[edge]
            state[going] = self.target[edge]
            step += 1
            going = going[sizes[going] > step]
        state[going] = -1  # an automaton without edges
        return np.where((state >= 0) & self.final[state], passed, -1)


#: A word's output: its ids and their strings, each joined by spaces; a zero byte, which is in neither, lies between.
Output = tuple[str, str]


class Lexicon:
    """The automaton and the outputs of its words: that of word n is bytes cuts[n] to cuts[n + 1] of ``outputs``."""

    def __init__(self, words: Automaton, cuts: np.ndarray, outputs: bytes | mmap.mmap, start: int = 0) -> None:
        self.words, self.cuts, self.outputs, self.start = words, cuts, outputs, start

    @classmethod
    def compiled(cls, entries: dict[bytes, Output]) -> Lexicon:
        words = sorted(entries)
        outputs = ["\0".join(entries[w]).encode() for w in words]
        return cls(Automaton.compiled(words), np.cumsum([0, *map(len, outputs)], dtype=np.int64), b"".join(outputs))

    def outputs_of(self, words: list[bytes]) -> Iterator[Output | None]:
        numbers, outputs = self.words.numbers(words), self.outputs
        found = np.maximum(numbers, 0) if len(self.cuts) > 1 else np.zeros(0, np.int64)
        lo, hi = (self.cuts[found] + self.start).tolist(), (self.cuts[found + 1] + self.start).tolist() if len(found) else []
        for k, n in enumerate(numbers.tolist()):
            if n < 0:
                yield None
            else:
                ids, _, tokens = outputs[lo[k] : hi[k]].decode().partition("\0")
                yield ids, tokens

    def save(self, path: str) -> None:
        """One file: a line that tells the arrays' types and lengths, then the arrays, each at a multiple of 8 bytes."""
        arrays = {f: getattr(self.words, f) for f in Automaton.FIELDS} | {"cuts": self.cuts, "outputs": np.frombuffer(self.outputs, np.uint8)}
        head = json.dumps({f: [a.dtype.str, len(a)] for f, a in arrays.items()}).encode()
        with open(path, "wb") as out:
            out.write(head + b" " * (-(len(head) + 1) % 8) + b"\n")
            for a in arrays.values():
                out.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            head = f.readline()
            pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, arrays = len(head), {}
        for field, (kind, n) in json.loads(head).items():
            start, size = at, n * np.dtype(kind).itemsize
            arrays[field] = np.frombuffer(pages, kind, n, start)
            at += size + -size % 8
        return cls(Automaton(arrays), arrays["cuts"], pages, start)


class Merger:
    """The vocabulary: exact merges of a word by the library's BPE model, and the strings of ids."""

    def __init__(self, tokenizer_file: str) -> None:
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.strings = {i: s for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = dict(enumerate(byte_alphabet()))

    def merged(self, word: str) -> Output:
        plain = word.isascii() and word.isprintable()  # stands for itself
        tokens = self.model.tokenize(word if plain else word.encode().decode("latin-1").translate(self.alphabet))
        return " ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens])


def cut(text: str) -> list[str]:
    """The words of a text that all tables treat alike."""
    return (ASCII_CUT if text.isascii() else WIDE_CUT).findall(lowered(text))


class Coder:
    """Encodes and decodes texts, some megabytes at a time."""

    def __init__(self, merger: Merger, lexicon: Lexicon) -> None:
        self.merger, self.lexicon = merger, lexicon
        self.merged: dict[str, Output] = {}

    def words_of(self, text: str) -> list[str] | None:
        """The text's words; None if the tokenizer must see the text whole."""
        return None if any(s in text for s in self.merger.special) or not agreed(text) else cut(text)

    def outputs(self, words: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Ids and strings by word, from the lexicon, and by merging what it lacks."""
        ids, tokens, merged = {}, {}, self.merged
        if len(merged) > MEMO:
            merged.clear()
        for word, found in zip(words, self.lexicon.outputs_of([w.encode() if len(w) <= LONGEST else b"" for w in words]), strict=True):
            if found is None:
                found = merged.get(word)
                if found is None:
                    found = merged[word] = self.merger.merged(word)
            ids[word], tokens[word] = found
        return ids, tokens

    def decoded(self, ids: list[int]) -> str:
        """The vocabulary names no decoder, so tokens are joined by spaces as they are."""
        return " ".join([self.merger.strings[i] for i in ids])

    def coded(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Each text's ids, as numbers joined by spaces, and its decoded text."""
        lists = [self.words_of(t) for t in texts]
        known, tokens = self.outputs(list(set().union(*(w for w in lists if w is not None))))
        for text, words in zip(texts, lists, strict=True):
            if words is None:
                ids = self.merger.tokenizer.encode(text, add_special_tokens=False).ids
                yield " ".join(map(str, ids)), self.decoded(ids)
            else:
                yield " ".join(map(known.__getitem__, words)), " ".join(map(tokens.__getitem__, words))


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about TOGETHER characters; a longer one is a run of its own."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


@functools.lru_cache(maxsize=1)
def coder(tokenizer_file: str, lexicon_file: str) -> Coder:
    """One for all tasks of a Python worker."""
    return Coder(Merger(tokenizer_file), Lexicon.mapped(lexicon_file))


def frequent_words(docs: DataFrame, max_words: int = MAX_WORDS) -> list[str]:
    """The most frequent words of all texts, ``max_words`` at most; no more reach the driver, whatever the number of tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            for text in batch.column(0):
                t = text.as_py()
                if t and agreed(t):
                    words.update(cut(t))
            short = [w for w in words if len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array([words[w] for w in short], pa.int64())], names=["word", "n"])

    found = settled(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # By steps of frequency, a 16th of a power of two each: the most frequent steps that fit.
    step, least, taken = F.floor(F.log2("n") * 16), None, 0
    for s, n in sorted(map(tuple, found.groupBy(step).count().collect()), reverse=True):  # about 1,000 rows at most
        if taken + n > max_words:
            break
        least, taken = s, taken + n
    return [] if least is None else [r["word"] for r in found.where(step >= least).select("word").collect()]


def ship_lexicon(docs: DataFrame, tokenizer_file: str, **bounds: int) -> str:
    """Compiles the lexicon and hands its file to Spark, which serves it while the driver runs; returns the file's name there."""
    merger = Merger(tokenizer_file)
    lexicon = Lexicon.compiled({w.encode(): merger.merged(w) for w in frequent_words(docs, **bounds)})
    folder = tempfile.mkdtemp(prefix="lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{os.path.basename(folder)}.bin"
    lexicon.save(path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def code(docs: DataFrame, tokenizer_file: str, with_ids: bool = False, **bounds: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ``with_ids`` adds the ids and the decoded text."""
    name = ship_lexicon(docs, tokenizer_file, **bounds)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_file, SparkFiles.get(name))
        for batch in batches:
            at = 0
            for texts in together([t.as_py() or "" for t in batch.column(1)]):
                rows = []
                for ids, decoded in own.coded(texts):
                    row = (ids.count(" ") + 1 if ids else 0, sha(ids), sha(decoded))
                    rows.append((*row, list(map(int, ids.split())), decoded) if with_ids else row)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], *columns], names=names)
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
