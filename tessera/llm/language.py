"""Language identification, word first with backoff to character n-grams.

Training counts lower-cased words and their character n-grams (1 to ``GRAM``, with a mark at both ends)
by language in labelled documents. A known word scores log((count + 0.5) / (words + 0.5 * vocabulary))
in each language. An unseen word takes its longest n-grams of which the model knows any: the mean of
their scores, computed the same way; failing these, the next shorter ones. A text's score in a language
is the sum over its words; the prediction is the best language (ties: the first by name), and ``score`` its share
of exp(sum), 0 to 1.

Bound: the model is fitted on about ``train_docs`` labelled documents (a parameter; a hash of the id decides which), and keeps
every word and n-gram of these, so its size is that of their vocabulary whatever the input; prediction covers every whole text.

Learned from: text and lang of documents with a known language that are not held out
(crc32(doc_id as text) mod 5 is not 0). ``lang``, ``source`` and ``doc_id`` are no input of a prediction.

Results for odd input: a text that is null or has no letter is ``und`` with score 0; without any
labelled document everything is ``und``; a null id counts as held out; an empty table gives no rows. Further
columns are carried along on request, those with the name of a result column (whatever its case) excepted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, named, place, row_of

TRAIN_DOCS = 5_000
GRAM = 4
UNKNOWN = "und"
#: Unseen words whose scores a Python worker keeps, and the longest such word.
MEMO, MEMO_LENGTH = 200_000, 64
RESULT = ["held_out", "lang_pred", "score"]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


ASCII_WORDS, WIDE_WORDS = re.compile(r"[a-z]+").findall, regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    return (ASCII_WORDS if text.isascii() else WIDE_WORDS)(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


Counts = tuple[list[str], np.ndarray]


class Model:
    """``words`` and ``parts`` (n-grams): items, and their counts with a column a language."""

    def __init__(self, langs: list[str], words: Counts, parts: Counts) -> None:
        self.langs = langs
        self.words = {w: k for k, w in enumerate(words[0])}
        self.word_scores = self.scores(words[1])
        # Rows of n-grams by length; scores are shares of the n-grams of that length.
        lengths = np.array([len(p) for p in parts[0]], np.int64)
        of_length = {n: np.flatnonzero(lengths == n) for n in range(1, GRAM + 1)}
        self.parts = {n: {parts[0][k]: row for row, k in enumerate(at.tolist())} for n, at in of_length.items()}
        self.part_scores = {n: self.scores(parts[1][at]) for n, at in of_length.items()}

    def scores(self, counts: np.ndarray) -> np.ndarray:
        table = counts.astype(float) + 0.5
        return np.log(table / table.sum(axis=0))

    def unseen(self, word: str) -> np.ndarray:
        for n in range(GRAM, 0, -1):
            known = self.parts[n]
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return self.part_scores[n][found].sum(axis=0) / len(found)
        return np.zeros(len(self.langs))


class Scorer:
    """Predicts texts; keeps the scores of unseen words for the next text."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place = dict(self.model.words)
        self.table = np.zeros((len(self.place) + MEMO, len(self.model.langs)))
        self.table[: len(self.place)] = self.model.word_scores

    def rows(self, words: list[str]) -> list[int]:
        """The words' rows in the table; words without one get theirs."""
        place = self.place
        found = list(map(place.get, words))
        if None in found:
            for k, row in enumerate(found):
                if row is None:
                    row = found[k] = place[words[k]] = len(place)
                    self.table[row] = self.model.unseen(words[k])
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text and self.model.langs else []
        if not words:
            return UNKNOWN, 0.0
        counts = Counter(words)
        distinct = list(counts)
        total = np.zeros(len(self.model.langs))
        for word in [w for w in distinct if len(w) > MEMO_LENGTH and w not in self.model.words]:  # too long to keep
            total += counts.pop(word) * self.model.unseen(word)
        distinct, numbers = list(counts), np.array(list(counts.values()), float)
        for k in range(0, len(distinct), MEMO):
            part = distinct[k : k + MEMO]
            if len(self.place) + len(part) > len(self.table):
                self.reset()
            total += numbers[k : k + MEMO] @ self.table[self.rows(part)]
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def _cutter(text: Column, n: int):
    """A function of one column, as transform() counts parameters."""
    return lambda k: F.substring(text, k, F.lit(n))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model from the labelled documents that are not held out; the sample's vocabulary comes to the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    share = train_docs / max(1, labelled.count())
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1, share) * (1 << 30)))
    counts = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).cache()
    try:
        marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        cut = F.flatten(F.array(*[F.transform(starts(n), _cutter(marked, n)) for n in range(1, GRAM + 1)]))
        langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # languages, not documents
        if not langs:
            return Model([], ([], np.zeros((0, 0))), ([], np.zeros((0, 0))))

        def by_lang(pairs: DataFrame, item: str) -> Counts:
            sums = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(langs)]
            table = pairs.groupBy(item).agg(*sums).toArrow()
            return table.column(0).to_pylist(), np.stack([c.to_numpy() for c in table.columns[1:]], axis=1)

        words = by_lang(counts, "word")
        return Model(langs, words, by_lang(counts.select("lang", "n", F.explode(cut).alias("gram")).where("gram <> ''"), "gram"))
    finally:
        counts.unpersist()


def identify(docs: DataFrame, carried: list[str] | None = None, model: Model | None = None, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; with ``carried``, these columns before them."""
    carried = apart(["doc_id"] if carried is None else carried, RESULT)
    found = identify_rows(docs, carried, model, **bounds)
    return found.select(*[F.col("_row").getField(f"c{k}").alias(c) for k, c in enumerate(carried)], *[F.col("_found").getField(r).alias(r) for r in RESULT])


def identify_rows(docs: DataFrame, carried: list[str] | None = None, model: Model | None = None, **bounds: int) -> DataFrame:
    """The same as (_row, _found), see common.row_of(), where ``_row`` has the carried columns, all by default."""
    model = model or fit(docs, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary of train_docs documents
    carried = docs.columns if carried is None else carried
    text = place(docs, "text") if [c.lower() for c in carried] == [c.lower() for c in docs.columns] else None
    rows = docs.select(row_of(docs.select(*map(named, carried))), held_out().alias("_held_out"), *([] if text is not None else [F.col("text").alias("_text")]))
    schema = rows.select("_row", "_held_out").schema.add("_lang_pred", "string").add("_score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(2) if text is None else pc.struct_field(batch.column(0), text)
            found = [scorer.predict(t.as_py()) for t in texts]
            columns = [*batch.columns[:2], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(predict, schema).select("_row", F.struct(*[F.col(f"_{r}").alias(r) for r in RESULT]).alias("_found"))
