"""Stages of a corpus pipeline: documents in, documents out, each by one operator of this subpackage.

All but the last return the columns they were given, whatever their names: only text and, where there is one, n_chars (the text's
length) change. A stage takes what its predecessor kept, whole:
language identification drops documents without a language, line and substring dedup shorten texts,
near-dedup keeps the row with the smallest id of each group (null ids last), packing makes sequences.

Near-dedup decides by row: of repeated rows, with or without an id, one stays, and rows that share an id but not
a text are apart. Other stages take rows that share an id for one document's.
An empty table passes through each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import field, with_text
from .language import UNKNOWN, fit, identify_rows
from .lines import line_rows
from .packing import pack
from .simhash import one_of_each_group
from .substring import substring_rows


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, of which no language can be told; these only, too, where no labelled document gives a model."""
    model = fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify_rows(docs, model=model).where(F.col("_found.lang_pred") != UNKNOWN)
    return found.select(*[field(docs, c).alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows from the texts."""
    return with_text(line_rows(docs), docs, F.col("_found.kept_text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, whatever ids rows share."""
    return one_of_each_group(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of 13-word windows that a document with a smaller id has out of the texts, which keep their other bytes and lines."""
    return with_text(substring_rows(docs), docs, F.col("_found.kept_text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each a sequence of a power of two of ids."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
