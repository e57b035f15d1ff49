"""The queries of this subpackage's operators over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, spread
from .cover_tree import EMBEDDINGS_SQL, dedup_embeddings
from .language import fit, identify
from .lexicon import code
from .lines import LINES_SQL, dedup_lines
from .packing import pack
from .quality import QUALITY_SQL, quality_rules
from .sharding import shard_documents
from .simhash import dedup_simhash
from .stages import tokenizer_file
from .substring import SUBSTRINGS_SQL, dedup_substrings
from .suffix import dedup_bytes


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=8)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(documents(spark, sf_dir, "doc_id", "text")), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return dedup_lines(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spread(documents(spark, sf_dir, "doc_id", "text"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spread(documents(spark, sf_dir, "doc_id", "text")), tokenizer_file("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return identify(spread(docs), model=fit(docs))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_simhash(spread(documents(spark, sf_dir, "doc_id", "text")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_suffix_dedup, op4_packing, op5_line_dedup, op6_quality_rules, op7_bpe, op8_language_id, op9_simhash_near_dedup, op10_embedding_near_dedup)}
ORACLE_SQL = {"op2_substring_dedup": SUBSTRINGS_SQL, "op5_line_dedup": LINES_SQL, "op6_quality_rules": QUALITY_SQL, "op10_embedding_near_dedup": EMBEDDINGS_SQL}
