"""Prefix doubling over every position, as plain DataFrames: the form that op3 departs from, kept for its figures and as a second opinion.

    python -m tests.llm.plain_doubling FOLDER     prints the rounds' rows, and what they shuffle against the text's bytes
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, functions as F

DOC = 1 << 40  # positions of a document: its id times this, and the offset


def ranked(pairs: DataFrame) -> DataFrame:
    """(pos, rank) of positions whose (left, right) occurs again: the rank is the class's least position. Unique ones drop out."""
    classes = pairs.groupBy("left", "right").agg(F.min("pos").alias("rank"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return pairs.join(classes, ["left", "right"]).select("pos", "rank")


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks of positions and of those ``step`` further on, where both occur again."""
    ahead = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("right"))
    return ranked(ranks.withColumnRenamed("rank", "left").join(ahead, "pos"))


def repeated_positions(docs: DataFrame, length: int, settle=lambda df, name: df) -> DataFrame:
    """Positions (pos) at which a string of ``length`` bytes starts that also starts elsewhere. docs: distinct non-negative doc_id, text."""
    digits = F.hex(F.col("text").cast("binary"))
    at = docs.where("length(text) > 0").select((F.col("doc_id") * DOC).alias("_first"), F.posexplode(F.regexp_extract_all(digits, F.lit("(..)"), 1)).alias("_k", "_byte"))
    ranks = settle(at.select((F.col("_first") + F.col("_k")).alias("pos"), F.conv("_byte", 16, 10).cast("long").alias("rank")), "bytes")
    span = 1
    while 2 * span <= length:
        ranks = settle(doubled(ranks, span), f"{2 * span}")
        span *= 2
    return settle(doubled(ranks, length - span), f"{length}").select("pos") if span < length else ranks.select("pos")


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "64").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setCheckpointDir("/tmp/plain-doubling")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = shuffled()

    def settle(df: DataFrame, name: str) -> DataFrame:
        out = df.checkpoint()
        print(f"length {name}: {out.count()} positions, {(shuffled() - before) / size:.1f} bytes shuffled so far a byte of text", flush=True)
        return out

    repeated_positions(docs, 200, settle)


if __name__ == "__main__":
    main(sys.argv[1])
