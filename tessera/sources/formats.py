"""Sources and sinks: operation streams, key-value files, tuple text, generated workloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import calendar_add, retail_price, tuple_text

#: The columns of an operation stream, in file order.
OP_COLUMNS = "mode string, order long, partkey int, partprice int, quantity int, totalprice long, week int, day int, year int, src_nation int, cust_nation int, status int"


def read_op_stream(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV without a header; ``columns`` picks and reorders."""
    df = spark.read.csv(path, schema=OP_COLUMNS, mode="FAILFAST")
    return df.select(*columns) if columns else df


def read_int_csv(spark: SparkSession, path: str, width: int, pick: Sequence[int]) -> DataFrame:
    """Columns of whole numbers, some of them in a new order: c0, c1, ..."""
    df = spark.read.csv(path, schema=", ".join(f"_{k} long" for k in range(width)))
    return df.select(*[F.col(f"_{k}").alias(f"c{n}") for n, k in enumerate(pick)])


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated keys and values; of a key's rows any one may be looked up, so load them through upsert for one."""
    return spark.read.csv(path, sep="\t", schema="key string, value string", quote="")


def segment(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """Bytes of files: path and the part from ``offset`` (from 0)."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", offset + 1, length).alias("content"))


def tuple_lines(df: DataFrame) -> DataFrame:
    """Rows as the text (a,b,c)."""
    return df.select(tuple_text(*df.columns).alias("value"))


def write_tuples(df: DataFrame, path: str) -> None:
    tuple_lines(df).write.text(path)


def encoded(df: DataFrame) -> DataFrame:
    """Rows as JSON text, from which decoded() restores them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def decoded(df: DataFrame, schema) -> DataFrame:
    return df.select(F.from_json("value", schema).alias("_row")).select("_row.*")


def key_value_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """A key and a struct as one flat row."""
    return df.select(key, f"{value}.*")


def random_numbers(spark: SparkSession, rows: int, below: int, seed: int = 0) -> DataFrame:
    """(id, n): evenly spread numbers that follow from the row's number and the seed, so that any task can make them again."""
    return spark.range(rows).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(below)).alias("n"))


def generated_ops(spark: SparkSession, orders: int, parts: int = 200_000, nations: int = 25, seed: int = 0) -> DataFrame:
    """Operations of so many orders: each is added; about 1 % are deleted, the others delivered 1 to 14 days later; half are asked about.

    Every row comes from its order's number and the seed, so any partition can be made again alone.
    """
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).cast("int")
    placed = spark.range(orders).select(
        F.col("id").alias("order"), draw(1, parts).alias("partkey"), (draw(2, 50) + 1).alias("quantity"), draw(3, 52).alias("week"), draw(4, 7).alias("day"), (draw(5, 7) + 1992).alias("year"),
        draw(6, nations).alias("src_nation"), draw(7, nations).alias("cust_nation"), draw(8, 100).alias("_fate"), (draw(9, 14) + 1).alias("_days"), draw(10, 2).alias("_asked"),
    )
    placed = placed.withColumn("partprice", retail_price(F.col("partkey")).cast("int")).withColumn("totalprice", (F.col("partprice") * F.col("quantity")).cast("long"))
    later = calendar_add(F.col("year"), F.col("week"), F.col("day"), F.col("_days"))
    op = lambda mode, at, status: F.struct(F.lit(mode).alias("mode"), at["year"].cast("int").alias("year"), at["week"].cast("int").alias("week"), at["day"].cast("int").alias("day"), F.lit(status).alias("status"))
    now = F.struct("year", "week", "day")
    ops = F.array_compact(F.array(op("add", now, 1), F.when(F.col("_asked") == 1, op("status", now, 1)), F.when(F.col("_fate") == 0, op("delete", later, 1)).otherwise(op("deliver", later, 1))))
    rows = placed.drop("status").withColumn("_op", F.explode(ops))
    taken = {"mode", "year", "week", "day", "status"}
    return rows.select(*[F.col(f"_op.{c}").alias(c) if c in taken else F.col(c) for c in [f.split()[0] for f in OP_COLUMNS.split(", ")]])
