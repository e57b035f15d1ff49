"""Streams of keyed rows: routing to queues, and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import floor_div, raw_crc


def queue_of(key: str, queues: int, by_crc: bool = True) -> Column:
    """The queue of a key: its checksum, or the number itself, modulo the number of queues."""
    return F.pmod(raw_crc(F.col(key)), F.lit(queues)) if by_crc else F.pmod(F.col(key), F.lit(queues))


def multiplex(df: DataFrame, key: str, queues: int, by_crc: bool = True) -> DataFrame:
    """df with ``queue``, dealt so that a queue's rows are in one partition."""
    return df.withColumn("queue", queue_of(key, queues, by_crc)).repartition(queues, "queue")


def queue_counts(df: DataFrame, key: str, queues: int, by_crc: bool = True) -> DataFrame:
    """Rows of each queue; counted before anything is shuffled."""
    return df.groupBy(queue_of(key, queues, by_crc).alias("queue")).agg(F.count(F.lit(1)).alias("n"))


def group_collect(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its values, sorted. Values of a key form one row: for unbounded groups use group_flat."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def group_flat(df: DataFrame, key: str) -> DataFrame:
    """Rows clustered by key; nothing is gathered, so groups may have any size."""
    return df.repartition(key).sortWithinPartitions(key)


def distinct_groups(df: DataFrame, key: str) -> DataFrame:
    """How many groups there are, and how many rows in them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def previous_in_transaction(log: DataFrame, transaction: str, lsn: str) -> DataFrame:
    """Log records with the number of the one before in their transaction."""
    from pyspark.sql import Window

    return log.withColumn("prev_" + lsn, F.lag(lsn).over(Window.partitionBy(transaction).orderBy(lsn)))


def group_apply(df: DataFrame, key: str, apply, schema) -> DataFrame:
    """A function of each group's rows (pandas in, pandas out); a group must fit a task's memory."""
    return df.groupBy(key).applyInPandas(apply, schema)


def by_page(key: str, rows: int) -> Column:
    """A queue expression: the page a key is in."""
    return floor_div(F.col(key), rows)


def by_operation_key(operation: str, kinds: tuple[str, ...], key: str) -> Column:
    """A queue expression: the checksum of a logged operation's key; other kinds of operations are an error."""
    wrong = F.raise_error(F.concat(F.lit("no keyed operation: "), F.col(operation)))
    return F.when(F.col(operation).isin(*kinds), raw_crc(F.col(key))).otherwise(wrong.cast("long"))


def routed(df: DataFrame, queue: Column, queues: int) -> DataFrame:
    """Rows dealt to queues by any expression."""
    return df.withColumn("queue", F.pmod(queue, F.lit(queues))).repartition(queues, "queue")
