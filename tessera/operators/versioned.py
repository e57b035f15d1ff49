"""Versioned tables: every row has an epoch; odd epochs are tombstones of the row they follow.

Components (batches of rows, newest first) are merged into views by one union and one shuffle on the
row's identity. The identity of a version is its columns without the epoch; a version's rank is its component.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .keyed import page_in_order

EPOCH = "epoch"


def epoch_of(transaction: str | Column, tombstone: bool | Column = False) -> Column:
    """Transaction number to epoch: twice it, and one more for a tombstone."""
    flag = tombstone.cast("long") if isinstance(tombstone, Column) else F.lit(int(tombstone))
    return (F.col(transaction) if isinstance(transaction, str) else transaction) * 2 + flag


def is_tombstone(epoch: str | Column = EPOCH) -> Column:
    return (F.col(epoch) if isinstance(epoch, str) else epoch).bitwiseAND(1) == 1


def ranked(components: Sequence[DataFrame]) -> DataFrame:
    """All components' rows with ``component``: 0 is the newest."""
    return reduce(DataFrame.unionByName, [c.withColumn("component", F.lit(k)) for k, c in enumerate(components)])


def merged(components: Sequence[DataFrame]) -> DataFrame:
    """Rows of all components, each distinct row once."""
    return reduce(DataFrame.unionByName, components).distinct()


def newest(components: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """For each key the row of the newest component that has it."""
    rows = ranked(components)
    columns = [c for c in rows.columns if c != "component"]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct("component", *[c for c in columns if c not in key])).alias("_row"))
    return best.select("_row.*")


def count_merged(components: Sequence[DataFrame]) -> DataFrame:
    """The number of distinct rows over all components; tombstones count."""
    return merged(components).agg(F.count(F.lit(1)).alias("n"))


def garbage_collected(df: DataFrame, horizon: int, epoch: str = EPOCH, snapshots: bool = False) -> DataFrame:
    """Versions that readers may still need.

    Kept: every version at or after the horizon, and a row's newest version before it if that is its newest of all and no
    tombstone. With ``snapshots`` the newest version before the horizon stays although newer ones follow.
    """
    identity = [c for c in df.columns if c != epoch]
    w = Window.partitionBy(*identity)
    old = F.when(F.col(epoch) < horizon, F.col(epoch)) if snapshots else F.col(epoch)
    kept = df.withColumn("_newest", F.max(old).over(w))
    return kept.where((F.col(epoch) >= horizon) | (F.col(epoch) == F.col("_newest")) & ~is_tombstone(epoch)).select(*df.columns)


def snapshot(df: DataFrame, key: Sequence[str], at: int | None = None, epoch: str = EPOCH) -> DataFrame:
    """Each key's newest version at an epoch (or at all); keys whose newest version is a tombstone are gone."""
    seen = df if at is None else df.where(F.col(epoch) <= at)
    if set(df.columns) == {*key, epoch}:  # nothing to carry along: plain maxima, without sorting
        return seen.groupBy(*key).agg(F.max(epoch).alias(epoch)).where(~is_tombstone(epoch)).select(*df.columns)
    newest_row = seen.groupBy(*key).agg(F.max_by(F.struct(*df.columns), epoch).alias("_row"))
    return newest_row.select("_row.*").where(~is_tombstone(epoch))


def find(components: Sequence[DataFrame], probe: DataFrame) -> DataFrame:
    """Rows of ``probe`` that some component has, in all columns, with the newest such component."""
    columns = probe.columns
    hits = ranked(components).join(probe.distinct(), columns, "left_semi")
    return hits.groupBy(*columns).agg(F.min("component").alias("component"))


def find_from(components: Sequence[DataFrame], columns: Sequence[str], start: Sequence) -> DataFrame:
    """Distinct rows of all components at or after a row in the order of ``columns``."""
    least = F.struct(*[F.lit(v).cast(components[0].schema[c].dataType).alias(c) for c, v in zip(columns, start, strict=True)])
    return merged([c.where(F.struct(*columns) >= least) for c in components])


def floor_page(pages: DataFrame, key: str, value) -> DataFrame:
    """The page whose first key is the last one at or before the value."""
    return pages.where(F.col(key) <= value).agg(F.max_by(F.struct(*pages.columns), key).alias("_row")).where("_row is not null").select("_row.*")


def op_stream(ops: DataFrame, mode: str, transaction: str, columns: Sequence[str], last: str) -> DataFrame:
    """Versions that a stream of operations writes.

    add: the row at twice its transaction; delete: the row as a tombstone; deliver: the row at its
    transaction as told, and a tombstone of the row with 0 in its last column; others: nothing.
    """
    row = lambda epoch, **changed: F.struct(*[changed.get(c, F.col(c)).cast(ops.schema[c].dataType).alias(c) for c in columns], epoch.alias(EPOCH))
    told, even, odd = F.col(transaction), epoch_of(transaction), epoch_of(transaction, True)
    rows = F.when(F.col(mode) == "add", F.array(row(even))).when(F.col(mode) == "delete", F.array(row(odd))).when(F.col(mode) == "deliver", F.array(row(told), row(odd, **{last: F.lit(0)})))
    return ops.select(F.explode(rows).alias("_row")).select("_row.*")


def horizons(ops: DataFrame, mode: str, transaction: str) -> DataFrame:
    """For each transaction the horizon that holds once it starts: the epoch of the one before."""
    first = ops.groupBy(transaction).agg(F.min_by(mode, F.col(mode)).alias("mode"))
    return first.select(transaction, epoch_of(F.col(transaction) - 1, F.col("mode") != "add").alias("horizon"))


def advanced(old: int, new: int) -> int:
    """The horizon moves forward only."""
    if new < old:
        raise ValueError(f"the horizon {old} cannot move back to {new}")
    return new


def write_component(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A component as Parquet files, each sorted, so that ranges prune row groups."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def write_encoded(df: DataFrame, path: str, order: Sequence[str], dictionary: Sequence[str] = (), bloom: Sequence[str] = ()) -> None:
    """A sorted component with encodings chosen by column: dictionaries for the named ones, delta encodings for other
    whole numbers, and Bloom filters for columns that are looked up by value."""
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    for c in dictionary:
        writer = writer.option(f"parquet.enable.dictionary#{c}", "true")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def compression(spark, path: str) -> DataFrame:
    """rows of a folder, told (their bytes as text), stored (bytes of the files, by the listing), and ratio."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    stored = folder.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    df = spark.read.parquet(path)
    told = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns])
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(told), F.lit(0)).alias("told"))
    return out.withColumn("stored", F.lit(stored).cast("long")).withColumn("ratio", F.col("told") / F.col("stored"))


def log_dump(log: DataFrame, order: str, rows: int = 100, after=None) -> DataFrame:
    """A page of a log as text, in order: place and entry."""
    page = page_in_order(log, [order], None if after is None else [after], rows)
    return page.select(order, F.to_json(F.struct(*[c for c in log.columns if c != order])).alias("entry"))


def component_sizes(df: DataFrame) -> DataFrame:
    """Rows and files behind a component's folder."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
