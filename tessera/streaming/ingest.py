"""Streams of versions into a versioned table: append, compact, and read.

A table is a folder of component folders. Every micro-batch becomes a component, named by its number, so
that a batch that is run again replaces its own component and nothing else. Compaction merges components into one
under a horizon, by hand or when small ones have grown past their share. Readers merge what is there; versions are the same
wherever they lie, so a reader meets no change while a merged component and its sources are both there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import one_per_key, without_keys
from ..operators.versioned import EPOCH, advanced, garbage_collected, snapshot


def ordered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


class VersionedFolder:
    def __init__(self, spark: SparkSession, path: str, order: Sequence[str]) -> None:
        self.spark, self.path, self.order, self.horizon = spark, path.rstrip("/"), list(order), 0

    def append(self, batch: DataFrame, number: int) -> None:
        """Writes a component; running the same number again replaces it."""
        rows = batch.distinct()
        ordered(rows, self.order).write.mode("overwrite").parquet(f"{self.path}/component={number}")

    def components(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/component=*")

    def rows(self) -> DataFrame:
        """All versions, each once."""
        return self.components().drop("component").distinct()

    def compacted(self, horizon: int) -> DataFrame:
        """What a compaction at the horizon leaves."""
        return garbage_collected(self.rows(), horizon)

    def sizes(self) -> dict[int, int]:
        """Bytes of each component, by its number; a listing of folders."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not store.exists(path):
            return {}
        folders = [s.getPath() for s in store.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("component=")]
        return {int(f.getName().split("=")[1]): store.getContentSummary(f).getLength() for f in folders}

    def due(self) -> bool:
        """Whether the components besides the largest hold more than 1 / R of it, where R is the root of its size over theirs on average (2 at least)."""
        sizes = sorted(self.sizes().values())
        small, large = sizes[:-1], sizes[-1] if sizes else 0
        return bool(small) and sum(small) * max(2.0, math.sqrt(large * len(small) / max(1, sum(small)))) > large

    def maintain(self, horizon: int) -> bool:
        """Merges all components if that is due; tells whether it was. Sources go from the oldest on, so that a tombstone outlives what it hides."""
        if not self.due():
            return False
        self.horizon = advanced(self.horizon, horizon)
        sources = sorted(self.sizes())
        merged = f"{self.path}/merging"
        ordered(self.compacted(self.horizon), self.order).write.mode("overwrite").parquet(merged)
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        store = path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        store.rename(path(merged), path(f"{self.path}/component={-1 - max(map(abs, sources))}"))
        for number in sources:
            store.delete(path(f"{self.path}/component={number}"), True)
        return True

    def compact_to(self, path: str, horizon: int) -> VersionedFolder:
        """Writes the compacted table to another folder; readers move over when it is complete."""
        out = VersionedFolder(self.spark, path, self.order)
        out.append(self.compacted(horizon), 0)
        return out

    def read(self, key: Sequence[str], at: int | None = None) -> DataFrame:
        return snapshot(self.rows(), key, at)


def ingest(stream: DataFrame, table: VersionedFolder, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True, horizon: int | None = None) -> StreamingQuery:
    """Starts writing a stream of versions into the table, one component a micro-batch; with a horizon, merges when that is due."""

    def write(batch: DataFrame, number: int) -> None:
        table.append(transform(batch) if transform else batch, number)
        if horizon is not None:
            table.maintain(horizon)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_folder(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the number of files a batch bounds what is under way."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stream_net_counts(stream: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """A streaming aggregation whose state is each value's net count; minima are taken when it is read."""
    return stream.groupBy(*by, value).agg(F.sum(weight).alias("n"))


def stream_queues(stream: DataFrame, queue) -> DataFrame:
    """Rows a queue has received so far."""
    return stream.groupBy(queue.alias("queue")).agg(F.count(F.lit(1)).alias("n"))


def newest_in_stream(stream: DataFrame, key: Sequence[str], epoch: str = EPOCH) -> DataFrame:
    """A streaming aggregation that keeps each key's newest version (tombstones included)."""
    return stream.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), epoch).alias("row")).select("row.*")


def apply_changes(stream: DataFrame, path: str, key: str, order: str, removed: str, checkpoint: str) -> StreamingQuery:
    """A keyed table kept by a stream of changes: each micro-batch makes a new snapshot folder of it under ``path``.

    Of a key's changes in a batch the last by ``order`` counts; where ``removed`` is true the key goes. A batch that is run
    again starts from the snapshot before it, so it makes the same one again.
    """
    spark, columns = stream.sparkSession, [c for c in stream.columns if c not in (order, removed)]

    def write(batch: DataFrame, number: int) -> None:
        last = one_per_key(batch, key, order)
        old = spark.read.parquet(f"{path}/snapshot={number - 1}") if number else batch.select(*columns).limit(0)
        new = without_keys(old, last, key).unionByName(last.where(~F.col(removed)).select(*columns))
        new.write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    numbers = [int(s.getPath().getName().split("=")[1]) for s in store.listStatus(folder) if s.getPath().getName().startswith("snapshot=")]
    return spark.read.parquet(f"{path}/snapshot={max(numbers)}")
