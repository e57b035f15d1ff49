"""What the operators of this subpackage share: checkpoints, sizes, and column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of bytes other than these; bytes.split() without arguments cuts at the same ones.
SPACE = " \\t\\n\\x0b\\f\\r"
WORD_GAP = f"[{SPACE}]+"


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; set one of our own only in local mode where none is named (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder: later jobs reread it, and its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, dealt to all cores where its scan has fewer partitions; for work that costs more than a shuffle of its rows."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def utf8(column: str | Column) -> Column:
    """The text's UTF-8 bytes; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Sum of the UTF-8 bytes of a column; one number comes back to the driver."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def plain_id(column: str = "doc_id") -> Column:
    return F.col(column).cast("long").alias(column)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read back; for whole documents, which checkpoint() would store uncompressed."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def named(column: str) -> Column:
    """A column by its exact name, which may hold dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def apart(columns: list[str], taken: list[str]) -> list[str]:
    """Those of the columns that Spark can tell from all taken names, which it compares without regard to case."""
    low = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in low]


def row_of(docs: DataFrame) -> Column:
    """A row as one column ``_row``, with fields c0, c1, ...: so that no name of a user's column meets one of an operator's."""
    return F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_row")


def field(docs: DataFrame, column: str, row: str = "_row") -> Column:
    """One of docs' columns out of ``_row``."""
    return F.col(row).getField(f"c{place(docs, column)}")


def place(docs: DataFrame, column: str) -> int:
    return [c.lower() for c in docs.columns].index(column.lower())


def flattened(found: DataFrame, docs: DataFrame) -> DataFrame:
    """From (_row, _found): docs' columns, then the results; a column of docs with a result's name gives way."""
    results = found.schema["_found"].dataType.names
    return found.select(*[field(docs, c).alias(c) for c in apart(docs.columns, results)], *[F.col("_found").getField(r).alias(r) for r in results])


def with_text(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """From (_row, _found): docs' columns with a new text and, where there is one, its length in n_chars; all others as they were."""
    changed = {"text": text}
    if "n_chars" in (c.lower() for c in docs.columns):
        changed["n_chars"] = F.when(text.isNull(), field(docs, "n_chars")).otherwise(F.length(text)).cast(docs.schema[place(docs, "n_chars")].dataType)
    return found.select(*[changed.get(c.lower(), field(docs, c)).alias(c) for c in docs.columns])
