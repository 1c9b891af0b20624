"""Helpers shared by the training-data operators: scratch tables and token patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import shared_dir

#: Words of the licence and decontamination contracts: runs of digits, a-z and
#: everything beyond ASCII, after A-Z was lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are, below the shared folder."""
    return f"{shared_dir(spark)}/brindle/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were not written elsewhere go with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows is recomputed from the written table if
    executors are lost, and every row was committed by exactly one task attempt.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` as a bucketed table in the shared folder and read it back, so that joins and groups by ``keys`` need
    not shuffle it. The catalog's entry goes again: the table read keeps its files and buckets."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"brindle_{path.rpartition('/')[2].replace('-', '_')}"
    df.write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return read


#: Texts that Spark hands to a Python worker at once. At Spark's 10,000 a batch is a whole file split of texts, which is
#: held by both the executor and the worker, in several buffers each.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """From now on batches have BATCH_ROWS rows, if not fewer. What a batch holds is no matter to any operator."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def unused_name(df: DataFrame) -> str:
    """A name that no column of the table starts with, whatever its case."""
    name = "_brindle"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def parallel_tasks(spark: SparkSession) -> int:
    """How many partitions a shuffle has at least."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
