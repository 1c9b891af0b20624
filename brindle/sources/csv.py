"""CSV in and out: quoted fields with doubled quotes and line breaks, a header, all columns read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.types import LogicalType

_OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def plain_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line is surely a row: where a quoted field goes on, its first line has an odd number of quotes.
    Carriage returns and lines of blanks alone, which the readers take differently, count as doubt."""
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return spark.read.text(path, lineSep="\n").where(odd | line.contains("\r") | line.rlike(r"^\s+$")).isEmpty()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; a row with too many or too few fields fails the read. Files of plain lines are split
    among tasks, others are read by one task each."""
    options = _OPTIONS | {"multiLine": not plain_lines(spark, path)}
    header = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c.lstrip("﻿"), T.StringType()) for c in header])
    return spark.read.options(**options).schema(schema).csv(path)


def files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The CSV files of a folder: the name before the ending, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.csv")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((f.getPath().getName()[:-4], f.getPath().toString()) for f in found or [])


def infer_types(texts: DataFrame) -> dict[str, LogicalType]:
    """INT where every non-empty value is an integer, VARCHAR(255) elsewhere; one pass over the data."""
    whole = [F.coalesce(F.every(F.trim(F.col(f"`{c}`")).rlike(r"^[+-]?\d+$") | (F.col(f"`{c}`") == "")), F.lit(True)) for c in texts.columns]
    row = texts.agg(*[w.alias(f"c{k}") for k, w in enumerate(whole)]).first()
    return {c: LogicalType("INT") if row[k] else LogicalType("VARCHAR", 255) for k, c in enumerate(texts.columns)}


def write_text(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; null becomes the empty text."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    df.select(*columns).write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)
