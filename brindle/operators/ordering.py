"""Sorting, top rows and distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_key(df: DataFrame, column: str, ascending: bool = True) -> Column:
    """A sort key with nulls where the empty text would sort: after numbers, before other texts."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    c = F.col(column)
    if ascending:
        return c.asc_nulls_first() if text else c.asc_nulls_last()
    return c.desc_nulls_last() if text else c.desc_nulls_first()


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """ORDER BY with LIMIT, planned as one partial top-n a task."""
    return df.orderBy(*keys).limit(n)


def distinct_ordered(df: DataFrame, columns: list[str], key: str, ascending: bool = True) -> DataFrame:
    """Distinct rows of ``columns`` by the first place of each in the order of another column."""
    first = (F.min if ascending else F.max)(key).alias("_place")
    grouped = df.groupBy(*columns).agg(first)
    return grouped.orderBy(F.col("_place").asc() if ascending else F.col("_place").desc()).drop("_place")


def limit_then_distinct(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """DISTINCT over the first n rows (compat order of the two)."""
    return top(df, n, *keys).distinct()
