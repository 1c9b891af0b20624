"""Rows that break a constraint, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def check_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which a condition is false; as in SQL, an unknown one passes."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(c, F.lit(True)))


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that more than one row has; keys with a null are skipped."""
    whole = df.dropna(subset=list(columns))
    return whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose foreign key has no parent; null keys are skipped."""
    keys = parent.select(F.col(parent_column).alias("_parent_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent_key"), "left_anti")
