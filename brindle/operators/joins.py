"""Joins beyond what a single DataFrame call says: qualified output, subquery forms, physical hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's hints by the name of the algorithm they ask for.
HINTS = {"merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}


def qualified(*parts: tuple[str, DataFrame]) -> list[Column]:
    """All columns of the aliased inputs of a join, left to right, each named alias_column."""
    return [df[f"{name}.{c}"].alias(f"{name}_{c}") for name, df in parts for c in df.columns]


def join_star(left: DataFrame, right: DataFrame, names: tuple[str, str], on: Column | None, how: str = "inner") -> DataFrame:
    """``SELECT *`` over a join: aliased inputs, every column qualified."""
    a, b = left.alias(names[0]), right.alias(names[1])
    joined = a.crossJoin(b) if on is None else a.join(b, on, how)
    return joined.select(*qualified((names[0], a), (names[1], b)))


def joined(left: DataFrame, right: DataFrame, on: Column, how: str, semantics: str = "ansi") -> DataFrame:
    """A join; under compat a right join keeps the left rows without a match too."""
    return left.join(right, on, "full" if how == "right" and semantics == "compat" else how)


def hinted(left: DataFrame, right: DataFrame, on: Column, algorithm: str, how: str = "inner") -> DataFrame:
    """A join by a named algorithm; without a hint Spark chooses by size."""
    return left.join(right.hint(HINTS[algorithm]), on, how)


def exists_in(outer: DataFrame, inner: DataFrame, on: Column) -> DataFrame:
    """EXISTS, or IN over a subquery: rows of ``outer`` with a match."""
    return outer.join(inner, on, "left_semi")


def not_exists_in(outer: DataFrame, inner: DataFrame, on: Column) -> DataFrame:
    """NOT EXISTS, or NOT IN in two-valued logic: rows of ``outer`` without a match, nulls included."""
    return outer.join(inner, on, "left_anti")


#: Rows of one key, of each side, that meet in one tile; pairs that are worth a task of their own.
TILE, TASK_PAIRS = 4_000, 1_000_000


def tiled(left: DataFrame, right: DataFrame, keys: tuple[str, str], on: Column) -> DataFrame:
    """Inner join on a key of few values, and ``on``: work that grows with the pairs of a key, not with the bytes read.

    The rows of a key are cut into parts of about TILE rows on both sides, and each pair of parts, a tile, is a group of
    the shuffle. So there are as many tasks as the pairs ask for, a task holds one part at a time, and a key of most
    rows is spread as others are. The names of all columns must differ. One job counts the rows of the keys first.
    """
    a, b = keys
    tally = lambda df, key, n: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(n))
    parts = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    loads = tally(left, a, "n").join(tally(right, b, "m"), "key").select("key", (F.col("n") * F.col("m")).alias("pairs"), parts("n").alias("rows"), parts("m").alias("columns"))
    pairs, tiles = loads.agg(F.sum("pairs"), F.sum(F.col("rows").cast("long") * F.col("columns"))).first()
    tasks = int(min(tiles or 1, -(-(pairs or 1) // TASK_PAIRS), 100_000))

    def dealt(df: DataFrame, key: str, names: tuple[str, str], own: str, other: str) -> DataFrame:
        """Each row with its own part, drawn from its columns, once for each part of the other side."""
        known = df.join(loads.select(F.col("key").alias(key), F.col(own).alias("own"), F.col(other).alias("other")), key)
        part = F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.col("own")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col("other") - 1))
        return known.select(*df.columns, part.alias(names[0]), copies.alias(names[1])).repartition(tasks, key, *names)

    names = ("_row", "_column")
    x = dealt(left, a, names, "rows", "columns")
    y = dealt(right, b, names[::-1], "columns", "rows").withColumnsRenamed({n: f"{n}_" for n in names})
    same = (F.col(a) == F.col(b)) & (F.col("_row") == F.col("_row_")) & (F.col("_column") == F.col("_column_"))
    return x.hint("shuffle_hash").join(y, same & on).drop(*names, *[f"{n}_" for n in names])
