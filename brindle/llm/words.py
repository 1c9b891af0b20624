"""Words of texts as rows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import WORD_PATTERN, ascii_lower

#: Stands before the first word of every text; no word can hold it.
SENTINEL = "\x00"


def words(text: Column) -> Column:
    """Words of a text in order: A-Z lower-cased, runs of digits, letters and non-ASCII characters; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD_PATTERN), 0)


def word_rows(df: DataFrame, text: str, *keep: str, whole: bool = False) -> DataFrame:
    """Rows (row, *keep, n_words, pos, a, b, c): each word with the two that follow it.

    Position 0 is the sentinel, so that a text without words has one row too; words
    count from 1. ``row`` tells repeated rows and null keys apart. ``whole`` adds w,
    the sentinel and all words: for a broadcast join right behind, where generated
    code passes it on without a copy.
    """
    listed = df.select(F.monotonically_increasing_id().alias("row"), *keep, words(F.col(text)).alias("w"))
    listed = listed.select("row", *keep, F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit(SENTINEL)), "w").alias("w"))
    size = F.col("n_words").cast("int") + 1
    zipped = F.arrays_zip("w", F.slice("w", F.lit(2), size).alias("x"), F.slice("w", F.lit(3), size).alias("y"))
    also = ["w"] if whole else []
    rows = listed.select("row", *keep, *also, "n_words", F.posexplode(zipped).alias("pos", "z"))
    return rows.select(
        "row", *keep, *also, "n_words", F.col("pos").cast("long").alias("pos"),
        F.col("z").getField("w").alias("a"), F.col("z").getField("x").alias("b"), F.col("z").getField("y").alias("c"),
    )
