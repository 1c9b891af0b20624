"""A membership filter of fixed size, and a split of rows by it that moves none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (4 MB when broadcast). More keys make more false positives, never wrong results.
FILTER_BITS, _BLOCKS = 1 << 25, 512


def _bits(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(FILTER_BITS // _BLOCKS, bool)
    for t in tables:
        bits[t["bit"].to_numpy()] = True
    yield pd.DataFrame({"block": [int(key[0])], "bits": [np.packbits(bits).tobytes()]})


def key_filter(keys: DataFrame, key: str):
    """Broadcast bits: which remainders of the long column ``key`` modulo FILTER_BITS occur."""
    # FILTER_BITS divides 2**64, so pmod is the remainder of the unsigned value too.
    each = keys.where(F.col(key).isNotNull()).select(F.pmod(F.col(key), F.lit(FILTER_BITS)).alias("at")).distinct()
    wide = FILTER_BITS // _BLOCKS
    each = each.select(F.floor(F.col("at") / wide).cast("int").alias("block"), (F.col("at") % wide).cast("int").alias("bit"))
    bits = np.zeros((_BLOCKS, wide // 8), np.uint8)
    for r in each.groupBy("block").applyInPandas(_bits, "block int, bits binary").collect():  # FILTER_BITS / 8 bytes
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.ravel())


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (unsigned) may be in the filter."""
    at = (keys % np.uint64(FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def split_rows(df: DataFrame, key: Column, filter_bits) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not in the filter, and the others. A null key is not in it."""

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        found = holds(filter_bits.value, keys.fillna(0).astype("int64").to_numpy().view(np.uint64))
        return pd.Series(found & keys.notna().to_numpy())

    return df.where(~may(key)), df.where(may(key))
