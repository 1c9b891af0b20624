"""Token counts by a two-tier lookup inside the map tasks.

First tier: a compact table of the lengths of frequent pre-tokens, broadcast.
Each task of a pass over all texts sums up its most frequent pre-tokens (a list
bounded by ``per_task``); the sums are merged and the ``table_size`` most frequent
kept. Second tier: what misses the table is encoded once per worker and cached,
with a bound. No pre-token of the corpus is shuffled, only the tasks' summaries.
The table decides only where a length comes from, never the count.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays
null; repeated rows are counted each; an empty table gives an empty result;
extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.bpe import opened
from brindle.llm.worker import stage_cache

#: Bounds of the broadcast table: entries, and characters of an entry.
TABLE_SIZE, LONGEST_ENTRY = 32_768, 32
_HELD_UNITS = 200_000


def _summaries(vocabulary: str, per_task: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(vocabulary)
        units: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    units.update(tokenizer.units(text))
                    if len(units) > 2 * _HELD_UNITS:  # keep the frequent half
                        units = Counter(dict(units.most_common(_HELD_UNITS)))
        pieces: Counter[str] = Counter()
        for unit, n in units.items():
            for piece in tokenizer.pieces(unit):
                if len(piece) <= LONGEST_ENTRY:
                    pieces[piece] += n
        top = heapq.nlargest(per_task, pieces.items(), key=lambda x: (x[1], x[0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"]
        )

    return run


def frequent_pieces(docs: DataFrame, vocabulary: str, table_size: int = TABLE_SIZE, per_task: int = TABLE_SIZE // 4) -> DataFrame:
    """The most frequent pre-tokens of all texts by the tasks' summaries: (piece, n), ``table_size`` rows at most."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_summaries(vocabulary, per_task), "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size)


def packed_table(lengths: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Keys in one blob, where each ends, and the lengths: about 15 bytes an entry."""
    keys = [k.encode() for k in lengths]
    return b"".join(keys), np.cumsum([len(k) for k in keys], dtype=np.uint32), np.array(list(lengths.values()), np.uint8)


def unpacked_table(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, lengths = table
    starts = [0, *ends[:-1].tolist()] if len(ends) else []
    return {blob[a:b].decode(): n for a, b, n in zip(starts, ends.tolist(), lengths.tolist(), strict=True)}


def _counter(vocabulary: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(vocabulary)
        held = stage_cache()
        if "known" not in held:
            held["known"] = unpacked_table(table.value)
        tokenizer.known = held["known"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array([tokenizer.count(t) if t else 0 for t in texts], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str, context: int = 1024, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``context`` tokens) of every document."""
    spark = docs.sparkSession
    tokenizer = opened(vocabulary)
    pieces = [r.piece for r in frequent_pieces(docs, vocabulary, min(table_size, TABLE_SIZE)).collect()] if tokenizer.plain else []
    lengths = {p: len(tokenizer._tokens(p)) for p in pieces}
    table = spark.sparkContext.broadcast(packed_table({p: n for p, n in lengths.items() if n < 256}))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = narrow.mapInArrow(_counter(vocabulary, table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > context)
