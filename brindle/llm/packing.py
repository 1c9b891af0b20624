"""Best-fit packing by exact-complement hashing.

Documents become token ids and one end id; only those longer than a sequence are
cut, their first piece being the shorter one. Full pieces are sequences by
themselves. For all others only the histogram of lengths (as many numbers as a
sequence has tokens) reaches the driver, which plans patterns with multiplicities:

* sums of pairs and of triples of the lengths there are have hash indexes (a triple
  is its longest member and the sum of a pair), and from the longest length down the
  gap is looked up: a single length, then pairs, then triples that fill it exactly
  are consumed as often as every member is still available;
* what is left goes best fit: the longest piece that still fits.

A pattern uses up at least one length, so there are few patterns. A piece's rank
among those of its length (task base + rank inside the task) then tells its slot,
which each task looks up by itself.

Defined cases: a null or empty text is the end id alone; equal texts are packed
each; a null id stays null; an empty table gives an empty result; extra columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.bpe import opened
from brindle.llm.common import materialize, small_batches

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def _cut(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = opened(vocabulary), end_id.to_bytes(4, "little")
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.packed_ids(text.as_py() or "") + end
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    n = ((total - 1) % capacity + 1) if start == 0 else capacity
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), task, seen[n]))
                    seen[n] += 1
                    start, piece = start + n, piece + 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PIECES.split(", ")])

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents, with their rank among the pieces of that length in their task."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_cut(vocabulary, capacity, end_id), _PIECES)


#: Rows (length, task, base) that may be broadcast: 24 bytes each.
MAX_BROADCAST = 500_000


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of place, how many sequences) that hold all pieces of ``counts``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        kinds, need = np.unique(lengths, return_counts=True)
        times = int((left[kinds] // need).min())
        if times:
            left[kinds] -= times * need
            patterns.append((lengths, times))

    if left[capacity]:
        take((capacity,))
    index = SumIndex(np.flatnonzero(left[:capacity]), capacity)
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        if left[longest]:
            take((longest, gap))
        for others in (index.pairs, index.triples):
            if not left[longest]:
                break
            for members in others(gap, longest, left):
                take((longest, *members))
                if not left[longest]:
                    break
    _best_fit(left, capacity, patterns)
    return patterns


class SumIndex:
    """Pairs and triples of lengths by their sum. Whether the members are still available is tested when they are read."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        #: By sum: the longer members of the pairs, long ones first. At most capacity^2 / 4 entries.
        self.pair_sums = self._grouped([(x, lengths[(lengths <= x) & (lengths < capacity - x)]) for x in lengths[::-1].tolist()])
        sums = np.array(sorted(self.pair_sums), np.int64)
        #: By sum: the longest members of the triples; the rest of the sum is a key of ``pair_sums``.
        self.triple_sums = self._grouped([(x, sums[(sums <= 2 * x) & (sums < capacity - x)]) for x in lengths[::-1].tolist()])

    @staticmethod
    def _grouped(rows: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
        if not rows:
            return {}
        member = np.repeat([x for x, _ in rows], [len(r) for _, r in rows]).astype(np.int64)
        total = member + np.concatenate([r for _, r in rows])
        order = np.argsort(total, kind="stable")
        keys, starts = np.unique(total[order], return_index=True)
        return dict(zip(keys.tolist(), np.split(member[order], starts[1:]), strict=True))

    def pairs(self, total: int, most: int, left: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Available pairs with this sum, of lengths up to ``most``."""
        longer = self.pair_sums.get(total, np.zeros(0, np.int64))
        some = longer[(longer <= most) & (left[longer] > 0) & (left[total - longer] > 0)]
        for b in some.tolist():
            if left[b] and left[total - b]:
                yield b, total - b

    def triples(self, total: int, most: int, left: np.ndarray) -> Iterator[tuple[int, ...]]:
        """Available triples with this sum, of lengths up to ``most``."""
        for b in self.triple_sums.get(total, np.zeros(0, np.int64)).tolist():
            if b <= most and left[b]:
                for c, d in self.pairs(total - b, b, left):
                    yield b, c, d
                    if not left[b]:
                        break


def _best_fit(left: np.ndarray, capacity: int, patterns: list[tuple[tuple[int, ...], int]]) -> None:
    """Sequences of the longest piece left, each filled up by the longest that fits, in runs of equal patterns."""
    while left.any():
        lengths, gap, free = [], capacity, left.copy()
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not fits.size:
                break
            lengths.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        kinds, need = np.unique(lengths, return_counts=True)
        times = int((left[kinds] // need).min())
        left[kinds] -= times * need
        patterns.append((tuple(lengths), times))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs, and the sequence and offset at which each run starts."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                here = length == n
                first, at, off = plan.value[n]
                k = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here] = at[k] + rank[here] - first[k]
                offset[here] = off[k]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [x.split()[0] for x in _PLACED.split(", ")])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (a written table of ``cut_pieces``) with sequence_id and offset."""
    spark = pieces.sparkSession
    held = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "held")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(slots(plan_patterns(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if held.count() <= MAX_BROADCAST:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(plan), _PLACED)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(cut_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
