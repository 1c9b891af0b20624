"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

1. Every token of every text falls into one of ``BUCKETS`` buckets. A bucket has
   a sparse random index vector; a bucket's word vector is the sum of the index
   vectors of its tokens' neighbours, over the whole corpus (each task adds up
   its own, the sums are merged block by block).
2. A document is the mean and the spread of its tokens' word vectors, the lengths of
   these two, and how alike the word vectors of tokens one and two apart are.
3. A two-layer numpy network is fitted on a bounded sample of labelled documents
   (``sample`` rows, those with the smallest hash of their id), and the
   temperature of its logits on a part of the sample that the fit left out.

The word vectors have a fixed size (buckets x dimensions), which bounds what is
collected and broadcast. The price: buckets are shared. Of d different words a word
has its bucket to itself with probability (1 - 1/16384)^(d - 1), 54 % among 10,000
and 0.2 % among 100,000; a frequent word then gives its bucket most of its sum.
Labels, language, source and id are no inputs.

Defined cases: a null or empty text has the zero vector and the score that the
network gives it; a null id is of the fold of the empty text; null and conflicting
labels of one id count as no label; repeated rows are scored each, and of the rows
of one id the fit takes that with the smallest hash of its text; if fewer than
two classes are labelled, every score is the rate of label 1 (0.5 without labels);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import crc_fold, small_batches, unused_name
from brindle.llm.packed import pack, unpack
from brindle.llm.worker import stage_cache

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Parts in which the sums are merged, and tasks whose sums are merged first.
_BLOCKS, _TASKS = 64, 64
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CACHE = 200_000
_SEED = 20_011


def token_key(token: str) -> bytes:
    """What tokens share a bucket: words by their lower-case form, words in capitals and numbers by their kind."""
    if token.isalpha():
        return b"\x00A" if len(token) > 1 and token.isupper() else token.lower().encode()
    return b"\x00N" if token.isdigit() else token.encode()


class TokenBuckets(dict):
    """Buckets of tokens, kept up to a bound."""

    def __missing__(self, token: str) -> int:
        b = zlib.crc32(token_key(token)) % BUCKETS
        if len(self) < _CACHE and len(token) <= 64:
            self[token] = b
        return b

    def of(self, text: str | None) -> np.ndarray:
        """The buckets of a text's tokens in order."""
        tokens = TOKEN.findall(text or "")
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def _buckets() -> TokenBuckets:
    return stage_cache().setdefault("buckets", TokenBuckets())


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is not zero, and its signs there."""
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _add_contexts(ids: np.ndarray, places: np.ndarray, signs: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors of the neighbours of each token of one or more texts; -1 parts texts."""
    for step in range(1, REACH + 1):
        left, right = ids[:-step], ids[step:]
        whole = (left >= 0) & (right >= 0)
        for k in range(1, step):
            whole &= ids[k : len(ids) - step + k] >= 0
        left, right = left[whole], right[whole]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], total.size)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total, counts = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS)
    held: list[np.ndarray] = []
    apart, buckets, size = np.full(1, -1, np.int64), _buckets(), 0

    def flush() -> None:
        if held:
            ids = np.concatenate(held)
            counts[:] += np.bincount(ids[ids >= 0], minlength=BUCKETS)
            _add_contexts(ids, places, signs, total)
            held.clear()

    for batch in batches:
        for text in batch.column(0):
            ids = buckets.of(text.as_py())
            held += [ids, apart]
            size += len(ids)
            if size > 250_000:
                flush()
                size = 0
    flush()
    # Sums of signs and counts are whole numbers.
    blocks = np.hstack([total.reshape(BUCKETS, DIMENSIONS), counts[:, None]]).astype(np.int64).reshape(_BLOCKS, -1)
    task = TaskContext.get().partitionId() // _TASKS
    columns = [pa.array(range(_BLOCKS), pa.int32()), pa.array([task] * _BLOCKS, pa.int32()), pa.array([pack(b) for b in blocks], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["block", "task", "sums"])


def _merge_blocks(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0
    for table in tables:
        for sums in table["sums"]:
            total = total + unpack(sums)
    yield pd.DataFrame({"block": [key[0]], "sums": [pack(total)]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMENSIONS: unit word vectors around their mean, rare buckets weighing more (a fixed size, collected)."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts, "block int, task int, sums binary")
    some = sums.groupBy("block", "task").applyInPandas(_merge_blocks, "block int, sums binary")
    rows = some.groupBy("block").applyInPandas(_merge_blocks, "block int, sums binary").collect()
    if not rows:
        return np.zeros((BUCKETS, DIMENSIONS), np.float32)
    whole = np.concatenate([unpack(r.sums) for r in sorted(rows, key=lambda r: r.block)]).reshape(BUCKETS, DIMENSIONS + 1)
    vectors, counts = whole[:, :-1].astype(np.float64), whole[:, -1].astype(np.float64)
    share = counts / max(counts.sum(), 1.0)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1.0)
    unit -= share @ unit
    return (unit * (1e-2 / (1e-2 + share))[:, None]).astype(np.float32)


#: Numbers that describe a text: mean and spread by dimension, both vectors' logarithmic lengths, and likeness at two distances.
WIDTH = 2 * DIMENSIONS + 4


def _likeness(ids: np.ndarray, vectors: np.ndarray, step: int) -> float:
    """Mean product of the word vectors of tokens ``step`` apart, a bounded stretch at a time."""
    total, n = 0.0, len(ids) - step
    for at in range(0, n, 16_384):
        end = min(at + 16_384, n)
        total += float(np.einsum("ij,ij->", vectors[ids[at:end]], vectors[ids[at + step : end + step]]))
    return total / n if n > 0 else 0.0


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of a text's tokens, their lengths, and how alike near tokens are."""
    if not ids.size:
        return np.zeros(WIDTH, np.float32)
    kinds, n = np.unique(ids, return_counts=True)
    found, weight = vectors[kinds].astype(np.float64), (n / n.sum())[:, None]
    mean = (found * weight).sum(0)
    spread = np.sqrt(np.maximum((found**2 * weight).sum(0) - mean**2, 0))
    lengths = np.log1p(100 * np.array([np.linalg.norm(mean), np.linalg.norm(spread)]))
    own = float(mean @ mean + spread @ spread) + 1e-9
    alike = np.array([_likeness(ids, vectors, 1), _likeness(ids, vectors, 2)]) / own
    return np.concatenate([mean, spread, lengths, alike]).astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh units, one logit divided by a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, decay: float = 1e-4) -> Network:
    """Adam on the cross entropy; every fifth row is left out for the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    width = x.shape[1] if x.ndim == 2 else WIDTH
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if y.size else 0.5
    if y.size < 10 or len(np.unique(y)) < 2:
        blank = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(rate / (1 - rate))))
        return blank
    rng = np.random.default_rng(_SEED)
    held = np.arange(len(y)) % 5 == 4
    fx, fy = x[~held], y[~held]
    centre, scale = fx.mean(0), fx.std(0) + 1e-3
    net = Network(centre, scale, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), float(np.log(rate / (1 - rate))))
    z = (fx - centre) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(fy)), max(1, len(fy) // batch)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - fy[rows]) / len(rows)
            back = np.outer(g, params[2]) * (1 - h**2)
            grads = [z[rows].T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                params[k] -= 3e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, target = net.logits(x[held]), y[held]
    loss = lambda s: float(np.mean(np.logaddexp(0, logits / s) - target * logits / s))
    net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _buckets()
        for batch in batches:
            x = [pooled(buckets.of(t.as_py()), vectors.value).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_fold: int, folds: int, sample: int) -> DataFrame:
    """(doc_id, label, text) of at most ``sample`` labelled documents outside the held-out fold, one of each id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != held_fold))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
        .select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers
    # Of an id's rows one stays, however many there are; each task keeps one before the shuffle.
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _scorer(vectors, network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _buckets()
        for batch in batches:
            x = np.array([pooled(buckets.of(t.as_py()), vectors.value) for t in batch.column(2)], np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(network.value.score(x), pa.float64())], ["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_fold: int = 2, folds: int = 4, sample: int = 8_000):
    """The word vectors (broadcast) and the fitted network (broadcast)."""
    spark = docs.sparkSession
    small_batches(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    rows = training_rows(docs, labels, label, held_fold, folds, sample).mapInArrow(_features(vectors), "doc_id long, label int, x binary").collect()
    rows = sorted({(r.doc_id, r.label, bytes(r.x)) for r in rows}, key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows]).reshape(-1, WIDTH)
    return vectors, spark.sparkContext.broadcast(fit(x, np.array([r[1] for r in rows])))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_fold: int = 2, folds: int = 4, sample: int = 8_000) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    vectors, network = train(docs, labels, "quality", held_fold, folds, sample)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    scored = narrow.mapInArrow(_scorer(vectors, network), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _with_scores(vectors, network, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _buckets()
        for batch in batches:
            x = np.array([pooled(buckets.of(t.as_py()), vectors.value) for t in batch.column(at)], np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.value.score(x), pa.float64())], [*batch.schema.names, name])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier does not reject, with their columns, whatever their names."""
    vectors, network = train(docs.select("doc_id", "text"), labels)
    name = unused_name(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    scored = docs.mapInArrow(_with_scores(vectors, network, docs.columns.index("text"), name), schema)
    return scored.where(F.col(name) >= threshold).drop(name)
