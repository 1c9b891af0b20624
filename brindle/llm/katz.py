"""Language-model scoring: a Katz backoff bigram model in partitioned tables.

Texts are tokenized once into chunks of about ``CHUNK_TOKENS`` tokens, written as
a table bucketed by chunk: the tokens as numbers into the chunk's own vocabulary.
Everything else travels as packed arrays between chunks and partitions of a model
table, each chunk asking only for its distinct words and word pairs:

1. Words go to partitions by hash. A partition adds up the training counts,
   numbers its words by frequency and answers each chunk in its own order.
2. Pairs go to partitions by their first word; frequent first words are split
   further by the second word, so that none has more than ``HOT_TOKENS`` pairs.
   A partition adds up the counts and answers; it also sums up, per first word,
   what backoff weights need, as integers.
3. These sums meet by first word. With the Good-Turing discounts (from the counts
   of counts of all partitions, a few numbers, smoothed by a log-linear fit) they
   give exactly normalised backoff weights, and each chunk gets those of its words.
4. Each chunk evaluates every distinct pair by the recursion: a seen pair has its
   discounted relative frequency, any other the backoff weight of its first word
   times the probability of the second, a unigram with 0.5 added to each count and
   one class for all unknown words. The first token follows a start mark.

All tables grow with the corpus; only totals and counts of counts reach the driver.

Defined cases: a null or empty text is its end token alone; a null id stays null
and is of the fold of the empty text; repeated rows count and are scored each; with
no training text every word is unknown; an empty table gives an empty result;
extra columns of the input are ignored; a very long text is a chunk of its own. Words
are told apart by 64-bit hashes: of V distinct words two share one, and then count as
one word, with a probability of about V^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bucketed, crc_fold, materialize, parallel_tasks
from brindle.llm.packed import mixed, pack, small, unpack
from brindle.llm.spaced import word_hashes

CHUNK_TOKENS, HOT_TOKENS = 750_000, 1_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Keys of the end token and of the mark before the first token; words have keys of another hash.
END, START = (xxhash.xxh64_intdigest(mark) for mark in (b"end", b"start"))


def token_keys(text: str | None) -> np.ndarray:
    """Keys of the words between white space with A-Z lower-cased, then of the end token."""
    return np.append(word_hashes((text or "").encode()), np.uint64(END))


_CHUNK = "chunk long, doc_ids array<long>, held binary, sizes binary, words binary, vocabulary binary, counts binary"


def _chunks(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_chunks(batches, chunk_tokens)

    return run


def _cut_chunks(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 24, 0
    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def closed() -> pa.RecordBatch:
        hashes, place = np.unique(np.append(np.concatenate(words), np.uint64(START)), return_inverse=True)
        stream, start = place[:-1].astype(np.uint32), place[-1]
        taught = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(stream[taught], minlength=len(hashes))
        counts[start] = sum(not h for h in held)
        values = [base + made, ids, pack(np.array(held, np.uint8)), pack(np.array(sizes, np.uint32)), pack(stream), pack(hashes), pack(small(counts))]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    ids, held, sizes, words, total = [], [], [], [], 0
    for batch in batches:
        for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found = token_keys(text.as_py())
            words.append(found)
            ids.append(doc_id)
            held.append(out)
            sizes.append(len(found))
            total += len(found)
            if total >= chunk_tokens:
                yield closed()
                made += 1
                ids, held, sizes, words, total = [], [], [], [], 0
    if ids:
        yield closed()


def write_chunks(docs: DataFrame, held_fold: int, folds: int, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The chunks of all documents, a table bucketed by chunk so that later steps need not shuffle it."""
    spark = docs.sparkSession
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), folds) == held_fold).alias("held"), F.col("text").cast("string").alias("text")
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(parallel_tasks(spark), size // 24_000_000), 100_000))
    return bucketed(narrow.mapInArrow(_chunks(chunk_tokens), _CHUNK), "chunks", buckets, "chunk")


_WORDS = "kind int, chunk long, part int, numbers binary, counts binary, words long, tokens long"


def _word_requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, vocabulary, counts in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                hashes, counts = unpack(vocabulary), unpack(counts)
                cuts = np.searchsorted((hashes >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                rows = [(p, chunk, pack(hashes[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "chunk", "hashes", "counts"])

    return run


def _count_words(parts: int):
    def run(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [(c, unpack(h), unpack(n)) for t in tables for c, h, n in zip(t["chunk"], t["hashes"], t["counts"], strict=True)]
        hashes, place = np.unique(np.concatenate([h for _, h, _ in asked]), return_inverse=True)
        total = np.zeros(len(hashes), np.int64)
        at = 0
        for _, h, n in asked:
            total[place[at : at + len(h)]] += n.astype(np.int64)
            at += len(h)
        order = np.lexsort((hashes, -total))
        number = np.empty(len(hashes), np.int64)
        number[order] = np.arange(len(hashes)) * parts + int(key[0]) + 1  # 0: not in training
        number[total == 0] = 0
        at, rows = 0, []
        for chunk, h, _ in asked:
            here = place[at : at + len(h)]
            rows.append((0, chunk, int(key[0]), pack(small(number[here])), pack(small(total[here])), 0, 0))
            at += len(h)
        real = (total > 0) & (hashes != np.uint64(START))
        known = order[: int((total > 0).sum())]
        rows.append((1, -1, int(key[0]), pack(hashes[known]), pack(small(total[known])), int(real.sum()), int(total[real].sum())))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _WORDS.split(", ")])

    return run


def word_table(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Kind 0: each chunk's words as numbers and training counts; kind 1: the unigram table's partitions."""
    spark = chunks.sparkSession
    entries = chunks.agg(F.sum(F.length("vocabulary"))).first()[0] or 0
    bits = int(min(max(parallel_tasks(spark) - 1, entries // 8_000_000, 1), 1 << 16)).bit_length()
    asked = chunks.select("chunk", "vocabulary", "counts").mapInArrow(_word_requests(bits), "part int, chunk long, hashes binary, counts binary")
    return materialize(asked.groupBy("part").applyInPandas(_count_words(1 << bits), _WORDS), "words", "kind"), 1 << bits


class _Pairs:
    """The distinct pairs of a chunk, in the order in which it asks for them."""

    def __init__(self, stream: np.ndarray, sizes: np.ndarray, start: int, number: np.ndarray, count: np.ndarray, parts: int, hot_tokens: int):
        width = len(number)
        first = np.empty(len(stream), np.int64)
        first[1:] = stream[:-1]
        first[np.cumsum(sizes) - sizes] = start
        keys, self.place = np.unique(first * width + stream, return_inverse=True)
        self.first, self.second = keys // width, keys % width
        a, b = number[self.first], number[self.second]
        split = np.maximum(1, -(-count[self.first] // hot_tokens)).astype(np.uint64)
        part = (mixed(mixed(a) + mixed(b) % split) % np.uint64(parts)).astype(np.int64)
        asked = np.flatnonzero((a > 0) & (b > 0))
        self.order = asked[np.lexsort((b[asked], a[asked], part[asked]))]
        self.part = part[self.order]


def _start_of(hashes: np.ndarray) -> int:
    return int(np.searchsorted(hashes, np.uint64(START)))


def _joined(replies: pd.DataFrame, *names: str) -> list[np.ndarray]:
    """The replies of all partitions, in their order."""
    rows = replies.sort_values("part")
    return [np.concatenate([unpack(x) for x in rows[n]]) if len(rows) else np.zeros(0, np.uint32) for n in names]


_PAIR_REQUEST = "part int, chunk long, firsts binary, runs binary, seconds binary, counts binary, second_counts binary"


def _pair_requests(parts: int, hot_tokens: int):
    def run(chunk: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c in chunk.itertuples():
            number, count = (x.astype(np.int64) for x in _joined(words, "numbers", "counts"))
            stream, sizes, hashes = unpack(c.words), unpack(c.sizes).astype(np.int64), unpack(c.vocabulary)
            pairs = _Pairs(stream, sizes, _start_of(hashes), number, count, parts, hot_tokens)
            taught = np.repeat(unpack(c.held) == 0, sizes)
            own = np.bincount(pairs.place[taught], minlength=len(pairs.first))
            a, b = number[pairs.first[pairs.order]], number[pairs.second[pairs.order]]
            n, c2 = own[pairs.order], count[pairs.second[pairs.order]]
            cuts = np.searchsorted(pairs.part, np.arange(parts + 1))
            for p, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if i < j:
                    new = np.flatnonzero(np.r_[True, a[i + 1 : j] != a[i : j - 1]])
                    runs = np.diff(np.r_[new, j - i])
                    rows.append((p, c.chunk, pack(small(a[i:j][new])), pack(small(runs)), pack(small(b[i:j])), pack(small(n[i:j])), pack(small(c2[i:j]))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _PAIR_REQUEST.split(", ")])

    return run


_PAIR_ROWS = "kind int, part int, chunk long, counts binary, firsts binary, seconds binary, sums array<binary>, counts_of_counts array<long>"


def _count_pairs(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    asked = []
    for t in tables:
        for r in t.itertuples():
            asked.append((r.chunk, np.repeat(unpack(r.firsts).astype(np.int64), unpack(r.runs)), *[unpack(x).astype(np.int64) for x in (r.seconds, r.counts, r.second_counts)]))
    a, b, n, c2 = (np.concatenate([x[k] for x in asked]) for k in range(1, 5))
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, n, int(new.sum())).astype(np.int64)
    at, rows = 0, []
    for chunk, first, *_ in asked:
        rows.append((0, key[0], chunk, pack(small(total[group[at : at + len(first)]])), None, None, None, None))
        at += len(first)
    lead = order[new]
    seen = total > 0
    a, b, n, c2 = a[lead][seen], b[lead][seen], total[seen], c2[lead][seen]
    if a.size:
        firsts, place = np.unique(a, return_inverse=True)
        add = lambda w: np.bincount(place, w, len(firsts)).astype(np.int64)
        sums = [add(n == r) for r in range(1, DISCOUNTED + 1)] + [add(np.where(n > DISCOUNTED, n, 0)), add(c2), add(np.ones(len(a)))]
        of = [int((n == r).sum()) for r in range(1, DISCOUNTED + 2)]
        rows.append((1, key[0], -1, None, pack(small(firsts)), None, [pack(small(s)) for s in sums], of))
        rows.append((2, key[0], -1, pack(small(n)), pack(small(a)), pack(small(b)), None, None))
    yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PAIR_ROWS.split(", ")])


def pair_table(chunks: DataFrame, words: DataFrame, total: int, hot_tokens: int = HOT_TOKENS) -> tuple[DataFrame, int]:
    """Kind 0: the counts each chunk asked for; kind 1: sums by first word; kind 2: the bigram table's partitions."""
    parts = int(max(parallel_tasks(chunks.sparkSession), total // 3_000_000))
    replies = words.where("kind = 0").select("chunk", "part", "numbers", "counts")
    asked = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_pair_requests(parts, hot_tokens), _PAIR_REQUEST)
    return materialize(asked.groupBy("part").applyInPandas(_count_pairs, _PAIR_ROWS), "pairs", "kind"), parts


def smoothed(of: list[int]) -> float | None:
    """Slope of the log-linear fit of n_r on r, as in Simple Good-Turing: each n_r that is not 0 is spread over the gap
    between its neighbours. None if the fit does not fall faster than 1 / r, or rests on one point."""
    n = np.array(of, np.float64)
    r = np.flatnonzero(n) + 1
    if len(r) < 2:
        return None
    before, after = np.r_[0, r[:-1]], np.r_[r[1:], 2 * r[-1] - r[-2]]
    x, y = np.log(r), np.log(2 * n[r - 1] / (after - before))
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    return slope if slope < -1 - 1e-9 else None


def discounts(of: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 1 to DISCOUNTED (index 0 unused), from the numbers of pairs that occur
    1, 2, ... times, smoothed: groups of copies make the raw ones jump, and a slope below -1 gives values inside (0, 1).
    Where there is no such slope, an absolute discount takes their place."""
    r = np.arange(1, DISCOUNTED + 1)
    if (slope := smoothed(of)) is not None:
        common = float(DISCOUNTED + 1) ** (slope + 1)
        d = ((1 + 1 / r) ** (slope + 1) - common) / (1 - common)
    else:
        d = (r - (of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5) * 0.999) / r
    return np.r_[0.0, d]


def backoff(sums: np.ndarray, discount: np.ndarray, n_tokens: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and denominator of each first word. A word whose pairs leave nothing gives up one count."""
    r = np.arange(1, DISCOUNTED + 1)
    held = sums.astype(np.float64)
    total = r @ held[:DISCOUNTED] + held[DISCOUNTED]
    left = total - (discount[1:] * r) @ held[:DISCOUNTED] - held[DISCOUNTED]
    bare = left <= 1e-9 * np.maximum(total, 1)
    denominator, left = np.where(bare, total + 1, total), np.where(bare, 1.0, left)
    seen = (held[DISCOUNTED + 1] + 0.5 * held[DISCOUNTED + 2]) / (n_tokens + 0.5 * (n_words + 1))
    return left / denominator / (1 - seen), denominator


def _first_parts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for firsts, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, table = unpack(firsts).astype(np.int64), [unpack(s) for s in sums]
                part = (number - 1) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, pack(small(number[order[i:j]])), [pack(s[order[i:j]]) for s in table]) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                kinds = (pa.int32(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "firsts", "sums"])

    return run


_WEIGHTS = "chunk long, part int, weights binary, denominators binary"


def _weigh(discount: np.ndarray, n_tokens: int, n_words: int):
    def run(asked: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if len(sums):
            number = np.concatenate([unpack(x) for x in sums["firsts"]]).astype(np.int64)
            table = np.array([np.concatenate([unpack(s[k]) for s in sums["sums"]]) for k in range(DISCOUNTED + 3)], np.float64)
            known, place = np.unique(number, return_inverse=True)
            weight, below = backoff(np.array([np.bincount(place, t, len(known)) for t in table]), discount, n_tokens, n_words)
        else:
            known, weight, below = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        known, weight, below = np.r_[known, -1], np.r_[weight, 1.0], np.r_[below, 1.0]  # others pass on to the unigram
        rows = []
        for r in asked.itertuples():
            want = unpack(r.numbers).astype(np.int64)
            at = np.searchsorted(known[:-1], want)
            at = np.where((known[at] == want) & (want > 0), at, len(known) - 1)
            rows.append((r.chunk, r.part, pack(weight[at]), pack(small(below[at]))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _WEIGHTS.split(", ")])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _evaluate(discount: np.ndarray, n_tokens: int, n_words: int, parts: int, hot_tokens: int):
    def run(chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for c in chunk.itertuples():
            words, weights, asked = (replies[replies["kind"] == k] for k in ("words", "weights", "pairs"))
            number, count = (x.astype(np.int64) for x in _joined(words, "x", "y"))
            weight, below = (x.astype(np.float64) for x in _joined(weights, "x", "y"))
            stream, sizes, hashes = unpack(c.words), unpack(c.sizes).astype(np.int64), unpack(c.vocabulary)
            pairs = _Pairs(stream, sizes, _start_of(hashes), number, count, parts, hot_tokens)
            found = np.zeros(len(pairs.first), np.int64)
            found[pairs.order] = _joined(asked, "x")[0]
            unigram = (count + 0.5) / (n_tokens + 0.5 * (n_words + 1))
            share = np.where(found <= DISCOUNTED, discount[np.minimum(found, DISCOUNTED)], 1.0)
            p = np.where(found > 0, share * found / below[pairs.first], weight[pairs.first] * unigram[pairs.second])
            starts = np.cumsum(sizes) - sizes
            tables.append(pd.DataFrame({
                "doc_id": pd.array(list(c.doc_ids), "Int64"), "held_out": unpack(c.held) > 0, "n_tokens": sizes,
                "n_known": np.add.reduceat((count > 0)[stream].astype(np.int64), starts), "train_tokens": n_tokens,
                "base_score": np.add.reduceat(np.log10(unigram)[stream], starts), "score": np.add.reduceat(np.log10(p)[pairs.place], starts),
            }))
        return pd.concat(tables) if tables else pd.DataFrame({x.split()[0]: [] for x in _SCORES.split(", ")})

    return run


def score_documents(docs: DataFrame, held_fold: int = 1, folds: int = 5, chunk_tokens: int = CHUNK_TOKENS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; the model learns
    from the documents outside the held-out fold."""
    chunks = write_chunks(docs, held_fold, folds, chunk_tokens)
    words, word_parts = word_table(chunks)
    n_words, n_tokens = words.where("kind = 1").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    pairs, parts = pair_table(chunks, words, n_tokens, hot_tokens)
    of = pairs.where("kind = 1").select([F.coalesce(F.sum(F.col("counts_of_counts")[k]), F.lit(0)) for k in range(DISCOUNTED + 1)]).first()
    discount = discounts(list(of))
    sums = pairs.where("kind = 1").select("firsts", "sums").mapInArrow(_first_parts(word_parts), "part int, firsts binary, sums array<binary>")
    asked = words.where("kind = 0").select("chunk", "part", "numbers")
    weights = asked.groupBy("part").cogroup(sums.groupBy("part")).applyInPandas(_weigh(discount, n_tokens, n_words), _WEIGHTS)
    reply = lambda df, kind, x, y: df.select("chunk", F.lit(kind).alias("kind"), "part", F.col(x).alias("x"), F.col(y).alias("y"))
    replies = (
        reply(words.where("kind = 0"), "words", "numbers", "counts")
        .union(reply(weights, "weights", "weights", "denominators"))
        .union(reply(pairs.where("kind = 0"), "pairs", "counts", "seconds"))
    )
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_evaluate(discount, n_tokens, n_words, parts, hot_tokens), _SCORES)
