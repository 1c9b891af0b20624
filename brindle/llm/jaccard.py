"""An exact n-gram Jaccard join by T-occurrence search.

A document is the set of its distinct five-word shingles (64-bit hashes). Documents
with equal sets form a class, and only classes are searched. Two sets of x and y
shingles link if they share T = ceil(0.75 (x + y) / 1.75) of them.

1. Rarity: every task counts its shingles in a sketch of fixed size; the merged
   sketch (broadcast, as one byte a counter) orders all shingles, rare ones first.
2. Candidates: of a class's inverted lists the T - 1 of the most frequent shingles
   are left out, since a partner must then be in one of the others. These lists are
   built by a shuffle of packed postings. A list of two is one candidate pair. In a
   longer list one member, that with the fewest rarer shingles, is the pivot; each
   member merges the lists that offer it pivots and is tested against the one that
   it shares most of them with: one pair a member. What links forms components.
3. Lists that still span components are searched by DivideSkip. Their members are
   placed in blocks of bounded size, each an inverted index over whole sets. A
   member that is not in its list's main component is a query of all blocks that
   hold members of its lists: it merges the short lists by a heap, keeps what
   reaches T less the number of long ones, probes those by binary search, and links
   with what reaches T. A block names a link only if it joins two components.

So rows are linear in members and blocks: near copies are not expanded into all
pairs. The work inside blocks is not: of m members that are in no component with
each other, all m^2 / 2 counts are merged, block by block.

Defined cases: a null or empty text has no shingles and is its own component; with
fewer than five words the whole sequence is one shingle; copies and repeated rows
share a component; a null id is no smallest id, unless a component has no other;
an empty table gives an empty result; extra columns are ignored; very long texts
are hashed a stretch at a time. Words are told apart by 64-bit hashes, and so are
shingles and classes (d different ones share one with probability d^2 / 2^65).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bucketed, materialize, parallel_tasks, small_batches
from brindle.llm.components import connected
from brindle.llm.filters import holds, key_filter
from brindle.llm.packed import mixed, pack, small, unpack
from brindle.llm.spaced import word_hashes
from brindle.llm.worker import stage_cache

WIDTH = 5
#: Counters of the sketch, a byte each when broadcast.
COUNTERS = 1 << 24
_BLOCKS = 256
#: A shingle of which a sketch counter holds this much, and this many times the mean, has its list split.
HOT_COUNT, HOT_FACTOR = 1_000_000, 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Postings that a task holds before it sends them.
_FLUSH = 1_000_000
#: Shingles of the members, and of the queries, that meet in one task; pairs of one class that share a copy of its set.
BLOCK, HOT_PAIRS = 500_000, 256
#: DivideSkip's weight of a long list against a short one.
MU = 0.01


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles."""
    h = word_hashes((text or "").encode())
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _FACTOR + h[k : n - width + 1 + k]
    return np.unique(mixed(total))


def required(x, y):
    """How many shingles sets of x and y share at least if they link: 100 i >= 75 (x + y - i)."""
    return -(-75 * (x + y) // 175)


def _class_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_SIGNED = "kind int, doc_id long, n_shingles long, class long, block int, counts binary"


def _counter_blocks(counts: np.ndarray | None, held: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The sketch of a task, a block at a time: ``counts`` and what is still held. A task of few shingles has no counts."""
    at = np.sort((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64)) if held else np.zeros(0, np.int64)
    wide = COUNTERS // _BLOCKS
    cuts = np.searchsorted(at, np.arange(_BLOCKS + 1) * wide)
    for k in range(_BLOCKS):
        block = np.bincount(at[cuts[k] : cuts[k + 1]] - k * wide, minlength=wide).astype(np.uint32)
        yield block if counts is None else block + counts[k * wide : (k + 1) * wide]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stage_cache()
    counts: np.ndarray | None = None
    held, size, total = [], 0, 0

    def flush() -> None:
        nonlocal counts
        counts = np.zeros(COUNTERS, np.uint32) if counts is None else counts
        np.add.at(counts, (np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
        held.clear()

    for batch in batches:
        n, cls = [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            n.append(len(found))
            cls.append(_signed(_class_of(found)) if len(found) else None)
            held.append(found)
            size += len(found)
            total += len(found)
            if size > _FLUSH:
                flush()
                size = 0
        blank = [None] * len(n)
        yield _rows(_SIGNED, [[0] * len(n), batch.column(0).to_pylist(), n, cls, blank, blank])
    if total:
        blank = [None] * _BLOCKS
        yield _rows(_SIGNED, [[1] * _BLOCKS, blank, blank, blank, list(range(_BLOCKS)), [pack(b) for b in _counter_blocks(counts, held)]])


def _merge_counts(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS // _BLOCKS, np.int64)
    for t in tables:
        for c in t["counts"]:
            total += unpack(c).astype(np.int64)
    levels = np.round(4 * np.log2(total + 1)).clip(0, 255).astype(np.uint8)
    yield pd.DataFrame({"block": [int(key[0])], "levels": [levels.tobytes()]})


def sign_documents(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, class) of each document, and the sketch as one byte a counter (a fixed size, collected)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialize(narrow.mapInArrow(_sign, _SIGNED), "signed", "kind")
    merged = table.where("kind = 1").select("block", "counts").groupBy("block").applyInPandas(_merge_counts, "block int, levels binary").collect()
    levels = np.zeros((_BLOCKS, COUNTERS // _BLOCKS), np.uint8)
    for r in merged:
        levels[r.block] = np.frombuffer(r.levels, np.uint8)
    return table.where("kind = 0").select("doc_id", "n_shingles", "class"), levels.ravel()


_MESSAGE = "part int, hot boolean, tokens binary, classes binary, sizes binary, rests binary"


def _post(sketch, parts: int, hot_level: int):
    """Postings of the short lists, packed by partition. ``rests``: how many of the class's shingles, in order of rarity, start with this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage_cache()
        levels, met = sketch.value, set()
        tokens, classes, sizes, rests = [], [], [], []
        held = 0

        def closed() -> pa.RecordBatch:
            token, cls = np.concatenate(tokens), np.repeat(np.array(classes, np.uint64), [len(t) for t in tokens])
            size = np.repeat(np.array(sizes, np.int32), [len(t) for t in tokens])
            rest = np.concatenate(rests)
            hot = levels[(token % np.uint64(COUNTERS)).astype(np.int64)] >= hot_level
            salt = np.where(hot, mixed(cls) % np.uint64(parts), np.uint64(0))
            part = (((token >> np.uint64(32)) + salt) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((token, hot, part))
            part, hot, token, cls, size, rest = (x[order] for x in (part, hot, token, cls, size, rest))
            cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (hot[1:] != hot[:-1]), True]) if len(part) else np.zeros(1, np.int64)
            rows = [(int(part[a]), bool(hot[a]), pack(token[a:b]), pack(cls[a:b]), pack(small(size[a:b])), pack(small(rest[a:b]))) for a, b in zip(cuts, cuts[1:])]
            for x in (tokens, classes, sizes, rests):
                x.clear()
            return _rows(_MESSAGE, list(zip(*rows, strict=True)) if rows else [[]] * 6)

        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py())
                n = len(found)
                cls = _class_of(found) if n else None
                if not n or cls in met:
                    continue
                met.add(cls)
                # The rarest shingles: all but the T - 1 longest lists, T being least for the smallest partner.
                keep = n - -(-3 * n // 4) + 1
                level = levels[(found % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((found, level))[:keep]
                tokens.append(found[order])
                classes.append(cls)
                sizes.append(n)
                rests.append(n - np.arange(keep, dtype=np.int32))
                held += keep
                if held > _FLUSH:
                    yield closed()
                    held = 0
        if tokens:
            yield closed()

    return run


def _pivots(cls: np.ndarray, size: np.ndarray, rest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For one list, ordered by size: pivots, and the members that may link with each. Of the members whose sizes allow
    links among them, the pivot is that of which the list leaves out least, as in a group of edited copies the original."""
    a = 0
    while a < len(cls):
        end = int(np.searchsorted(size, size[a] * 100 // 75, side="right"))
        p = a + int(np.lexsort((cls[a:end], -rest[a:end] / size[a:end]))[0])
        fit = np.minimum(rest[p], rest[a:end]) >= required(size[p], size[a:end])
        fit[p - a] = False
        if fit.any():
            yield int(cls[p]), cls[a:end][fit]
        a = end


def _paired(size: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which members of one list may link with another by it; of a long list, all if any may."""
    if len(size) > 256:
        # Only a member with so long a rest can be the smaller one of a pair.
        return np.full(len(size), (rest >= required(size, size)).any())
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    fit = (100 * low >= 75 * high) & (np.minimum.outer(rest, rest) >= required(size[:, None], size[None, :]))
    np.fill_diagonal(fit, False)
    return fit.any(axis=1)


def heap_merge(lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """Members of sorted lists, each with the number of lists that hold it."""
    return [(c, sum(1 for _ in same)) for c, same in groupby(heapq.merge(*[x.tolist() for x in lists]))]


#: Kind 0: a candidate pair (a, b); 1: a member a of a longer list; 2: a pivot b that ``shared`` of a's lists offer.
_FOUND = "kind int, token long, a long, b long, n long, rest long, shared long"


def _signed_all(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _table(kind: int, **columns) -> pd.DataFrame:
    return pd.DataFrame({x.split()[0]: columns.get(x.split()[0], 0) for x in _FOUND.split(", ")} | {"kind": kind})


def _search(key: tuple, tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stage_cache()
    got = [[unpack(x) for x in (r.tokens, r.classes, r.sizes, r.rests)] for t in tables for r in t.itertuples()]
    hot = bool(key[1])
    token, cls, size, rest = (np.concatenate([g[k] for g in got]) for k in range(4))
    del got
    order = np.lexsort((cls, size, token))
    token, cls, size, rest = token[order], cls[order], size[order].astype(np.int64), rest[order].astype(np.int64)
    new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
    token, cls, size, rest = token[new], cls[new], size[new], rest[new]
    lead = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[lead, len(token)])
    # Lists of two are one pair each, if their rests are long enough.
    two = lead[length == 2] if not hot else lead[:0]
    two = two[np.minimum(rest[two], rest[two + 1]) >= required(size[two], size[two + 1])]
    low, high = np.minimum(cls[two], cls[two + 1]), np.maximum(cls[two], cls[two + 1])
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(low) else np.zeros(0, bool)
    yield _table(0, a=_signed_all(low[new]), b=_signed_all(high[new]))
    # Longer lists with the same members are one, with the longest rest of each member.
    more = np.flatnonzero((length > 2) | hot)
    alike: dict[bytes, list[int]] = {}
    for k in more.tolist():
        alike.setdefault(token[lead[k] : lead[k] + 1].tobytes() if hot else cls[lead[k] : lead[k] + length[k]].tobytes(), []).append(k)
    rows, offers = [], []
    for lists in alike.values():
        s = slice(lead[lists[0]], lead[lists[0]] + length[lists[0]])
        longest = np.max([rest[lead[k] : lead[k] + length[k]] for k in lists], axis=0)
        for pivot, others in _pivots(cls[s], size[s], longest):
            offers.append((others, np.full(len(others), pivot, np.uint64), np.full(len(others), len(lists))))
        keep = np.ones(len(longest), bool) if hot else _paired(size[s], longest)
        if keep.any():
            rows.append((token[s][keep], cls[s][keep], size[s][keep], longest[keep]))
    if rows:
        token, cls, size, rest = (np.concatenate([r[k] for r in rows]) for k in range(4))
        yield _table(1, token=_signed_all(token), a=_signed_all(cls), n=size, rest=rest)
    if offers:
        member, pivot, shared = (np.concatenate([o[k] for o in offers]) for k in range(3))
        order = np.lexsort((pivot, member))
        member, pivot, shared = member[order], pivot[order], shared[order]
        at = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (pivot[1:] != pivot[:-1])])
        yield _table(2, a=_signed_all(member[at]), b=_signed_all(pivot[at]), shared=np.add.reduceat(shared, at))


def short_lists(docs: DataFrame, levels: np.ndarray, total: int) -> DataFrame:
    """The candidates, members of longer lists and offered pivots of all short lists, by kind as in ``_FOUND``."""
    spark = docs.sparkSession
    parts = int(max(parallel_tasks(spark), total // 6_000_000))
    hot = max(HOT_COUNT, HOT_FACTOR * total // COUNTERS)
    hot_level = min(255, int(np.ceil(4 * np.log2(hot))))
    sketch = spark.sparkContext.broadcast(levels)  # COUNTERS bytes
    posted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_post(sketch, parts, hot_level), _MESSAGE)
    return materialize(posted.groupBy("part", "hot").applyInPandas(_search, _FOUND), "lists", "kind")


def _emit_sets(classes, ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage_cache()
        schema = "class long, doc_id long, hashes binary"
        for batch in batches:
            may = holds(ids.value, batch.column(0).fill_null(0).to_numpy().view(np.uint64))
            rows, held = [], 0
            for doc_id, wanted, text in zip(batch.column(0).to_pylist(), may, batch.column(1), strict=True):
                found = shingles(text.as_py()) if wanted else ()
                if len(found) and holds(classes.value, np.array([c := _class_of(found)], np.uint64))[0]:
                    rows.append((_signed(c), doc_id or 0, found.tobytes()))
                    held += found.nbytes
                if held > 32_000_000:
                    yield _rows(schema, list(zip(*rows, strict=True)))
                    rows, held = [], 0
            if rows:
                yield _rows(schema, list(zip(*rows, strict=True)))

    return run


def class_sets(docs: DataFrame, active: DataFrame, total: int) -> DataFrame:
    """(class, doc_id, hashes) of the classes in ``active`` (class, first_id), and some more. The row of a class is that of
    its first id. Two filters of fixed size choose the texts; the table is bucketed, so that joins with it shuffle only
    their other side."""
    classes, ids = key_filter(active, "class"), key_filter(active, "first_id")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = narrow.mapInArrow(_emit_sets(classes, ids), "class long, doc_id long, hashes binary")
    buckets = int(min(max(parallel_tasks(docs.sparkSession), total // 8_000_000), 100_000))
    # One shuffle here leaves one file a bucket, and saves one in every later join.
    return bucketed(sets.repartition(buckets, "class", "doc_id"), "sets", buckets, "class", "doc_id")


def links_of(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share as many as they must: binary probes of the smaller one's shingles, in stretches."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    need, got = required(len(a), len(b)), 0
    for at in range(0, len(few), 4096):
        probe = few[at : at + 4096]
        place = np.minimum(np.searchsorted(many, probe), len(many) - 1)
        got += int((many[place] == probe).sum())
        if got >= need or got + len(few) - at - len(probe) < need:
            break
    return got >= need


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stage_cache()
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
        good = pa.array([links_of(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), good], ["a", "b", "linked"])


def verify(pairs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, linked) of candidate pairs. A class that is b of many pairs has a copy of its set for each HOT_PAIRS of them."""
    first = lambda c: classes.select(F.col("class").alias(c), F.col("first_id").alias(f"{c}_id"))
    of = lambda c, v: sets.select(F.col("class").alias(c), F.col("doc_id").alias(f"{c}_id"), F.col("hashes").alias(v)).hint("merge")
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PAIRS)
    many = many.select("b", F.ceil(F.col("n") / HOT_PAIRS).alias("copies"))
    named = pairs.select("a", "b").join(first("a"), "a").join(first("b"), "b").join(many, "b", "left")
    named = materialize(named.withColumn("copy", F.pmod(F.xxhash64("a"), "copies")), "named")
    # Only the pairs move to the sets, then the pairs with one set; of the other sets those of the many pairs alone.
    filled = named.join(of("a", "x"), ["a", "a_id"])
    few = filled.where("copies is null").join(of("b", "y"), ["b", "b_id"]).select("a", "b", "x", "y")
    copies = named.where("copies is not null").select("b", "b_id", "copy").distinct().join(of("b", "y"), ["b", "b_id"])
    hot = filled.where("copies is not null").join(copies.select("b", "copy", "y"), ["b", "copy"]).select("a", "b", "x", "y")
    return few.union(hot).mapInArrow(_verify, "a long, b long, linked boolean")


def candidates(found: DataFrame) -> DataFrame:
    """Pairs to be tested first: those of lists of two, and each member a with the pivot b that most of its lists offer."""
    offered = found.where("kind = 2").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    best = offered.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    return found.where("kind = 0").select("a", "b").union(best.select("a", "b")).distinct()


class BlockIndex:
    """Inverted lists of a block of sets, one after the other."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(token, kind="stable")  # so that every list is in order of its members
        self.token, self.owner = token[order], owner[order]

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        low, high = np.searchsorted(self.token, query, "left"), np.searchsorted(self.token, query, "right")
        some = low < high
        return [self.owner[a:b] for a, b in zip(low[some].tolist(), high[some].tolist(), strict=True)]


def divide_skip(lists: list[np.ndarray], needs: np.ndarray) -> np.ndarray:
    """Members that are in as many of the sorted lists as ``needs`` asks of each (more lists than there are: never).

    The longest lists are set aside. The others are merged by a heap; what occurs in enough of them is looked up in
    the long ones, until it has what it needs or cannot reach it."""
    least = int(needs.min())
    if len(lists) < least:
        return np.zeros(0, np.int64)
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (MU * math.log2(len(lists[-1])) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    merged = np.array([x for x in heap_merge(short) if x[1] >= least - aside], np.int64).reshape(-1, 2)
    member, shared = merged[:, 0], merged[:, 1]
    for k, members in enumerate(long):
        open_ = shared + len(long) - k >= needs[member]
        member, shared = member[open_], shared[open_]
        if not len(member):
            break
        at = np.minimum(np.searchsorted(members, member), len(members) - 1)
        shared = shared + (members[at] == member)
    return member[shared >= needs[member]]


def _link_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between a block's queries and members that join components, each pair of components once."""
    stage_cache()
    rows = rows.sort_values(["query", "a"])
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    classes, query = rows["a"].to_numpy(), rows["query"].to_numpy()
    names, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
    n, links = int((~query).sum()), []
    if 0 < n < len(sets):
        index = BlockIndex(sets[:n])
        for q in range(n, len(sets)):
            size = len(sets[q])
            apart = (100 * np.minimum(index.sizes, size) >= 75 * np.maximum(index.sizes, size)) & (label[:n] != label[q])
            if not apart.any():
                continue
            for m in divide_skip(index.lists(sets[q]), np.where(apart, required(index.sizes, size), size + 1)).tolist():
                if label[m] != label[q]:
                    links.append((classes[q], classes[m]))
                    label[label == label[m]] = label[q]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _band(n: Column) -> Column:
    """Sets that link are in the same band of sizes or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(1.34))


def open_links(members: DataFrame, labels: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) that join components which meet in some list; None if no list spans components."""
    known = members.join(labels.select(F.col("node").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    tally = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    spans = tally.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("length"))
    spans = spans.where("parts > 1").select("token", "major", "length")
    lists = known.join(spans, "token").select("token", "a", "n", "label", "length", (F.col("label") != F.col("major")).alias("query"))
    lists = materialize(lists, "lists")
    if lists.isEmpty():
        return None
    # A member's block is that of its longest open list and its size.
    homes = lists.groupBy("a").agg(F.max_by("token", F.struct("length", "token")).alias("home"), F.max("n").alias("n"), F.max("label").alias("label"))
    homes = homes.withColumn("band", _band(F.col("n")))
    loads = homes.groupBy("home", "band").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    block = ["home", "band", "part"]
    placed = homes.join(loads, ["home", "band"]).withColumn("part", F.pmod(F.xxhash64("a"), "parts")).drop("parts")
    placed = materialize(placed, "placed")
    # One of two members in different components is outside the main component of their list.
    where = lists.select("token", "a").join(placed.select("a", *block), "a").select("token", *block).distinct()
    asked = lists.where("query").select("token", "a", "n", "label", _band(F.col("n")).alias("own"))
    near = F.abs(F.col("own") - F.col("band")) <= 1
    routes = materialize(asked.join(where, "token").where(near).select("a", "n", "label", *block).distinct(), "routes")
    turns = routes.groupBy(*block).agg(F.ceil(F.sum("n") / BLOCK).alias("turns"))
    queries = routes.join(turns, block).select("a", "label", *block, F.pmod(F.xxhash64("a", F.lit(1)), "turns").alias("turn"), F.lit(True).alias("query"))
    held = placed.join(turns, block).select("a", "label", *block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("query"))
    named = queries.union(held).join(classes.select(F.col("class").alias("a"), F.col("first_id").alias("a_id")), "a")
    filled = named.join(sets.select(F.col("class").alias("a"), F.col("doc_id").alias("a_id"), "hashes").hint("merge"), ["a", "a_id"])
    return materialize(filled.groupBy(*block, "turn").applyInPandas(_link_block, "a long, b long"), "links")


def link_classes(docs: DataFrame, levels: np.ndarray, classes: DataFrame, total: int) -> DataFrame:
    """(node, label) of all classes that link with another; the label is the smallest class of the component."""
    classes = classes.select("class", F.coalesce("first_id", F.lit(0)).alias("first_id"))
    found = short_lists(docs, levels, total)
    pairs = materialize(candidates(found), "pairs")
    members = found.where("kind = 1").select("token", "a", "n")
    active = members.select("a").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = class_sets(docs, active.join(classes, active.a == classes["class"]).select("class", "first_id"), total)
    labels = connected(verify(pairs, sets, classes).where("linked").select("a", "b"))
    fresh = open_links(members, labels, sets, classes)
    if fresh is None or fresh.isEmpty():
        return labels
    return connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(fresh))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of each document."""
    small_batches(docs.sparkSession)
    signed, levels = sign_documents(docs)
    classes = signed.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    labels = materialize(link_classes(docs, levels, classes, total).withColumnRenamed("node", "class"), "labels")
    linked = labels.join(classes, "class")
    least = linked.groupBy("label").agg(F.min("first_id").alias("least_id"))
    named = materialize(
        classes.join(labels.join(least, "label").select("class", "least_id"), "class", "left")
        .select("class", F.coalesce("least_id", "first_id").alias("component_id")),
        "named",
    )
    # One class may hold very many documents: both sides are plain tables, so Spark can split it.
    return signed.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
