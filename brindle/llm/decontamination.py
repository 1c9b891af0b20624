"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Items are cut into windows of ``window`` words (a shorter item is one window), and
windows into shingles of three words (fewer where the window is shorter):

1. One pass counts, in all texts, the shingles that windows have; only counts are
   shuffled. They order the shingles by rarity.
2. A window is contained whole or not at all, so its necessary prefix is its rarest
   shingle; a window with a shingle that no text has cannot occur. A second pass
   joins the texts to these prefixes alone. The start that an occurrence implies must
   leave room for the whole window (bounds of position and length).
3. Candidates are verified at their start: the words of the text there must be the
   window's.

Item tables are broadcast up to ``MAX_BROADCAST`` bytes; a candidate's words are then
cut out as it is found. Beyond that they are joined by a shuffle, and only the texts
with candidates are read again for their words. What a text holds depends on the text
alone, so results are joined to the documents by its SHA-256.

Defined cases: a null or empty text or item has no words; a null id stays null
(a null item id counts as an empty text); repeated documents are reported each,
items with the same id count once; empty tables give no hits; extra columns of
either input are ignored; the words of a very long text are held by its row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize
from brindle.llm.words import word_rows, words

SHINGLE = 3
#: Bytes of an item-side table that may be broadcast.
MAX_BROADCAST = 32_000_000
_PARTS = ("a", "b", "c")
_SENTINEL_KEY = 0


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """Distinct windows with the items that have them: (item_id, window, n_words, size)."""
    listed = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return (
        listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("window"))
        .distinct()
        .withColumn("n_words", F.size("window").cast("long"))
        .withColumn("size", F.least(F.size("window"), F.lit(SHINGLE)))
    )


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, w_words, size, n_shingles, offset, a, b, c): the shingles of distinct windows in order."""
    starts = F.sequence(F.lit(1), F.size("window") - F.col("size") + 1)
    each = windows.select("window", F.col("n_words").alias("w_words"), "size", F.size(starts).alias("n_shingles"), F.posexplode(starts).alias("offset", "at"))
    part = lambda k: F.when(F.col("size") > k, F.element_at("window", F.col("at") + k))
    return each.select("window", "w_words", "size", "n_shingles", "offset", *[part(k).alias(p) for k, p in enumerate(_PARTS)])


def _fits(df: DataFrame) -> bool:
    """Whether the rows of a written table take no more than ``MAX_BROADCAST`` bytes."""
    text = lambda c, kind: F.octet_length(F.array_join(c, " ") if kind.startswith("array") else F.col(c))
    texts = [F.coalesce(text(c, kind), F.lit(0)) for c, kind in df.dtypes if "string" in kind]
    return (df.agg(F.sum(sum(texts, F.lit(24 * len(df.columns))))).first()[0] or 0) <= MAX_BROADCAST


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if it fits."""
    return F.broadcast(df) if _fits(df) else df


def _key() -> Column:
    return F.xxhash64(*_PARTS)


def text_shingles(docs: DataFrame, sizes: list[int], whole: bool = False) -> DataFrame:
    """(digest, doc_id, n_words, pos, h, a, b, c) of each shingle of the sizes of each text, and a row with pos 0 and the
    sentinel's key for each document. Words count from 1. ``docs`` has doc_id, text and digest; ``whole`` as in ``word_rows``."""
    rows = word_rows(docs, "text", "digest", "doc_id", whole=whole).drop("row")
    same = [c for c in rows.columns if c not in _PARTS]
    if sizes != [SHINGLE]:
        cut = lambda s: F.struct(*[(F.col(p) if k < s else F.lit(None).cast("string")).alias(p) for k, p in enumerate(_PARTS)])
        last = lambda s: F.col(_PARTS[s - 1]).isNotNull() & ((F.col("pos") > 0) | F.lit(s == sizes[0]))
        each = F.explode(F.array_compact(F.array(*[F.when(last(s) | (F.col("pos") == 0) & F.lit(s == sizes[0]), cut(s)) for s in sizes]))).alias("z")
        rows = rows.select(*same, each).select(*same, "z.*")
    return rows.withColumn("h", F.when(F.col("pos") == 0, F.lit(_SENTINEL_KEY)).otherwise(_key()))


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Equal keys and equal words."""
    condition = left["h"] == right["h"]
    for p in _PARTS:
        condition = condition & left[p].eqNullSafe(right[p])
    return condition


def count_shingles(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(a, b, c, n): how often each of ``shingles`` (a, b, c) occurs in the texts."""
    keyed = _bounded(materialize(shingles.withColumn("h", _key()), "shingles"))
    texts = text_shingles(docs, sizes).where("pos > 0")
    return texts.join(keyed, _same(texts, keyed)).groupBy(*[keyed[p] for p in _PARTS]).agg(F.count(F.lit(1)).alias("n"))


def prefixes(shingled: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, w_words, offset, a, b, c): the rarest shingle of each window of which every shingle occurs."""
    same = shingled["a"].eqNullSafe(counts["a"]) & shingled["b"].eqNullSafe(counts["b"]) & shingled["c"].eqNullSafe(counts["c"])
    return (
        shingled.join(counts.withColumnRenamed("n", "occurs"), same)
        .groupBy("window", "w_words", "n_shingles")
        .agg(F.count(F.lit(1)).alias("present"), F.min_by(F.struct(shingled["offset"], *[shingled[p] for p in _PARTS]), F.struct("occurs", shingled["offset"])).alias("rarest"))
        .where("present = n_shingles")
        .select("window", "w_words", "rarest.*")
    )


def find_candidates(docs: DataFrame, prefix: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per document (start null), and (digest, start, w_words, window, found) of each place where a window may stand;
    ``found``: the words there, or null if they are still to be read."""
    spark = docs.sparkSession
    sentinel = spark.createDataFrame([(None,) * 6], "window array<string>, w_words long, offset int, a string, b string, c string")
    table = prefix.withColumn("h", _key()).union(sentinel.withColumn("h", F.lit(_SENTINEL_KEY).cast("long")))
    table = materialize(table, "prefixes").withColumnsRenamed({p: f"w{p}" for p in _PARTS})
    small = _fits(table)
    texts = text_shingles(docs, sizes, whole=small)
    start = F.col("pos") - F.col("offset")
    words_equal = F.lit(True)
    for p in _PARTS:
        words_equal = words_equal & F.col(p).eqNullSafe(F.col(f"w{p}"))
    itself = (F.col("pos") == 0) & F.col("window").isNull()
    place = (F.col("pos") > 0) & words_equal & (start >= 1) & (start + F.col("w_words") - 1 <= F.col("n_words"))
    joined = texts.join(F.broadcast(table) if small else table, (texts["h"] == table["h"]) & (itself | place))
    found = F.slice("w", start.cast("int") + 1, F.col("w_words").cast("int")) if small else F.lit(None).cast("array<string>")
    at = F.col("pos") > 0
    return joined.select("digest", "doc_id", "n_words", F.when(at, start).alias("start"), "w_words", "window", F.when(at, found).alias("found"))


def verified(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(digest, start, w_words, window) of the candidates at whose start the text has the window's words."""
    read = candidates.where("start is not null and found = window").select("digest", "start", "w_words", "window")
    places = candidates.where("start is not null and found is null")
    places = places.select("digest", F.struct(F.col("start").cast("int").alias("start"), "w_words", "window").alias("p")).distinct()
    if places.isEmpty():
        return read
    by_text = places.groupBy("digest").agg(F.collect_list("p").alias("places"))  # as many as a text has places
    texts = docs.join(by_text.select("digest"), "digest", "left_semi").select("digest", "text").dropDuplicates(["digest"])
    listed = texts.join(by_text, "digest").select("digest", words(F.col("text")).alias("w"), "places")
    true = F.filter("places", lambda p: F.slice("w", p["start"], p["w_words"].cast("int")) == p["window"])
    late = listed.select("digest", F.explode(true).alias("p")).select("digest", F.col("p.start").cast("long").alias("start"), "p.w_words", "p.window")
    return read.union(late)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    windows = materialize(item_windows(items, window), "windows")
    shingled = materialize(window_shingles(windows.drop("item_id").distinct()), "shingled")
    sizes = sorted(r[0] for r in shingled.select("size").distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers
    counts = materialize(count_shingles(docs, shingled.select(*_PARTS).distinct(), sizes), "counts")
    candidates = materialize(find_candidates(docs, prefixes(shingled, counts), sizes), "candidates")
    found = materialize(verified(docs, candidates), "found")
    # Words inside any found window: the windows' union, from their ends in order of start.
    order = Window.partitionBy("digest").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = (
        found.select("digest", "start", (F.col("start") + F.col("w_words") - 1).alias("end"))
        .distinct()
        .withColumn("n", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, reached)))
        .groupBy("digest")
        .agg(F.sum("n").alias("n_hit"))
    )
    listed = (
        found.select("digest", "window").distinct()
        .join(_bounded(windows.select("window", "item_id")), "window")
        .groupBy("digest")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    results = materialize(hits.join(listed, "digest"), "results")
    empty = F.array().cast("array<string>")
    return (
        candidates.where("start is null").select("digest", "doc_id", "n_words")
        .join(_bounded(results), "digest", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", empty)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", empty), ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
