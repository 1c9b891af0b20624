import hashlib
import io
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import bpe, common, licenses, media, packing, sharding, token_counts, warc
from brindle.llm.common import LOWER, UPPER, WORD_PATTERN, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens int, row int"
#: Nulls, empty and odd texts, ties, repeated rows, and columns whose names the results use too.
ODD = [
    (1, "Hello  world, it's <|endoftext|> here", 9, 9), (2, "", 9, 9), (3, None, 9, 9), (None, "a b", 9, 9), (5, "x" * 70_000, 9, 9),
    (6, "日本語 text mixed\n\n  end ", 9, 9), (7, "same text here", 9, 9), (7, "same text here", 9, 9), (8, "word " * 3000, 9, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


# Sharding


def brute_fill(shards, size):
    """The table by writing out each shard's whole order of preference."""
    h = lambda x: int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big")
    order = [[(h(f"offset/{s}") + k * (h(f"stride/{s}") % (size - 1) + 1)) % size for k in range(size)] for s in shards]
    assert all(sorted(o) == list(range(size)) for o in order)
    table = [None] * size
    while None in table:
        for k, o in enumerate(order):
            slot = next((s for s in o if table[s] is None), None)
            if slot is not None:
                table[slot] = k
    return table


def test_fill_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    assert table == brute_fill(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer)) / 1009
    assert moved < 0.25
    heavy = np.bincount(sharding.fill_table(names[:2], 1009, [1, 3]))
    assert abs(heavy[1] / heavy[0] - 3) < 0.05
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_assignment(spark, docs, tmp_path):
    clash = docs.withColumnRenamed("row", "shard")
    out = sharding.assign_shards(clash, "doc_id", ["a", "b", "c"], 101)
    assert out.columns == ["doc_id", "text", "n_tokens", "slot", "shard"]
    table = sharding.fill_table(["a", "b", "c"], 101)
    for r in out.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == table[r.slot]
    assert out.count() == len(ODD)
    assert sharding.assign_shards(docs.limit(0), "doc_id", ["a"], 7).count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"), salts=2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ODD)


def test_assignment_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "keepme", "S", 7, "x"), (2, "too", "T", 8, "y")], "slot long, _slot string, Shard string, _brindle int, `a.b` string")
    out = sharding.assign_shards(df, "slot", ["a", "b"], 101)
    assert out.columns == ["_slot", "_brindle", "a.b", "slot", "shard"]
    got = {r["_slot"]: r for r in out.collect()}
    for key, name in ((1, "keepme"), (2, "too")):
        assert got[name].slot == int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16) % 101 and got[name]["_brindle"] == 6 + key


# Tokens


def test_other_scripts_take_both_tiers(spark, monkeypatch):
    """The library never sees a whole text: units of any script are looked up."""
    parts = ["it’s", "—", "日本語", " ", "  ", "\u3000", "\u3000\u3000 ", "\u2003", "привет", "мир ", "αβγ", "🙂", "e\u0301", "x", "\n", "١٢", "\u00a0", "don't ", "कि"]
    whole, own, rng = Tokenizer.from_file(VOCABULARY), bpe.PieceTokenizer(VOCABULARY), random.Random(8)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]

    class Blind:
        def encode(self, *a, **b):
            raise AssertionError("the whole text went to the library")

        pre_tokenizer = own.whole.pre_tokenizer

    own.whole = Blind()
    for t, ids in zip(texts, want):
        packed = own.packed_ids(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids and own.count(t) == len(ids), repr(t)
    found = {r.piece for r in token_counts.frequent_pieces(spark.createDataFrame([(t,) for t in texts], "text string"), VOCABULARY).collect()}
    assert {"привет", "日本語", "’", " "} <= found


def test_pieces_equal_the_library():
    whole, own = Tokenizer.from_file(VOCABULARY), bpe.PieceTokenizer(VOCABULARY)
    rng, parts = random.Random(1), ["a", "b ", "  ", " ", "\n", "'s", "'", "é", "1", "²", "\xa0", "!", "\x85", "\x1c", "'ll", "Z", ".", "\t", "_", "ſ", "日", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t, *_ in ODD]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        ids = own.packed_ids(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and own.count(t) == len(want), t


def test_counts(docs):
    whole = Tokenizer.from_file(VOCABULARY)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, VOCABULARY, context=100, table_size=5).select("n_bytes", "n_tokens", "over_limit").collect())
    want = [(len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in ODD]
    assert got == sorted((b, n, n > 100) for b, n in want)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_packed_table():
    lengths = {" the": 1, "é": 2, "": 3}
    assert token_counts.unpacked_table(token_counts.packed_table(lengths)) == lengths
    assert token_counts.unpacked_table(token_counts.packed_table({})) == {}


# Packing


def check_packing(rows, docs, capacity):
    whole = Tokenizer.from_file(VOCABULARY)
    ids = {k: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for k, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, pieces in by_doc.items():
        at = 0
        for n, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (n, at)
            assert zlib.crc32(np.array(ids[k][at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            assert p.length == capacity or n == 0
            at += p.length
        assert at == len(ids[k])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence), -(-sum(map(len, ids.values())) // capacity)


def test_packing(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(["red", "blue", "a", "longer"]) for _ in range(int(rng.expovariate(1 / 60))))) for k in range(400)] + [(400, None), (401, ""), (402, "w " * 700)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), VOCABULARY, capacity=128).collect()
    used, least = check_packing(rows, docs, 128)
    assert used <= least + 1


def test_packing_odd_rows(docs):
    assert packing.pack_documents(docs, VOCABULARY).where("piece = 0").count() == len(ODD)
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_plan_uses_everything():
    rng = np.random.default_rng(0)
    for capacity in (16, 100):
        counts = {int(k): int(v) for k, v in enumerate(rng.integers(0, 30, capacity + 1)) if k and v}
        got = {}
        for lengths, times in packing.plan_patterns(counts, capacity):
            assert sum(lengths) <= capacity and times > 0
            for n in lengths:
                got[n] = got.get(n, 0) + times
        assert got == counts
    with pytest.raises(ValueError):
        packing.plan_patterns({17: 1}, 16)


def test_sum_index():
    lengths, left = np.array([1, 2, 3, 5, 8, 13]), np.zeros(20, np.int64)
    left[lengths] = 1
    left[8] = 2
    index = packing.SumIndex(lengths, 20)
    for total in range(1, 20):
        pairs = {(b, c) for b in lengths.tolist() for c in lengths.tolist() if b >= c and b + c == total}
        assert set(index.pairs(total, 19, left + 5)) == pairs
        triples = {(b, c, d) for b in lengths.tolist() for c, d in ((c, d) for c in lengths.tolist() for d in lengths.tolist()) if b >= c >= d and b + c + d == total}
        assert set(index.triples(total, 19, left + 5)) == triples
    gone = left.copy()
    gone[5] = 0
    assert list(index.pairs(6, 19, left)) == [(5, 1), (3, 3)] and list(index.pairs(6, 19, gone)) == [(3, 3)]
    # exact complements: a single, a pair and a triple fill their sequences
    assert sorted(packing.plan_patterns({12: 1, 4: 1, 10: 1, 5: 1, 1: 1}, 16)) == [((10, 5, 1), 1), ((12, 4), 1)]
    assert packing.plan_patterns({9: 2, 4: 2, 2: 2, 1: 2}, 16) == [((9, 4, 2, 1), 2)]


def test_empty_plan():
    assert packing.plan_patterns({}, 16) == []


# Media


def test_media_round_trip(docs):
    rows = media.read_media(media.encode_media(docs)).collect()
    assert len(rows) == len(ODD)
    want = {}
    for k, t, *_ in ODD:
        raw = (t or "").encode()
        want[k] = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
    for r in rows:
        payload = want[r.doc_id]
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and len(r.phash) == 8
    same = [r for r in rows if r.doc_id == 7]
    assert same[0] == same[1]
    assert media.read_media(media.encode_media(docs.limit(0))).count() == 0


def test_media_columns_against_brute_force(spark, docs):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (1, 63, 64, 65, 700)] + ["row of text, repeated." * 60, "z" * 300_000, ""]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    stored = materialize(media.encode_media(df), "media")
    images = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in media.read_media(stored).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        data = images[r.doc_id]
        assert (r.n_bytes, r.media_bytes, r.media_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        if len(payload) > 5000:
            continue
        height, terms = len(payload) // 64, []
        for u in range(1, 9):
            for v in range(1, 9):
                total = sum(payload[64 * y + x] * math.cos(math.pi / height * (y + 0.5) * u) * math.cos(math.pi / 64 * (x + 0.5) * v) for y in range(height) for x in range(64))
                terms.append(round(total / height / 64, 9))
        middle = sorted(terms)[31] / 2 + sorted(terms)[32] / 2
        bits = "".join(str(int(t > middle)) for t in terms)
        assert sum(a != b for a, b in zip(bits, f"{int.from_bytes(bytes(r.phash)):064b}")) <= (0 if len(set(map(abs, terms))) > 32 else 64)


def test_rows_choose_their_filters():
    rng = np.random.default_rng(4)
    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog, and then it sleeps.", np.uint8)
    rows = np.vstack([text, text, np.arange(64), np.arange(64) + 1, rng.integers(0, 255, 64), np.zeros(64)]).astype(np.uint8)
    kinds = media.filtered(rows)[:, 0]
    assert kinds[0] == media.FILTER_NONE and kinds[1] == media.FILTER_UP and kinds[2] == media.FILTER_SUB and kinds[5] == media.FILTER_NONE
    every = [media.filtered(rows)[k, 1:] for k in range(len(rows))]
    for k, row in enumerate(every):  # no filter leaves fewer distinct values
        assert len(set(row.tolist())) == min(len(set(filtered(rows.tolist(), [f] * len(rows))[k].tolist())) for f in range(5))
    ramp = np.add.outer(np.arange(40), 3 * np.arange(64)).astype(np.uint8)
    assert (media.decode_png(media.encode_png(ramp.tobytes())) == ramp).all() and media.filtered(ramp)[:, 0].any()


def filtered(rows, kinds):
    """PNG's row filters by definition, byte by byte."""
    out = []
    for y, row in enumerate(rows):
        up = rows[y - 1] if y else [0] * len(row)
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda q: (abs(p - q), (a, b, c).index(q)))
            line.append((v - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


def test_all_row_filters():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (25, 64))
    for kinds in ([k % 5 for k in range(25)], [1] * 25, [2] * 25, [3] * 25, [4] * 25, [0] * 25):
        assert (media.unfilter(np.array(kinds), filtered(rows.tolist(), kinds)) == rows).all()


def test_broken_images():
    good = media.encode_png(media.pad(b"some text"))
    flipped = bytearray(good)
    flipped[45] ^= 1
    for bad in (b"x" + good, bytes(flipped), good[:-12], good[:30]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_hash_is_like_for_like_pictures():
    a = np.kron(np.random.default_rng(3).integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    noise = np.random.default_rng(0).integers(0, 3, a.shape).astype(np.uint8)
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    other = np.random.default_rng(1).integers(0, 256, a.shape).astype(np.uint8)
    assert (bits(a) != bits(a // 2 + noise // 2)).sum() <= 4 < 16 < (bits(a) != bits(other)).sum()


# WARC


def test_warc_round_trip(spark):
    big, other = "<p>" + "payload " * 30, "é" * 60
    pages = [(5, "http://a/ b", big), (2, "u2", big), (9, None, big), (3, "u3", "short"), (4, "u4", "short"), (6, "u6", None), (7, "u7", other), (8, "u8", other), (None, "n", big), (2, "u2", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload_digest string").repartition(3)
    manifest = warc.write_archives(df, file_bytes=600)
    rows = warc.read_archives(manifest, split_bytes=100).collect()
    assert len(rows) == len(pages)
    for r in rows:
        text = next(h for i, _, h in pages if i == r.page_id) or ""
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == hashlib.sha256(text.encode()).hexdigest()
        first = {big: 2, other: 7}.get(text)
        revisit = first is not None and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == text.encode()
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    rows = [(k, f"u{k}", f"<p>{k} " + "text " * 60) for k in range(300)] + [(1000 + k, "d", "<p>same " * 40) for k in range(300)] + [(2000 + k, "e", "") for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    marked = warc.mark_revisits(df)
    assert marked.where("record_type = 'revisit' and payload is not null").isEmpty() and marked.where("record_type = 'revisit'").count() == 299
    found = warc.read_archives(warc.write_archives(df), split_bytes=2000)
    by_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 8 and sum(r["count"] for r in by_task) == len(rows)
    long = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.read_archives(warc.write_archives(long), split_bytes=500).collect()) == [(1, 3_000_000, None), (2, 3_000_000, 1)]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**6])
def test_each_record_has_one_owner(split):
    rng = random.Random(5)
    payloads = [bytes(rng.randbytes(rng.randint(0, 400))) + warc.MAGIC * 3 for _ in range(20)]
    records = [warc.encode_record(k, "u", p, len(p), "d", "response", None, "d") for k, p in enumerate(payloads)]
    junk = b"\x1f\x8b\x08junk" + zlib.compress(b"x")
    data = junk + b"".join(records) + junk
    found = [r for at in range(0, len(data), split) for r in warc.split_records(io.BytesIO(data), at, min(at + split, len(data)), len(data), block=64)]
    assert [re.search(rb"Record-ID: <urn:page:(\d+)>", r)[1] for r in found] == [str(k).encode() for k in range(20)]


def test_wrong_digest_is_found():
    record = warc.encode_record(1, "u", b"abc", 3, hashlib.sha256(b"abd").hexdigest(), "response", None, "d")
    with pytest.raises(ValueError):
        warc.decode_record(next(warc.split_records(io.BytesIO(record), 0, len(record), len(record))))


# Licences

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute_base(text):
    w = re.findall(WORD_PATTERN, (text or "").translate(str.maketrans(UPPER, LOWER)))
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark):
    rng, words = random.Random(4), ["under", "the", "MIT", "license", "apache", "version", "2", "CC", "by", "nc", "É", "x"]
    texts = [rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["Released under the MIT License. under the MIT-license", "Licensed under CC BY-NC 4.0.", None, "", "!!", "under the mit license " * 2000]
    rows = list(enumerate(texts)) + [(None, "cc by nc"), (0, texts[0])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, label string")
    got = licenses.scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, got)) == sorted(key((i, *brute_base(t))) for i, t in rows)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_templates_survive_edits(spark):
    mit = next(t.text for t in licenses.TEMPLATES if t.label == "mit" and not t.exact)
    edited = mit.replace("hereby ", "").replace("software and", "software package and")
    texts = [mit, "intro words. " + edited, mit[:60], "This work is licensed under the GNU General Public License, version 3.", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[k].labels for k in range(5)] == ["mit", "mit", "", "gpl-3", ""]
    assert got[0].score == 1 and 0.75 <= got[1].score < 1 and got[4].score == 0


def test_license_spans_are_verified(spark):
    """Words of a template that are strewn over a text, or stand in another order, are no span."""
    gpl = "licensed under the gnu general public license version 3".split()
    strewn = " x ".join(" ".join(gpl[i : i + 3]) for i in range(len(gpl) - 2))
    backwards = " ".join(" ".join(gpl[i : i + 3]) for i in range(len(gpl) - 3, -1, -1))
    inserted = " ".join([*gpl[:4], "now", *gpl[4:]])
    twice = " ".join(gpl * 2)
    df = spark.createDataFrame(list(enumerate([strewn, backwards, inserted, twice, " ".join(gpl)])), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    assert got[0] == got[1] == got[2] == ("", 0.0)  # one word inserted breaks two of seven sequences
    assert got[3] == got[4] == ("gpl-3", 1.0)
    spans = licenses.find_spans(licenses.matches(df)).where("tid >= 0")
    assert sorted((r.doc_id, r.start) for r in spans.collect()) == [(3, 0), (3, 9), (4, 0)]


def test_license_plan_is_native(docs):
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_recent_values_keep_frequent_keys_within_two_generations():
    asked = []
    held = bpe.RecentValues(lambda k: asked.append(k) or k.encode(), 10)
    for k in range(1000):
        assert held["often"] == b"often" and held[str(k)] == str(k).encode()
        assert len(held) + len(held.older) <= 20
    assert asked.count("often") == 1  # a cache that fills up once would keep the first keys only
    assert held["x" * 65] == b"x" * 65 and "x" * 65 not in held


def test_ids_of_words_with_marks_equal_the_librarys():
    whole, own = Tokenizer.from_file(VOCABULARY), bpe.PieceTokenizer(VOCABULARY, cache=8)
    texts = ["", " ", "a ", " a", "word, word. word! don't we'll, ab1, 12. über, ÜBER: ﬁ, x\n y\t, ,a .b", "the the, the; the ,the the.. ..the", "日本, 語. a b, c"]
    for t in [*texts, " ".join(texts), "  ".join(texts), " ".join(texts) * 3]:
        assert own.packed_ids(t) == b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids)


def test_texts_come_in_small_batches(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'some text' as text").coalesce(1)
    packing.cut_pieces(docs, VOCABULARY)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) <= common.BATCH_ROWS
