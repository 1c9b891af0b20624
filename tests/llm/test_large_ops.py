import math
import random
import re
import statistics
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from brindle.llm import components, decontamination, filters, jaccard, katz, quality, spaced
from brindle.llm.common import LOWER, UPPER, WORD_PATTERN, materialize
from brindle.llm.packed import pack, small, unpack

ASCII = str.maketrans(UPPER, LOWER)


def words(text):
    return re.findall(WORD_PATTERN, (text or "").translate(ASCII))


def test_packed_arrays():
    for a in (np.zeros(0, np.uint64), np.arange(1000, dtype=np.int64), np.array([2**63], np.uint64), np.array([1.5, -2.0])):
        assert (unpack(pack(a)) == a).all()
    assert small(np.array([1, 2**33])).dtype == np.uint64 and small(np.array([1])).dtype == np.uint32


def test_key_filter(spark):
    keys = spark.createDataFrame([(k,) for k in (0, -1, 5, 2**62, None)], "k long")
    bits = filters.key_filter(keys, "k").value
    assert filters.holds(bits, np.array([0, -1, 5, 2**62]).view(np.uint64)).all()
    assert not filters.holds(bits, np.array([1, 7, -3]).view(np.uint64)).any()
    df = spark.createDataFrame([(k,) for k in (0, 1, 5, None)], "k long")
    sure, rest = filters.split_rows(df, df.k, filters.key_filter(keys, "k"))
    assert sorted([r.k for r in sure.collect()], key=str) == [1, None] and sorted(r.k for r in rest.collect()) == [0, 5]


# Decontamination


def brute_hits(text, items, size=10):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        x = words(item)
        n = min(size, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add("" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, monkeypatch, short):
    import hashlib

    rng, vocabulary = random.Random(7), ["a", "b", "C", "dé", "e1"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(10, 16))) for k in range(8)] + [(20, None), (21, ""), (22, "one two three four five six seven eight nine ten eleven")]
    items += [(23, "e1 e1 e1 a"), (24, "zz"), (25, "a b")] if short else []
    items += [items[0], (None, items[1][1])]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(100 + k, text(9) + " " + t + " " + text(5)) for k, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (None, items[2][1]), (202, items[3][1]), (202, items[3][1]), (203, (items[4][1] + " ") * 200)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, pos int, shingle string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, window string")
    got = decontamination.decontaminate(d, b)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    want = []
    for k, t in docs:
        n, hit, ids = brute_hits(t, items)
        want.append((str(k), n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == sorted(want)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", 0)  # nothing fits: shuffles, and words that are read again
    assert sorted((str(r.doc_id), *r[1:]) for r in decontamination.decontaminate(d, b).collect()) == sorted(want)
    monkeypatch.undo()
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    assert decontamination.decontaminate(d, b.limit(0)).where("contaminated").count() == 0


def test_only_prefixes_make_candidates(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(k, "alpha beta gamma delta epsilon zeta eta theta") for k in range(30)] + [(100, item), (101, "iota kappa eta theta iota")]
    d = spark.createDataFrame([(k, t, str(k)) for k, t in docs], "doc_id long, text string, digest string")
    windows = materialize(decontamination.window_shingles(decontamination.item_windows(spark.createDataFrame([(1, item)], "item_id long, text string"))), "w")
    counts = materialize(decontamination.count_shingles(d, windows.select("a", "b", "c").distinct(), [3]), "c")
    prefix = decontamination.prefixes(windows, counts)
    assert [(r.offset, r.a, r.c) for r in prefix.collect()] == [(7, "theta", "kappa")]  # of the two rarest the first
    places = decontamination.find_candidates(d, prefix, [3]).where("start is not null")
    assert [(r.digest, r.start) for r in places.collect()] == [("100", 1)]
    every = windows.select("window", "w_words", "offset", "a", "b", "c")  # no prefix filter
    assert decontamination.find_candidates(d, every, [3]).where("start is not null").count() > 1
    lone = decontamination.find_candidates(spark.createDataFrame([(1, "theta iota kappa", "d")], d.schema), prefix, [3])
    assert lone.where("start is not null").isEmpty()  # no room before it


# Components and the Jaccard join


def brute_components(nodes, links):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + k, 401 + k) for k in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components.connected(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components(nodes, [(a, b) for a, b in links if a != b])
    assert components.connected(df.limit(0)).count() == 0


def brute_sets(docs):
    out = []
    for k, t in docs:
        w = (t or "").translate(ASCII).split()
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII)) if x]
        n = min(5, len(w))
        out.append((k, {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()))
    return out


def brute_join(docs):
    sets = brute_sets(docs)
    links = []
    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((i, j))
    label = brute_components(range(len(docs)), links)
    groups = defaultdict(list)
    for i, l in label.items():
        groups[l].append(i)
    least = {l: min((docs[i][0] for i in g if docs[i][0] is not None), default=None) for l, g in groups.items()}
    return sorted((str(docs[i][0]), len(sets[i][1]), str(least[label[i]])) for i in range(len(docs)))


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(11)
    new = lambda n, k=400: [f"w{rng.randrange(k)}" for _ in range(n)]
    texts = [None, "", "one", "one", "two words", "TWO words", "a b c d e", "a b c d e f", " \t\n", "É b c d", "é b c d"]
    texts += near_copies(rng, new(120), 60, 5)  # a large group, not all of whose pairs link
    for n in (20, 40, 90):
        for _ in range(8):
            texts += near_copies(rng, new(n), 4, 3)
    passage = new(60)
    texts += [" ".join([*new(rng.randint(5, 60)), *passage, *new(rng.randint(0, 30))]) for _ in range(40)]
    texts += [" ".join(passage[:k]) for k in range(30, 60)]
    texts += [texts[20]] * 5
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[30]), (None, "alone here"), (3, "one")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, a int, token string").repartition(4)
    want = brute_join(docs)
    result = lambda: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    assert result() == want
    # Lists of frequent shingles split over partitions, small blocks and several copies of a pivot's set: the same result.
    monkeypatch.setattr(jaccard, "HOT_COUNT", 8)
    monkeypatch.setattr(jaccard, "HOT_FACTOR", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 3)
    assert result() == want
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(near_copies(rng, base, 2000, 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    signed, levels = jaccard.sign_documents(df)
    pairs = jaccard.candidates(jaccard.short_lists(df, levels, 300_000)).count()
    assert pairs <= 2000  # one a member at most
    labels = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    sets = [s for _, s in brute_sets(docs)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert labels == brute_components(range(len(sets)), links) and len(set(labels.values())) > 1


def test_jaccard_very_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    texts = [" ".join(long), " ".join([*long[:30_000], "x", *long[30_000:]]), " ".join(long[:20_000]), "y" * 700_000, "Y" * 700_000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert [r.component_id for r in jaccard.jaccard_components(df).orderBy("doc_id").collect()] == [0, 0, 2, 3, 3]
    hashes = spaced.word_hashes(texts[1].encode())
    monkeypatch.setattr(spaced, "STRETCH", 100)
    assert (spaced.word_hashes(texts[1].encode()) == hashes).all() and len(hashes) == 60_001


def test_word_hashes():
    words_of = lambda b: b.lower().split()
    seen = {}
    for text in (b"", b" ", b"a", b"A a\tB\x0bb\x1cb", "\u00c9\u00e9 \u2028x \x85".encode(), bytes(range(256)), b"ab ba a b aa"):
        found = spaced.word_hashes(text).tolist()
        assert len(found) == len(words_of(text))
        for w, h in zip(words_of(text), found):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_divide_skip():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(rng.integers(1, 30))]
        query = np.unique(rng.integers(0, 60, 25).astype(np.uint64))
        needs = jaccard.required(np.array([len(s) for s in sets]), len(query))
        found = jaccard.divide_skip(jaccard.BlockIndex(sets).lists(query), needs)
        assert sorted(found.tolist()) == [i for i, s in enumerate(sets) if len(np.intersect1d(s, query)) >= needs[i]]


def test_required_overlap():
    for x in range(1, 60):
        for y in range(x, 60):
            assert jaccard.required(x, y) == next(i for i in range(200) if 100 * i >= 75 * (x + y - i))
    a, b = np.arange(0, 9000, dtype=np.uint64), np.arange(900, 9900, dtype=np.uint64)
    assert jaccard.links_of(a, b) and not jaccard.links_of(a, b + np.uint64(800))
    assert jaccard.heap_merge([np.array([1, 4]), np.array([1, 2]), np.array([4])]) == [(1, 2), (2, 1), (4, 2)]


# Katz


def own_tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII)) if w] + ["</s>"]


def brute_katz(docs):
    tok = {k: own_tokens(t) for k, t in docs}
    train = {k for k in tok if zlib.crc32(str(k).encode()) % 5 != 1}
    uni = Counter(w for k in train for w in tok[k])
    bi = Counter(p for k in train for p in zip(["<s>", *tok[k][:-1]], tok[k]))
    n, v = sum(uni.values()), len(uni)
    discount = [0, *smooth_discounts(bi)]
    assert all(0 < d < 1 for d in discount[1:])  # Good-Turing's, not the fallback
    prob = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    share = lambda c: discount[c] if c <= 5 else 1.0
    after = defaultdict(list)
    for (a, b), c in bi.items():
        after[a].append((b, c))
    weight = {}
    for a, f in after.items():
        below = sum(c for _, c in f)
        left = below - sum(share(c) * c for _, c in f)
        if left <= 1e-9 * below:
            below, left = below + 1, 1
        weight[a] = (left / below / (1 - sum(prob(b) for b, _ in f)), below)

    def p(a, b):
        return share(bi[a, b]) * bi[a, b] / weight[a][1] if bi[a, b] else weight.get(a, (1, 1))[0] * prob(b)

    for a in list(after)[:20]:  # every context's probabilities add up to one
        assert abs(sum(p(a, b) for b in uni) + p(a, "an unknown word") - 1) < 1e-9
    rows = {}
    for k, t in tok.items():
        base = sum(math.log10(prob(w)) for w in t)
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t[:-1]], t))
        rows[k] = (k not in train, len(t), sum(w in uni for w in t), n, base, score)
    return rows


@pytest.mark.parametrize("chunk", [10**6, 150])
def test_katz(spark, chunk):
    rng = random.Random(2)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 60)))) for k in range(150)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, part int, chunk string").repartition(3)
    want = brute_katz(docs)
    got = katz.score_documents(df, chunk_tokens=chunk, hot_tokens=chunk // 10).collect()
    assert len(got) == len(docs)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def smooth_discounts(bigrams):
    """Good-Turing discounts after a straight line through log n_r, by another route than the library's."""
    n = Counter(c for c in bigrams.values() if c <= 6)
    r = sorted(n)
    z = [n[k] / (0.5 * ([*r, 2 * k - r[-2]][i + 1] - [0, *r][i])) for i, k in enumerate(r)]
    line = statistics.linear_regression([math.log(k) for k in r], [math.log(v) for v in z])
    e = lambda k: math.exp(line.intercept + line.slope * math.log(k))
    star = lambda k: (k + 1) * e(k + 1) / e(k)
    return [(star(k) / k - 6 * e(6) / e(1)) / (1 - 6 * e(6) / e(1)) for k in range(1, 6)]


def test_katz_discounts_with_groups_of_copies(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.8)) % 900}" for _ in range(40))
    texts = [text() for _ in range(200)] + [t for t in (text() for _ in range(12)) for _ in range(5)]
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 != 1]
    docs = [*zip(ids, texts)] + [(k, text()) for k in range(400, 430)]
    train = [own_tokens(t) for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    bigrams = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    n = [sum(c == r for c in bigrams.values()) for r in range(1, 7)]
    common = 6 * n[5] / n[0]
    raw = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, 6)]
    assert not all(0 < d < 1 for d in raw)  # the copies' pairs occur five times
    want = smooth_discounts(bigrams)
    assert all(0 < d < 1 for d in want) and want == sorted(want)
    assert katz.discounts(n)[1:] == pytest.approx(want, rel=1e-9)
    brute = brute_katz(docs)
    for r in katz.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.score == pytest.approx(brute[r.doc_id][5], rel=1e-9)


def test_katz_discounts_of_given_tables():
    # counts of counts of sf0.1's training bigrams; d4 of the raw formula is 1.106
    assert all(0 < d < 1 for d in katz.discounts([1482341, 227973, 46941, 19718, 17404, 6993])[1:]) and katz.smoothed([1482341, 227973, 46941, 19718, 17404, 6993]) < -1
    for of in ([0] * 6, [0, 0, 0, 0, 9, 0], [9, 0, 0, 0, 90, 0], [5, 4, 3, 3, 3, 3], [7, 0, 0, 0, 0, 0]):  # no slope: the named fallback
        assert katz.smoothed(of) is None and all(0 < d < 1 for d in katz.discounts(of)[1:])


def test_katz_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "x y")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in katz.score_documents(df).collect()) == [3, 3, 3]
    assert katz.score_documents(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b " * 150_000), (2, "x" * 2_000_000), (1, "a b " * 150_000)], "doc_id long, text string")
    rows = katz.score_documents(long, chunk_tokens=1000, hot_tokens=100).collect()
    assert sorted(r.n_tokens for r in rows) == [2, 300_001, 300_001] and all(r.score < 0 for r in rows)
    held = spark.createDataFrame([(k, "a b") for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known) for r in katz.score_documents(held).collect()} == {(0, 0)}


# Quality


def quality_fixture(spark, n=240):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "of", "tree", "house", "river", "walks", "and"]) for _ in range(rng.randint(5, 50))) + "."
    junk = lambda: " ".join(rng.choice(["BUY", "CLICK", "$$$", "!!!", "win9"]) for _ in range(rng.randint(5, 50)))
    docs = [(k, junk() if k % 4 == 0 else good(), "en", "s", 0.5) for k in range(n)] + [(n, None, "en", "s", 0.5), (n + 1, "", "en", "s", 0.5), (None, good(), "en", "s", 0.5)]
    labels = [(k, int(k % 4 != 0), 0) for k in range(n)] + [(None, 0, 0), (5, None, 0), (6, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_fixture(spark)
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    blank = quality.score_quality(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in blank} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_pooling_against_brute_force():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    buckets = quality.TokenBuckets()
    for text in ("", "one", "one two ONE two, three!!! " * 3, "é 123 ___ ??" * 2):
        ids = buckets.of(text).tolist()
        got = quality.pooled(np.array(ids, np.int64), vectors)
        if not ids:
            assert not got.any() and len(got) == quality.WIDTH
            continue
        x = [vectors[i] for i in ids]
        mean = [statistics.fmean(v[d] for v in x) for d in range(quality.DIMENSIONS)]
        spread = [statistics.pstdev([v[d] for v in x]) for d in range(quality.DIMENSIONS)]
        own = sum(m * m for m in mean) + sum(s * s for s in spread) + 1e-9
        alike = [statistics.fmean(float(x[i] @ x[i + k]) for i in range(len(x) - k)) / own if len(x) > k else 0 for k in (1, 2)]
        lengths = [math.log1p(100 * math.sqrt(sum(v * v for v in part))) for part in (mean, spread)]
        assert got.tolist() == pytest.approx([*mean, *spread, *lengths, *alike], rel=1e-4, abs=1e-5)
    # tokens share a bucket by their whole form, however long
    assert buckets["!" * 8 + "a"] != buckets["!" * 8 + "b"] and buckets["?" * 100] != buckets["?" * 101] and buckets["Word"] == buckets["word"]


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 6))
    truth = 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] * x[:, 2])))
    y = (rng.random(3000) < truth).astype(int)
    net = quality.fit(x, y, hidden=16, epochs=30)
    by_hand = []
    for row in x[:50]:
        h = [math.tanh(sum((row[i] - net.centre[i]) / net.scale[i] * net.w1[i][j] for i in range(6)) + net.b1[j]) for j in range(16)]
        by_hand.append(1 / (1 + math.exp(-(sum(a * b for a, b in zip(h, net.w2)) + net.b2) / net.temperature)))
    assert net.score(x[:50]).tolist() == pytest.approx(by_hand)
    held = np.arange(3000) % 5 == 4
    loss = lambda t: -np.mean(np.where(y[held], np.log(1 / (1 + np.exp(-net.logits(x[held]) / t))), np.log(1 / (1 + np.exp(net.logits(x[held]) / t)))))
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 61))
    fresh = rng.normal(size=(4000, 6))
    truth = 1 / (1 + np.exp(-(2 * fresh[:, 0] - 1.5 * fresh[:, 1] * fresh[:, 2])))
    score = net.score(fresh)
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):  # scores are rates
        some = (score >= low) & (score < low + 0.2)
        assert abs(score[some].mean() - truth[some].mean()) < 0.1


def test_quality_sample_is_bounded_by_rows(spark):
    docs, labels = quality_fixture(spark, 80)
    many = docs.unionByName(docs.where("doc_id = 9").crossJoin(spark.range(500).toDF("k")).select(*[c if c != "text" else F.concat("text", F.col("k").cast("string")).alias("text") for c in docs.columns]))
    assert quality.training_rows(many, labels, "quality", 2, 4, 10).count() == 10
    rows = quality.training_rows(many, labels, "quality", 2, 4, 1000).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    long = spark.createDataFrame([(1, "word " * 400_000, "en", "s", 0.5), (2, "!" * 1_000_000, "en", "s", 0.5), (2, "!" * 1_000_000, "en", "s", 0.5)], docs.schema)
    assert quality.score_quality(docs.unionByName(long), labels).count() == docs.count() + 3


def test_held_out_labels_are_never_read(spark):
    docs, labels = quality_fixture(spark, 80)
    held = [r.doc_id for r in labels.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    chosen = quality.training_rows(docs, labels, "quality", 2, 4, 1000).collect()
    assert not {r.doc_id for r in chosen} & set(held) and len({r.doc_id for r in chosen}) == len(chosen)
    assert quality.training_rows(docs, labels, "quality", 2, 4, 10).count() == 10


def test_kept_rows_keep_their_columns(spark):
    docs, labels = quality_fixture(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id % 4 for r in kept.where("doc_id < 240").collect()} == {1, 2, 3}


def test_word_vectors_are_sums_of_neighbours():
    ids = np.array([3, 5, 3, 7, -1, 5, 9])
    places, signs = quality.index_vectors()
    total = np.zeros(quality.BUCKETS * quality.DIMENSIONS)
    quality._add_contexts(ids, places, signs, total)
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for text in ([3, 5, 3, 7], [5, 9]):
        for i, a in enumerate(text):
            for j, b in enumerate(text):
                if i != j and abs(i - j) <= quality.REACH:
                    np.add.at(want[a], places[b], signs[b])
    assert np.allclose(total.reshape(want.shape), want)


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["the", "of", "tree", "house", "river", "walks", "and"]) + str(rng.randrange(40)) for _ in range(n))
    item = text(14)
    docs = [(k, "BUY!!! CLICK!!! " * 8 if k % 6 == 0 else text(rng.randint(20, 60))) for k in range(150)]
    docs += [(200 + k, docs[k][1]) for k in (1, 2, 3)] + [(300 + k, docs[k][1] + " more") for k in (4, 5)] + [(400, text(20) + " " + item), (401, None), (None, text(30)), (7, docs[7][1])]
    folder = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, folder), name)
        seen.append(now)
    first, second, third, last = seen
    assert first.columns == second.columns == third.columns == columns
    kept = [(r.doc_id, r.text) for r in first.collect()]
    ids = {k for k, _ in kept}
    assert not {k for k in range(150) if k % 6 == 0} & ids and {k for k in range(150) if k % 6} <= ids
    leaders = {c for _, _, c in brute_join(kept)}
    assert sorted(str(r.doc_id) for r in second.collect()) == sorted(leaders | {"None"})
    clean = sorted((str(r.doc_id), r.text) for r in second.collect() if brute_hits(r.text, [(1, item)])[1] == 0)
    assert sorted((str(r.doc_id), r.text) for r in third.collect()) == clean and "400" not in {k for k, _ in clean}
    assert last.where("piece = 0").count() == third.count()
    assert corpus_pipeline.run(spark, folder).count() == last.count()
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_pipeline_of_odd_tables(spark, tmp_path):
    rng = random.Random(13)
    text = lambda n: " ".join(rng.choice(["tree", "house", "river", "walks", "and"]) + str(rng.randrange(90)) for _ in range(n))
    a, b, c = text(40), text(40), text(5000)
    rows = [(1, a), (1, b), (2, a), (None, None), (3, ""), (3, ""), (4, c), (None, c + " more"), (5, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _brindle_key long, _brindle_row string, _brindle_score double, row int, digest string, `label` int"
    folder = str(tmp_path / "odd")
    spark.createDataFrame([(k, t, "en", "s", 1, 7, "x", 0.5, 1, "d", 3) for k, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    assert near.columns == docs.columns
    # rows of one id with different texts all stay; an empty text is nobody's copy unless its id is the same too
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(1, a), (1, b), (None, None), (3, ""), (4, c), (5, None)], key=str)
    clean = corpus_pipeline.decontamination_stage(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    kept = corpus_pipeline.quality_stage(spark, docs, folder)  # without labels every score is 0.5
    assert kept.columns == docs.columns and kept.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6))
    rows = [
        (1, a), (2, a), (2, b),  # one row of id 2 is a copy, the other is not
        (5, c), (5, d), (9, d),  # id 5 holds two texts and leads the group of d
        (7, e), (7, e), (None, e), (None, f), (None, f),
        (20, ""), (21, None), (22, ""),
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long")
    got = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert got.columns == df.columns
    want = [(1, a), (2, b), (5, c), (5, d), (7, e), (None, f), (20, ""), (21, None), (22, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_sketch_of_a_task_is_the_same_with_and_without_counters(monkeypatch):
    rng = np.random.default_rng(3)
    held = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 500, 3)] + [np.full(70_000, 5, np.uint64)]
    want = np.zeros(jaccard.COUNTERS, np.uint32)
    for h in held:
        np.add.at(want, (h % np.uint64(jaccard.COUNTERS)).astype(np.int64), np.uint32(1))
    half = np.zeros(jaccard.COUNTERS, np.uint32)
    np.add.at(half, (np.concatenate(held[:2]) % np.uint64(jaccard.COUNTERS)).astype(np.int64), np.uint32(1))
    for counts, rest in ((None, held), (half, held[2:]), (want, [])):
        got = np.concatenate(list(jaccard._counter_blocks(counts, rest)))
        assert got.dtype == np.uint32 and (got == want).all()
