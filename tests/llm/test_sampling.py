"""Importance resampling, hard negatives and mixing against plain functions, over corpora with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents, lower, prose, table, words_of
from tracelake.llm import hard_negatives, importance, mixing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).cache()


# 11 -----------------------------------------------------------------------------------------------------------------------
def runs(text, max_n):
    w = WORD.findall(lower(text))
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def resampled(rows, items, max_n=1, buckets=10_000, percent=10, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in runs(text, max_n)) for texts in ([r[1] for r in rows], items))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for ident, text, *_ in rows:
        feats = runs(text, max_n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, feats))
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(runs(text, 1)), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[5] = k
    return sorted((tuple(r[:1] + r[2:]) for r in out), key=repr)


COLS = ["doc_id", "n_features", "weight", "score", "rank"]
ITEMS = [None, "", "w1 w2 W3 w399", "ÄÖ é ß x", prose(random.Random(4), 50)]


@pytest.mark.parametrize(("max_n", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 60)])
def test_resampling(spark, docs, max_n, buckets, percent):
    items = spark.createDataFrame([(i, x, "b") for i, x in enumerate(ITEMS)], "item_id long, text string, bucket string")
    got = importance.resample(docs, items, percent, max_n=max_n, buckets=buckets)
    assert table(got, *COLS) == resampled(corpus(), ITEMS, max_n, buckets, percent)


def test_resampling_of_empty_tables(spark, docs):
    nothing, items = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(nothing, items).count() == 0
    assert table(importance.resample(docs, items), *COLS) == resampled(corpus(), [])
    short = [(i, "one two", None, None, 0) for i in range(30)] + [(1, None, None, None, None)]
    assert importance.resample(documents(spark, short), items).where("rank is not null").count() == 0


def test_drawn_rows_keep_their_columns(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40, 50 if i % 2 else 5000), "en", "s", 1) for i in range(100)]
    items = spark.createDataFrame([(0, prose(rng, 4000, 50))], "item_id long, text string")
    df = documents(spark, rows)
    got = importance.drawn(df, items)
    assert got.columns == df.columns and got.count() == 10
    assert sum(r.doc_id % 2 for r in got.select("doc_id").collect()) >= 9  # like the target


def test_composed_crcs():
    rng = random.Random(1)
    words = ["".join(rng.choice("aé0\U0001f600z") for _ in range(rng.choice([1, 2, 7, 47, 48, 49, 5000]))).encode() for _ in range(200)]
    ends = np.cumsum([len(w) for w in words])
    size = np.array([len(w) for w in words])
    crcs = importance.word_crcs(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    for n, crc in enumerate(importance.run_crcs(crcs, size, 5), 1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


# 12 -----------------------------------------------------------------------------------------------------------------------
def mined(rows, every=100, low=80):
    usable = []
    for i, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            usable.append((i, [math.floor(256 * v) for v in x], label))
    order = lambda s, i: (-s, i is None, i or 0)
    cap = lambda s: max(-hard_negatives.MOST, min(hard_negatives.MOST, s))
    out = []
    for a, x, label in usable:
        if a is None or a % every:
            continue
        scored = sorted(((cap(sum(p * q for p, q in zip(x, y))), i, m) for i, y, m in usable), key=lambda r: order(r[0], r[1]))
        for score, i, _ in [r for r in scored if r[2] == label and r[1] != a][:5]:
            fits = [r for r in scored if r[2] != label and low * score <= 100 * r[0] <= 100 * score][:5]
            out += [(a, i, k, n, score, s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed=1):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [v + rng.gauss(0, 0.3) for v in base[i % 6]], rng.randrange(3)) for i in range(600)]
    rows += [(1000 + i, base[0], i % 2) for i in range(300)]  # copies: ties
    rows += [(700, base[1], 0), (700, base[1], 0), (700, base[2], 1), (800, [], 1), (801, [1.0, 2.0], 1), (802, base[0] + [5.0], 0)]
    rows += [(900, None, 1), (901, base[0], None), (902, [None] + base[0][1:], 1), (903, [math.nan] + base[0][1:], 1), (904, [math.inf] + base[0][1:], 1)]
    rows += [(None, base[0], 0), (None, base[0], 1), (None, None, None), (-200, base[3], 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "vector", "group", "score", "place")})


HARD = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block_bytes", [hard_negatives.BLOCK_BYTES, 200])
def test_hard_negatives(spark, block_bytes):
    got = hard_negatives.mine(frame(spark, vectors()).repartition(5), F.col("vec_id") % 100 == 0, block_bytes=block_bytes)
    want = mined(vectors())
    assert table(got, *HARD) == want and len(want) > 100


def test_hard_negatives_of_huge_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randrange(14) for _ in range(4)], rng.randrange(2)) for i in range(200)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert table(got, *HARD) == mined(rows, 10)


def test_hard_negatives_of_nothing(spark):
    df = frame(spark, vectors())
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") == 77).select("anchor_id").distinct().count() <= 1
    assert hard_negatives.mine(df.where("label = 1"), F.col("vec_id") % 100 == 0).count() == 0
    alone = frame(spark, [(100, [1.0], 0), (1, [1.0], 1)])
    assert hard_negatives.mine(alone, F.col("vec_id") % 100 == 0).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------------
def targets(sizes, weights=(1, 2, 3), most=3):
    """By source, by rounds as they are stated: share, stop at the cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while True:
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if each[s] >= most * sizes[s]]
        if not over:
            return out | each
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.discard(s)
        if not free:
            return out


def checked(rows, got):
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words_of(text))
    want = targets(dict(sizes))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source or "") for r in got) == sorted((r[0] is None, r[0] or 0, len(words_of(r[1])), r[3] or "") for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        assert r.size == 0 or math.floor(r.target / r.source_size + 1e-6) <= r.times <= math.ceil(r.target / r.source_size - 1e-6) or r.times in (0, 3)
        taken[r.source] += r.taken
    return want, taken, sizes


def test_mixing_of_odd_rows(spark, docs):
    got = mixing.mix(docs).collect()
    checked(corpus(), got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))  # however rows are dealt
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = [(1, None, None, None, None), (2, " ", None, "s", 1), (2, " ", None, "s", 1), (None, "", None, "s", 1)]
    assert table(mixing.mix(documents(spark, blank)), "size", "source_size", "target", "taken") == [(0, 0, 0.0, 0)] * 4


def test_mixing_meets_its_targets(spark):
    """Words within one in two hundred, documents near their share; a hot source, a capped one, one of equal documents, one huge document."""
    rng = random.Random(9)
    rows = [(i, "w " * int(rng.lognormvariate(3, 1) + 1), "en", "hot" if i < 3000 else f"s{i % 5}", 1) for i in range(6000)]
    rows += [(10_000 + i, "w " * 7, "en", "equal", 1) for i in range(400)] + [(20_000, "w " * 30, "en", "a tiny", 1)]
    rows += [(30_000 + i, "w " * (20_000 if i == 0 else 50), "en", "\U0001f600 huge", 1) for i in range(900)]
    got = mixing.mix(documents(spark, rows).repartition(7)).collect()
    want, taken, sizes = checked(rows, got)
    assert taken["a tiny"] == 90
    times = defaultdict(int)
    for r in got:
        times[r.source] += r.times
    for source, goal in want.items():
        assert abs(taken[source] - goal) <= max(4, goal / 200), source
        share = goal / sizes[source] * sum(r[3] == source for r in rows)
        assert "huge" in source or abs(times[source] - share) <= max(4, share / 20), source  # there words alone can be kept


def test_flights_keep_expectations():
    """Over many draws each document is taken as often as its probability says, and the two totals hold each time."""
    rng = np.random.Generator(np.random.PCG64(3))
    size, p = rng.integers(1, 60, 40), rng.uniform(0.1, 0.9, 40)
    seen = np.zeros(40)
    for k in range(600):
        out = mixing.flight(p, size, np.random.Generator(np.random.PCG64(k)))
        open_ = (out > 1e-9) & (out < 1 - 1e-9)
        assert open_.sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-6
        seen += out
    assert np.abs(seen / 600 - p).max() < 0.09
    done = mixing.landed(p, size, np.random.Generator(np.random.PCG64(1)))
    assert set(done.tolist()) <= {0.0, 1.0} and abs(done @ size - p @ size) < 2
