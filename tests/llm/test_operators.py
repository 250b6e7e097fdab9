"""Each operator against a plain function over a corpus with odd rows: nulls, empty and very long texts, ties, repeated rows,
clashing columns; and over an empty table."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, documents, lower, prose, sha, table, words_of
from tracelake.llm import chat_format, decontaminate, lm_scoring, minhash_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


# 1 ------------------------------------------------------------------------------------------------------------------------
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("", "/", "block"), (None, "/", "block"), ("a.com", "/fr/", "block")]


def judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [(-len(h + p), -len(h), h + p, v) for h, p, v in RULES if h is not None and p is not None and (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    best = min(fits) if fits else None
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["example.org", "WWW.Example.org", "xample.org", "com", "a.com", "b.a.com", "ba.com", "org", "", "x..org", "com.org"]
    paths = ["", "/", "/es", "/es/x", "/en/1", "/en/12?q=/es/", "/fr/#/de/", "/de/", "/fr/y" + "z" * 3000]
    urls = [None, "", "no url", "://", "a://b://c/d"] + [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += ["http://hot.example.org/es/1"] * 200
    pages = spark.createDataFrame([(i, u, "k", "b") for i, u in enumerate(urls)] + [(None, "http://a.com/fr/", "k", "b")], "page_id long, url string, key string, bucket string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = table(url_filter.filter_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *judged(u)) for i, u in enumerate(urls)] + [(None, *judged("http://a.com/fr/"))], key=repr)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    named = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "id", "start")})
    assert table(url_filter.filter_urls(named, rules), "page_id", "host", "path", "rule", "verdict") == got
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------------
BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    out = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [s for _, _, s in sorted(out)]


def test_secrets(spark, nothing):
    live = "Ab3" + "xY9z" * 10
    copied = "Zz1" + "qW8e" * 10
    texts = [None, "", "password = hunter22 Token:'abc' api_key=\"k.k-k=1234\"", "AKIA" + "Q7" * 9 + " é\U0001f600 AKIA" + "B" * 30, "f" * 24 + " " + "0a" * 30, f"x {live} y", f"a {copied}", f"b {copied}", f"c {copied}",
             "secretsecret=password:abcdefgh", "token=" + "k" * 40, "e" * 23, "apikey:" + "9" * 50_000, live + " " + copied]
    rows = [(i, t, "en", f"s{i}", 0) for i, t in enumerate(texts)] + [(5, f"x {live} y", "en", "s5", 0), (None, "password=abcdef", None, None, None)]
    df = documents(spark, rows)
    got = secret_scan.scan(df).withColumn("all", secret_scan.listed(F.col("spans"))).withColumn("base", secret_scan.listed(secret_scan.base_only(F.col("spans"))))
    assert table(got, "doc_id", "base") == sorted(((i, ",".join(base_spans(t))) for i, t, *_ in rows), key=repr)
    spans = dict(table(got.where("doc_id is not null"), "doc_id", "all"))
    assert spans[5] == f"opaque:2:{2 + len(live)}"  # one owner: looks live
    assert spans[6] == spans[7] == "" and spans[13] == f"opaque:0:{len(live)}"  # four owners: an example
    assert secret_scan.scan(nothing).count() == 0
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert masked[5] == "x [opaque] y" and masked[2] == "[assign] Token:'abc' [assign]\"" and masked[0] is None
    assert secret_scan.redact(df).columns == df.columns and secret_scan.redact(df).count() == len(rows)


def test_owners_and_repositories_are_two_counts(spark):
    """A value in many repositories of one owner is a template, as is one of many owners in one repository; few of both: live."""
    value = lambda c: c + "b3X" + "xY9z" * 10
    rows = [(i, f"k {value('T')}", "en", "o", 0, "one owner", f"r{i}") for i in range(9)]  # nine repositories of one owner
    rows += [(20 + i, f"k {value('M')}", "en", "o", 0, f"owner{i}", "fork") for i in range(3)]  # three owners
    rows += [(30 + i, f"k {value('L')}", "en", "o", 0, "one owner", f"r{i % 8}") for i in range(40)]  # eight repositories: still live
    rows += [(80, f"k {value('N')}", "en", "o", 0, None, None), (81, f"k {value('N')}", "en", "o", 0, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, owner string, repo string")
    got = secret_scan.scan(df, owner_col="owner", repo_col="repo")
    spans = {r.doc_id: [(s.kind, s.owners, s.repos) for s in r.spans] for r in got.collect()}
    assert spans[0] == [] and spans[20] == [] and spans[30] == [("opaque", 1, 8)] and spans[80] == [("opaque", 2, 1)]
    wide = secret_scan.scan(df, owner_col="owner", repo_col="repo", max_repos=9, max_owners=3)
    assert {r.doc_id: [(s.owners, s.repos) for s in r.spans] for r in wide.collect()}[0] == [(1, 9)]


# 3 ------------------------------------------------------------------------------------------------------------------------
def measures(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)
    return *n, n[0] < 50 or 100 * n[4] > 50 * n[0]


def test_quality_rules(spark, docs, nothing):
    got = table(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r[0], *measures(r[1])) for r in corpus()), key=repr)
    assert quality_rules.judge(nothing).count() == 0
    assert quality_rules.judge(docs).where("base_failed and kept").count() == 0


def test_quality_thresholds_follow_the_corpus(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80), "en", "a", 1) for i in range(300)] + [(300 + i, prose(rng, 80) + " #" * 40, "en", "b", 1) for i in range(300)]
    rows += [(900, prose(rng, 80) + " #" * 40, "en", "a", 1)]
    kept = dict(table(quality_rules.judge(documents(spark, rows)), "doc_id", "kept"))
    assert not kept[900] and all(kept[i] for i in range(600))  # what is usual in b is odd in a


def test_cutoffs_are_blended_quantiles(spark):
    """Cutoffs from plain sorted lists, for groups of any size: the group's quantiles, with its language's and all documents'."""
    import math

    rng = random.Random(5)
    rows, i = [], 0
    for lang, source, n, odd in [("en", "a", 120, 0.3), ("en", "b", 3, 0), ("de", "a", 40, 0.1), (None, None, 1, 0), ("", "a", 2, 0), ("xx", "a", 1, 0)]:
        for _ in range(n):
            text = prose(rng, 5 if lang == "xx" else 90) + " #" * (rng.randrange(90) if rng.random() < odd else 0)
            rows.append((i, text, lang, source, 1))
            i += 1
    m = {r[0]: measures(r[1]) for r in rows}
    rate = lambda r: m[r[0]][2] / m[r[0]][0]
    quantile = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs) - 1e-9) - 1)]

    def blended(q, lang, source, value=rate, least=-1.0):
        good = [r for r in rows if not m[r[0]][5] and value(r) > least]
        every = [value(r) for r in good]
        some = [value(r) for r in good if r[2] == lang]
        own = [value(r) for r in good if r[2:4] == (lang, source)]
        out = quantile(every, q)
        for xs in (some, own):
            out = (len(xs) * quantile(xs, q) + 50 * out) / (len(xs) + 50) if xs else out
        return out

    judged = quality_rules.judge(documents(spark, rows)).withColumn("off", F.array_contains("failed", "symbol_rate"))
    got = dict(table(judged, "doc_id", "off"))
    near = 0
    for r in rows:
        q25, q50, q75, q90, q95 = (blended(q, r[2], r[3]) for q in (0.25, 0.5, 0.75, 0.9, 0.95))
        begins, size = blended(0.05, r[2], r[3], least=0.0), blended(0.5, r[2], r[3], value=lambda x: m[x[0]][0])
        most = max(q75 + 3 * (q75 - q25) + (q95 - q50 if q50 > 0 else 0), q90, 0.9 * begins, 5 / size)
        if abs(rate(r) / most - 1) < 0.1:  # sketches are right to 2 %
            near += 1
        else:
            assert got[r[0]] == (rate(r) > most), r[0]
    assert near < 20 and sum(got.values()) > 5


def test_no_cutoff_is_a_constant(spark):
    """Over groups with texts of their own kinds, each measure's cutoff takes a value of its own in each; junk among prose is found."""
    rng = random.Random(6)
    rows, junk = [], set()
    for g in range(6):
        for k in range(60):
            i = 100 * g + k
            words = [w + "x" * g if rng.random() < 0.5 else w.capitalize() for w in prose(rng, 60 + 25 * g).split()]
            for at in range(7 - g, len(words), 9 + g):
                words[at] += "\n"
            text = " ".join(words)
            if k < 4:
                junk.add(i)
                text += " #" * (40 + 10 * g)
            rows.append((i, text + (" a b c d e" * 3 if k % 7 == 0 else ""), "en", f"s{g}", 1))
    docs = documents(spark, rows)
    measured = []
    keep, quality_rules.cut = quality_rules.cut, lambda df: measured.append(keep(df)) or measured[-1]
    try:
        got = quality_rules.judge(docs).collect()
    finally:
        quality_rules.cut = keep
    limits = quality_rules.thresholds(measured[0]).collect()
    for x in quality_rules.MEASURES:
        assert len({r[f"{x}_hi"] for r in limits}) == 6, x
    assert {r.doc_id for r in got if "symbol_rate" in r.failed} == junk and sum(r.kept for r in got) > len(rows) - len(junk) - 8


def test_sketches_merge(spark):
    rng = random.Random(4)
    values = [rng.expovariate(1) for _ in range(5000)]
    names = [*quality_rules.MEASURES, *quality_rules.SIZES]
    m = spark.createDataFrame([("l", "s", False, *[v] * len(names)) for v in values], "lang string, source string, base_failed boolean, " + ", ".join(f"{x} double" for x in names))
    parts = [quality_rules.sketches(x) for x in m.randomSplit([1.0, 1.0], 1)]
    keys = ["level", "lang", "source", "measure", "bin"]
    merged = parts[0].unionByName(parts[1]).groupBy(keys).agg(F.sum("n").alias("n"))
    assert table(merged, *keys, "n") == table(quality_rules.sketches(m), *keys, "n")
    q = quality_rules._quantiles(merged).where("level = 0").first()
    values.sort()
    assert values[1249] <= q.q25 <= values[1250] * quality_rules.GAMMA and abs(q.q75 / values[3749] - 1) < 0.03


# 4 ------------------------------------------------------------------------------------------------------------------------
def without_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def test_substrings(spark, docs, nothing):
    got = substring_dedup.remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256))
    assert table(got, "doc_id", "n_words", "n_removed", "kept_sha256") == without_repeats(corpus())
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_at_all_offsets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 70), 30) for _ in range(2)]
        if rows and rng.random() < 0.7:
            w = words_of(rng.choice(rows)[1])
            a = rng.randrange(0, len(w) + 1)
            parts.insert(1, " ".join(w[a : a + rng.randrange(45, 120)]))
        rows.append((rng.randrange(1000), " ".join(parts), "en", "s", 1))
    got = substring_dedup.remove_repeats(documents(spark, rows).repartition(3)).withColumn("kept_sha256", F.sha2("kept", 256))
    ids = Counter(r[0] for r in rows)
    once = [r for r in without_repeats(rows) if ids[r[0]] == 1]
    assert [r for r in table(got, "doc_id", "n_words", "n_removed", "kept_sha256") if ids[r[0]] == 1] == once


def test_details_of_windows_are_small(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(substring_dedup, "cut", lambda d: kept.append(c := d.localCheckpoint()) or c)
    rng = random.Random(7)
    passages = [prose(rng, 200, 5000) for _ in range(150)]
    rows = [(rng.randrange(1 << 40), " ".join([prose(rng, 20, 5000), passages[k // 2], prose(rng, 20, 5000)]), "en", "s", 1) for k in range(300)]
    got = substring_dedup.remove_repeats(documents(spark, rows).repartition(2)).withColumn("kept_sha256", F.sha2("kept", 256))
    assert table(got, "doc_id", "n_words", "n_removed", "kept_sha256") == without_repeats(rows)
    size = {c: sum(len(r[0] or b"") for r in kept[1].select(c).collect()) for c, kind in kept[1].dtypes if kind == "binary"}
    entries = 300 * 151
    assert sum(n for c, n in size.items() if c not in ("codes", "extras", "least")) < 6 * entries


# 5 ------------------------------------------------------------------------------------------------------------------------
def held(i, mod, of):
    return i is not None and zlib.crc32(str(i).encode()) % mod == of


def test_lm_scores(spark, docs, nothing):
    import math

    rows = corpus()
    train = Counter(t for i, x, *_ in rows if not held(i, 10, 0) for t in [*words_of(lower(x)), ""])
    n, v = sum(train.values()), len(train)
    got = lm_scoring.score(docs).collect()
    want = []
    for i, x, *_ in rows:
        tokens = [*words_of(lower(x)), ""]
        base = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want.append((i, held(i, 10, 0), len(tokens), sum(train[t] > 0 for t in tokens), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score <= 0 and r.bits_per_byte >= 0 for r in got)
    assert lm_scoring.score(nothing).count() == 0


def test_context_tree_is_a_distribution_and_learns(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(i, "abcab" * rng.randrange(5, 30), "en", "s", 1) for i in range(200)]
    model = lm_scoring.fit(documents(spark, rows).select("text"))
    one = np.sum(10.0 ** -(model.costs.astype(float) / lm_scoring.ct.SCALE), axis=1)
    assert np.allclose(one, 1, atol=0.05)  # costs are rounded to 1/2048
    raw = b"abcababcab"
    odd = b"qzqzqzqzqz"
    scores = model.score(np.frombuffer(raw + odd, np.uint8), np.array([0, 10, 20]))
    assert scores[0] > -3 and scores[1] < -15


def test_context_tree_weights_match_the_definition():
    """The mixture over all depths, from the definition, on a small stream."""
    import math

    import numpy as np

    from tracelake.llm import context_tree as ct

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (2, 50))
    counts = np.zeros((50, 256))
    counts[:, 0], counts[:, 255] = a, b
    kt = lambda x, y: sum(math.log(i + 0.5) for i in range(x)) + sum(math.log(i + 0.5) for i in range(y)) - sum(math.log(i + 1) for i in range(x + y))
    assert np.allclose(ct.log_estimate(counts)[:, 0], [kt(int(x), int(y)) for x, y in zip(a, b, strict=True)], atol=1e-6)


def test_tree_scores_match_brute_force(spark):
    """Every context counts, however rare: scores of the whole weighted tree, by recursion over plain dictionaries."""
    import math
    from functools import lru_cache

    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcd eé") for _ in range(rng.randrange(0, 60))), "en", "s", 1) for i in range(40)] + [(99, None, "en", "s", 1)]
    raw = lambda x: b"\xff" * 5 + (x or "").encode() + b"\xff"
    seen: Counter = Counter()
    for i, x, *_ in rows:
        if not held(i, 10, 0):
            b = raw(x)
            for p in range(5, len(b)):
                for d in range(6):
                    for bit in range(8):
                        seen[b[p - d : p], bit, b[p] >> (8 - bit), b[p] >> (7 - bit) & 1] += 1
    contexts = {c for c, *_ in seen}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    @lru_cache(None)
    def weighted(c, *node):
        own = kt(seen[(c, *node, 0)], seen[(c, *node, 1)])
        if len(c) == 5:
            return own, 1.0
        below = sum(weighted(k, *node)[0] for k in (bytes([x]) + c for x in range(256)) if k in contexts)
        top = max(own, below)
        out = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        return out, math.exp(own - math.log(2) - out)

    def one(full, d, *node):
        c = full[5 - d :]
        a, b = seen[(c, *node, 0)], seen[(c, *node, 1)]
        share = weighted(c, *node)[1]
        return share * (b + 0.5) / (a + b + 1) + ((1 - share) * one(full, d + 1, *node) if d < 5 else 0)

    def cost(b, p):
        ones = [(one(b[p - 5 : p], 0, bit, b[p] >> (8 - bit)), b[p] >> (7 - bit) & 1) for bit in range(8)]
        return sum(math.log10(x if y else 1 - x) for x, y in ones)

    got = {r.doc_id: r.score for r in lm_scoring.score(documents(spark, rows)).collect()}
    assert any(held(i, 10, 0) for i in got)
    for i, x, *_ in rows:
        b = raw(x)
        assert abs(got[i] - sum(cost(b, p) for p in range(5, len(b)))) < 1e-3


# 6 ------------------------------------------------------------------------------------------------------------------------
def quality_rows(n=700):
    rng = random.Random(7)
    good = [(i, prose(rng, rng.randrange(30, 120)), "en", "s", 1) for i in range(n)]
    bad = [(n + i, " ".join(rng.choice(["buy", "now", "$$$", "click", "free", "!!!"]) for _ in range(rng.randrange(30, 120))), "en", "s", 1) for i in range(n)]
    return good, bad


def test_classifier_on_held_out_rows(spark, nothing):
    good, bad = quality_rows()
    df = documents(spark, good + bad)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.score(df, labels).collect()}
    assert all(got[i].held_out == held(i, 4, 2) for i in got)
    out = [r for r in got.values() if r.held_out]
    assert sum((r.score >= 0.7) == (r.doc_id < len(good)) for r in out) / len(out) > 0.95
    flipped = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.score(df, flipped).collect()}
    assert all(again[i] == got[i].score for i in got)  # labels of held-out rows change nothing
    assert quality_classifier.score(nothing, labels).count() == 0


def test_every_word_has_a_vector_of_its_own(spark):
    """Features from context vectors of whole words, by plain sums; 40,000 words can't share 16,384 vectors here."""
    import numpy as np
    import pyarrow as pa

    from tracelake.llm.wordcodes import chunks

    rng = random.Random(9)
    names = [f"w{i}" for i in range(40_000)]
    rows = [(i, " ".join(rng.choices(names, k=300) + ["the"] * 5), "en", "s", 1) for i in range(150)] + [(999, None, "en", "s", 1)]
    code = lambda w: next(iter(chunks(pa.array([w])))).words >> np.uint64(8)
    index = {w: quality_classifier.index_vectors(code(w))[0].astype(int) for w in {w for _, x, *_ in rows for w in (x or "").split()}}
    vector = {w: np.zeros(quality_classifier.DIM) for w in index}
    for _, x, *_ in rows:
        w = (x or "").split()
        for i in range(len(w)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    vector[w[i]] += index[w[j]]
    unit = {w: np.rint(v * 127 / max(np.sqrt((v * v).sum()), 1e-9)) / 127 for w, v in vector.items()}
    got = {r.id: np.frombuffer(r.x, "<f2") for r in quality_classifier.features(documents(spark, rows).repartition(4)).collect()}
    assert set(got) == {r[0] for r in rows} and not got[999].any()
    for i, x, *_ in rows[:-1]:
        w = x.split()
        assert np.allclose(got[i][: quality_classifier.DIM], np.mean([unit[t] for t in w], axis=0), atol=1e-3)
        plain = [np.log1p(len(w)) / 10, len(set(w)) / len(w), 0, sum(c.isdigit() for c in x) / len(x), 0]
        assert np.allclose(got[i][quality_classifier.DIM :], plain, atol=1e-3)


def test_network_and_its_temperature():
    """Scores against a plain loop over the network's own weights; the temperature is the one of least loss on rows kept apart."""
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, quality_classifier.FEATURES))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    net = quality_classifier.fit(x, y)
    w1, b1, w2, b2 = net.weights
    for row, s in zip(x[:20], net.score(x[:20]), strict=True):
        z = [(v - m) / d for v, m, d in zip(row, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, w1[:, j], strict=True)) + b1[j]) for j in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]
        assert abs(s - 1 / (1 + math.exp(-max(-30, min(30, logit / net.temperature))))) < 1e-9
    assert ((net.score(x) > 0.5) == (y > 0)).mean() > 0.9 and 0.25 <= net.temperature <= 8


def test_packed_sums_come_back():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, (300, quality_classifier.DIM))
    x[5:9] *= 100
    x[7] *= 1 << 40
    x = x.astype(np.int64)
    assert (quality_classifier._unpacked(quality_classifier._packed(x)) == x).all()
    assert quality_classifier._unpacked(quality_classifier._packed(x[:0])).shape == (0, quality_classifier.DIM)


def shuffle_files(spark):
    import os

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, names in os.walk(top.getAbsolutePath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_features_leave_no_shuffle_files(spark):
    """Shuffle files go with the step that made them: the sums' before rows ask for vectors, those of a slice before the next one."""
    import time

    good, bad = quality_rows(60)
    before = shuffle_files(spark)
    done = quality_classifier.features(documents(spark, good + bad).repartition(4))
    for _ in range(50):  # files are deleted by threads of their own
        if left := shuffle_files(spark) - before:
            time.sleep(0.1)
    assert not left and done.count() == 120


def test_slices_change_no_features(spark, docs, monkeypatch):
    got = []
    for n in (1, 2, 7):
        monkeypatch.setattr(quality_classifier, "SLICES", n)
        got.append(table(quality_classifier.features(docs), "id", "hash", "x"))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(corpus())


def test_told_sums_are_heard_as_vectors():
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (400, quality_classifier.DIM))
    x[::3] *= rng.integers(1, 5000, (len(x[::3]), 1))
    x[5] = 0
    x[7] = 1 << 30
    assert (quality_classifier._heard(quality_classifier._told(x)) == quality_classifier.scaled(x)).all()
    assert len(quality_classifier._told(rng.integers(-2, 3, (4000, quality_classifier.DIM)))) < 0.5 * 4000 * quality_classifier.DIM


def test_classifier_with_shared_ids_and_clashing_labels(spark):
    """One id with two texts and labels given twice: the same scores in any order of rows; clashing columns aren't read."""
    good, bad = quality_rows(60)
    rows = good + bad + [(good[0][0], bad[0][1], "en", "s", 1), good[1], (None, None, None, None, None)]
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(good[0][0], 0), (good[1][0], 1)], "doc_id long, quality int")
    labels = labels.withColumns({c: F.lit("x") for c in ("id", "x", "score", "class", "one", "code", "text")})
    first = table(quality_classifier.score(documents(spark, rows), labels), "doc_id", "score")
    again = table(quality_classifier.score(documents(spark, rows[::-1]).repartition(3), labels.repartition(2)), "doc_id", "score")
    assert len(first) == len(rows) and [i for i, _ in first] == [i for i, _ in again]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(first, again, strict=True))
    kept = quality_classifier.keep(documents(spark, rows), labels, 0.7)
    assert kept.columns == documents(spark, []).columns and kept.count() == sum(s >= 0.7 for _, s in first)


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert table(quality_classifier.score(docs, none).select("score").distinct(), "score") == [(0.5,)]
    assert quality_classifier.score(docs, none).count() == len(corpus())


# 7 ------------------------------------------------------------------------------------------------------------------------
def near_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(lower(t))
        s = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for x in ids:
        for y in ids:
            if x < y and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[x] for t in sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return {i: root(i) for i in ids}, sets


def test_near_duplicates(spark, docs, nothing):
    rows = corpus()
    groups, sets = near_groups(rows)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == groups
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got) == sorted(len(s) for x in sets.values() for s in x)
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicate_chains_and_large_groups(spark):
    rng = random.Random(8)
    rows, i = [], 0
    for size in (120, 30, 5, 5, 5):
        w = prose(rng, 150).split()
        for _ in range(size):
            w = list(w)
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"z{i}"
            rows.append((i, " ".join(w), "en", "s", 1))
            i += 1
    rng.shuffle(rows)
    got = dict(table(minhash_dedup.near_duplicates(documents(spark, rows).repartition(6)), "doc_id", "component_id"))
    assert got == near_groups(rows)[0]
    kept = minhash_dedup.deduplicated(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(near_groups(rows)[0].values()))


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates_in_mixed_buckets(spark, monkeypatch, block):
    """Many texts around one passage, too far from each other to be linked as a whole, some of them linked in pairs; buckets parted
    by further bands and by blocks find the same."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(13)
    passage, rows = prose(rng, 60, 5000), []
    for i in range(40):
        own = prose(rng, rng.randrange(15, 60), 5000).split()
        for k in range(rng.randrange(1, 3)):
            rows.append((10 * i + k, passage + " " + " ".join(own), "en", "s", 1))
            own = own[: -rng.randrange(2, 6)] + [f"z{i}"]
    long = prose(rng, 2500, 3000).split()  # sets of over a thousand shingles
    rows += [(1000, " ".join(long), "en", "s", 1), (1001, " ".join(long[:2200]), "en", "s", 1), (1002, " ".join(long[300:]), "en", "s", 1), (1003, " ".join(long[:1500]), "en", "s", 1)]
    got = dict(table(minhash_dedup.near_duplicates(documents(spark, rows).repartition(5)), "doc_id", "component_id"))
    assert got == near_groups(rows)[0] and 1 < len(set(got.values())) < len(rows)


def test_one_row_of_an_id_stays(spark):
    """Of rows that share an id the same one stays in any order of rows."""
    rng = random.Random(14)
    rows = [(i % 6, prose(rng, 40), "en", f"s{i}", i) for i in range(24)] + [(0, "twice", "en", "a", 1), (0, "twice", "en", "b", 2)]
    one = table(minhash_dedup.deduplicated(documents(spark, rows)), "doc_id", "text", "source", "n_chars")
    for seed in range(2):
        rng.shuffle(rows)
        assert table(minhash_dedup.deduplicated(documents(spark, rows).repartition(4)), "doc_id", "text", "source", "n_chars") == one
    assert sorted({r[0] for r in one}) == [r[0] for r in one]


# 8 ------------------------------------------------------------------------------------------------------------------------
def test_packing_round_trip(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    want = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in corpus())
    pieces = packing.pack(docs, path).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    short = 0
    for ps in windows.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert len({(p.tier, p.step) for p in ps}) == 1
        total = sum(p.length for p in ps)
        short += total != ps[0].tier
        assert total <= ps[0].tier and ps[0].tier in packing.TIERS
    assert short <= 1  # the last rest of all five partitions
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for i, ps in by_doc.items():
        ids = Counter()
        for p in ps:
            ids.update((p.start + k, t) for k, t in enumerate(struct.unpack(f"<{p.length}I", p.ids)))
        expected = Counter()
        for (j, t), n in want.items():
            if j == i:
                expected.update({(k, x): n for k, x in enumerate(t)})
        assert ids == expected
    assert set(by_doc) == {i for i, _ in want}
    assert packing.pack(nothing, path).count() == 0


def test_packing_balances_steps(spark, monkeypatch):
    """Any two steps differ by one window of each tier at most; long tiers take gaps' worth from shorter ones."""
    import public_tokenizers

    rng = random.Random(12)
    rows = [(i, prose(rng, int(rng.paretovariate(0.8) * 20) % 4000), "en", "s", 1) for i in range(1500)]
    monkeypatch.setattr(packing, "STEP_TOKENS", 16 * 4096)
    pieces = packing.pack(documents(spark, rows).repartition(7), str(public_tokenizers.path("word_bpe_49k.json")))
    windows = pieces.groupBy("step", "tier", "sequence_id").agg(F.sum("length").alias("n")).collect()
    steps = max(w.step for w in windows) + 1
    total = sum(w.n for w in windows)
    assert steps == round(total / (16 * 4096)) > 3
    for tier in packing.TIERS:
        n = [sum(w.tier == tier and w.step == k for w in windows) for k in range(steps)]
        assert max(n) - min(n) <= 1
    tokens = [sum(w.n for w in windows if w.step == k) for k in range(steps)]
    assert max(tokens) - min(tokens) <= sum(packing.TIERS) + 512  # and the padding of the one short window
    assert sum(w.n != w.tier for w in windows) <= 1  # one window with padding, so no dust
    assert sum(4096 - w.n for w in windows if w.n != w.tier) < 0.02 * total


def test_packing_fills_gaps_from_shorter_tiers():
    packer = packing.Packer((4, 8), 0)
    for doc, n in enumerate([7, 1, 6, 3]):
        packer.add(doc, 0, bytes(4 * n))
    assert [x[0] for x in packer.window(8, 1)] == [7, 1]
    assert [x[0] for x in packer.window(8, 1)] == [6, 2]  # the last gap: the front of a piece, cut for it
    assert packer.tail() == [(1, 3, 2, bytes(4))]


# 9 ------------------------------------------------------------------------------------------------------------------------
def test_chats_round_trip(spark):
    rng = random.Random(9)
    nasty = ["", None, r"\### Assistant: </turn> ok", "</turn>\n### user:\n", "<turn-break>", "\\b\\l\\h\\\\", "é\U0001f600\n", "x" * 50_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b#<\\", None]), rng.choice(nasty)) for c in [0, 1, 2, None] for t in range(40)]
    rows += [(3, t, "assistant", f"t{t}") for t in range(700)] + [(0, 5, "user", "tie"), (0, 5, "user", "tie"), (4, None, "user", "first"), (4, 0, "user", "then")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("formatted", F.lit("x"))
    done = chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in done.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in turns]
        assert got[c].loss == "".join(x for _, _, r, x in turns if r == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_of_equal_turns_and_clashing_columns(spark):
    """A thousand turns of one number or of none; extra columns named as inner ones."""
    rows = [(1, 7 if t % 2 else None, "assistant", f"{t:04}") for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("id", "k", "run", "runs", "blocks", "turns", "body", "segments")})
    done = chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).first()
    assert [t.text for t in done.turns] == [f"{t:04}" for t in [*range(0, 1000, 2), *range(1, 1000, 2)]]
    assert done.formatted.count("### ") == 1  # one block


# 10 -----------------------------------------------------------------------------------------------------------------------
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = LETTERS.findall(lower(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t, *_ in rows:
        w = LETTERS.findall(lower(t))
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_leaks(spark, nothing, seed):
    rng = random.Random(seed + 20)
    rows = corpus(seed + 30)
    items = [(None, "one"), (1, None), (2, ""), (3, "ONE two, three!"), (4, "w1 w2"), (5, "unheard of words entirely")]
    for i in range(25):
        w = LETTERS.findall(lower(rng.choice(rows)[1]))
        a = rng.randrange(0, len(w) + 1)
        items.append((10 + i, prose(rng, 5) + " " + " ".join(w[a : a + rng.randrange(3, 30)]) + "; " + prose(rng, 5)))
    items += [items[-1], (99, items[-1][1]), (50, "w7 " * 30)]
    rows.append((500, "w7 " * 200 + "x " + "w7 " * 12, "en", "s", 1))
    rows.append((501, "w7 w8 " * 60 + "x " + "w7 " * 9, "en", "s", 1))
    items.append((51, "w8 w7 " * 20))
    df = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("class", F.lit(0))
    got = decontaminate.find_leaks(df, bench).withColumn("list", F.array_join("items", ","))
    assert table(got, "doc_id", "n_words", "n_hit", "n_items", "list") == leaks(rows, items)
    clean = decontaminate.without_leaks(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(r[2] == 0 for r in leaks(rows, items))
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_digest_helper():
    assert sha("a") == hashlib.sha256(b"a").hexdigest()
