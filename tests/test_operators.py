"""Window rewrites against plain loops over random sequences."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import interventions, text
from tracelake.operators import asof, graph, growth, islands, liveness, loads, mentions, pairing, similarity

S = ["s"]


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(1)
    return [(s, i, rng.choice(["user", "assistant", "assistant", "meta"]), rng.random() < 0.3, rng.choice([None, "a", "b"]), rng.randrange(100)) for s in range(40) for i in range(rng.randrange(0, 40))]


@pytest.fixture(scope="module")
def records(spark, log):
    return spark.createDataFrame(log, "s long, seq long, kind string, positive boolean, anchor string, tokens long").cache()


def by_session(log):
    out = {}
    for r in log:
        out.setdefault(r[0], []).append(r[1:])
    return out


def spans_of(seq):
    out, open_ = [], []
    for i, kind, pos, *_ in seq:
        if kind == "user":
            open_ = []
        elif kind == "assistant":
            open_.append(i)
            if pos:
                out.append((open_[0], i, len(open_)))
                open_ = []
    return out


def test_spans(records, log):
    want = [(s, *x) for s, seq in by_session(log).items() for x in spans_of(seq)]
    assert rows(islands.spans(records, S), "s", "first_seq", "last_seq", "n_records") == sorted(want, key=repr)


def test_anchor_runs(records, log):
    want = []
    for s, seq in by_session(log).items():
        run = None
        for i, kind, _, anchor, _ in seq:
            if kind == "user":
                run = None
            elif kind == "assistant" and anchor:
                if run is None or run[1] != anchor:
                    run = [s, anchor, i, i, 0]
                    want.append(run)
                run[3], run[4] = i, run[4] + 1
    assert rows(islands.anchor_runs(records, S, "anchor"), "s", "anchor", "first_seq", "last_seq", "n_records") == sorted(map(tuple, want), key=repr)


def test_liveness(records, log):
    items = records.where("kind <> 'meta'")
    gone = liveness.gone_after(items, records.where("kind = 'meta'"), S)
    calls = islands.spans(items, S)
    got = liveness.alive_sums(gone, calls, S, ["user", "assistant"], bucket="kind")
    want = []
    for s, seq in by_session(log).items():
        stops = [i for i, k, *_ in seq if k == "meta"]
        for a, _, _ in spans_of([x for x in seq if x[1] != "meta"]):
            alive = [x for x in seq if x[1] != "meta" and x[0] < a and not any(x[0] < e <= a for e in stops)]
            want.append((s, a, sum(x[4] for x in alive if x[1] == "user"), sum(x[4] for x in alive if x[1] == "assistant"), len(alive)))
    assert rows(got, "s", "first_seq", "user_tokens", "assistant_tokens", "n_alive") == sorted(want, key=repr)
    refs = liveness.alive_refs(gone, calls, S).groupBy("s", "first_seq").agg(F.count("*").alias("n"))
    assert rows(refs, "s", "first_seq", "n") == sorted(((s, a, n) for s, a, _, _, n in want if n), key=repr)


def test_references_test_only_their_stretch(spark):
    """One session, a boundary every 50 rows: the join's keys hold the boundary, so pairs that it tests are about twice the result's."""
    log = [(0, i, "meta" if i % 50 == 49 else "assistant", i % 2 == 0, None, 1) for i in range(2000)]
    records = spark.createDataFrame(log, "s long, seq long, kind string, positive boolean, anchor string, tokens long")
    gone = liveness.gone_after(records.where("kind <> 'meta'"), records.where("kind = 'meta'"), S)
    calls = records.where("kind = 'assistant' and positive").select("s", F.col("seq").alias("first_seq"))
    refs = liveness.alive_refs(gone, calls, S)
    plan = refs._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "gone_seq" in join and "_next" in join
    got = refs.select("first_seq", "item_seq").collect()
    want = {(c, i) for c in range(0, 2000, 2) for i in range(c // 50 * 50, c)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    tested = sum(sum(x // 50 == e and x % 50 != 49 for x in range(2000)) * 25 for e in range(40))
    assert tested <= 2.1 * len(want)


def test_load_ledger(spark):
    rng = random.Random(2)
    entries = [(s, i, rng.randrange(2), rng.choice(["stub", "body"]), rng.choice([None, 99])) for s in range(60) for i in range(rng.randrange(0, 12))]
    want = []
    for s in range(60):
        for skill in range(2):
            stub, base = None, None
            for _, i, k, kind, gone in [e for e in entries if e[0] == s and e[2] == skill]:
                if kind == "stub":
                    if stub is not None:
                        want.append((s, skill, "unavailable", stub, None))
                    stub = i
                    continue
                if stub is not None:
                    want.append((s, skill, "load", stub, i))
                elif base is None:
                    want.append((s, skill, "load", i, i))
                elif base[0] is not None:
                    want.append((s, skill, "reload", i, i))
                stub, base = None, (gone,)
            if stub is not None:
                want.append((s, skill, "unavailable", stub, None))
    df = spark.createDataFrame(entries, "s long, seq long, skill long, kind string, gone_seq long")
    assert rows(loads.load_ledger(df, S, "skill"), "s", "skill", "load_kind", "opened_seq", "body_seq") == sorted(want, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, direction):
    rng = random.Random(3)
    left = [(rng.randrange(5), rng.randrange(30), i) for i in range(80)]
    right = [(rng.randrange(5), rng.randrange(30), i, f"v{i}") for i in range(40)]
    got = asof.asof(spark.createDataFrame(left, "s long, t long, i long"), spark.createDataFrame(right, "s long, t long, n long, v string"), S, "t", ["v"], direction, ["n"])
    want = []
    for s, t, i in left:
        fits = [(rt, n, v) for rs, rt, n, v in right if rs == s and (rt <= t if direction == "backward" else rt >= t)]
        want.append((s, t, i, (max(fits) if direction == "backward" else min(fits))[2] if fits else None))
    assert rows(got, "s", "t", "i", "v") == sorted(want, key=repr)


def test_similar_pairs(spark):
    rng = random.Random(4)
    sets = {i: frozenset(rng.sample(range(25), rng.randrange(0, 12))) for i in range(120)}
    sets |= {200 + i: sets[i] for i in range(20)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, shingles array<string>")
    reps = {}
    for i in sorted(sets):
        if sets[i]:
            reps.setdefault(sets[i], i)
    ids = sorted(reps.values())
    for by, least in (("containment", 0.6), ("jaccard", 0.5)):
        want = []
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                whole = min(len(sets[a]), len(sets[b])) if by == "containment" else len(sets[a] | sets[b])
                if a < b and n / whole >= least:
                    want.append((a, b, n))
        assert rows(similarity.similar_pairs(df, least, by), "a", "b", "shared") == sorted(want, key=repr)
    assert rows(similarity.classes(df), "node", "class_id") == sorted(((i, reps[s]) for i, s in sets.items() if s), key=repr)


def test_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    up = list(range(60))
    for a, b in edges * 60:
        up[a] = up[b] = min(up[a], up[b])
    seen = {x for e in edges for x in e if e[0] != e[1]}
    assert rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "component") == sorted(((x, up[x]) for x in seen), key=repr)
    reach = graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"), spark.createDataFrame([(1,)], "root long"), depth=2)
    assert rows(reach, "node", "depth") == [(1, 0), (2, 1), (3, 2)]


def climbed(links):
    """node, root, depth, cyclic, entry by walking up from each node."""
    up = {}
    for n, p in links:
        if n is not None:
            up[n] = p if n not in up or up[n] is None else up[n] if p is None else min(up[n], p)
    out = []
    for n in up:
        path = [n]
        while up[path[-1]] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if up[path[-1]] in up:
            at = path.index(up[path[-1]])
            out.append((n, min(path[at:]), at, True, path[at]))
        else:
            out.append((n, path[-1], len(path) - 1, False, path[-1]))
    return sorted(out)


FORESTS = {
    "trees": [(i, None if i % 7 == 0 else i - 1) for i in range(40)],
    "a long chain": [(i, i - 1 if i else None) for i in range(300)],
    "cycles of one, two and three, with tails": [(1, 1), (2, 1), (10, 11), (11, 10), (12, 11), (13, 12), (20, 21), (21, 22), (22, 20), (23, 22), (24, 23), (25, 20), (30, None), (31, 30)],
    "one large cycle": [(i, (i + 1) % 100) for i in range(100)] + [(200 + i, 200 + i - 1 if i else 50) for i in range(60)],
    "absent parents, null and repeated nodes": [(1, 99), (2, 1), (3, 2), (None, 1), (None, None), (4, None), (4, 2), (5, 3), (5, 4), (5, 3)],
    "nothing": [],
    "at random": [(i, random.Random(i).randrange(500)) for i in range(300)],
}


@pytest.mark.parametrize("case", FORESTS)
def test_parents_to_roots(spark, case):
    got = graph.parents_to_roots(spark.createDataFrame(FORESTS[case], "node long, parent long"))
    assert sorted(tuple(r) for r in got.select("node", "root", "depth", "cyclic", "entry").collect()) == climbed(FORESTS[case])


def test_preorder(spark):
    """Rows in print order against recursion: shared children, absent ones, cycles, a cap; two sessions with nodes of the same names."""
    rng = random.Random(7)
    edges = [(s, rng.randrange(12), rng.randrange(14), i) for s in range(2) for i in range(16)] + [(2, i, i + 1, 0) for i in range(8)] + [(3, 0, 0, 0)]
    nodes = [(s, n) for s in range(4) for n in range(12)]
    below = {}
    for s, a, b, i in sorted(edges, key=lambda e: e[3]):
        below.setdefault((s, a), []).append(b)
    want = []

    def walk(s, n, path, above, status):
        want.append((s, n, len(path) - 1, status))
        if status == "node":
            for k, b in enumerate(below.get((s, n), []), 1):
                d = len(path)
                walk(s, b, [*path, k], [*above, b], "absent" if b >= 12 else "cycle" if b in above else "capped" if d == 4 else "node")

    roots = [(s, r, r) for s in range(4) for r in (0, 3)]
    for s, r, _ in roots:
        walk(s, r, [r], [r], "node")
    frame = lambda x, c: spark.createDataFrame(x, c)
    got = graph.preorder(frame(roots, "s long, node long, at long"), frame(edges, "s long, src long, dst long, at long"), frame(nodes, "s long, node long"), ["s"], ["at"], 4)
    assert [tuple(r) for r in got.orderBy("s", "path").select("s", "node", "depth", "status").collect()] == want
    assert {r[3] for r in want} == {"node", "absent", "cycle", "capped"}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, keep=graph.cut: rounds.append(1) or keep(df))
    for links in (FORESTS["one large cycle"], FORESTS["a long chain"], FORESTS["cycles of one, two and three, with tails"]):
        rounds.clear()
        graph.parents_to_roots(spark.createDataFrame(links, "node long, parent long")).count()
        assert len(rounds) <= 5 + 2 * len(links).bit_length()


def test_mentions(spark):
    texts = [(1, "Alpha beta gamma"), (2, "xbetax"), (3, ""), (4, None), (5, "a b")]
    names = ["beta", "a", "et", "zz", "", "Alpha beta gamma"]
    got = mentions.mentions(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame([(n,) for n in names], "n string"), "i", "t", "n")
    assert rows(got, "i", "n") == sorted(((i, n) for i, t in texts for n in names if t and n and n in t), key=repr)


def test_mentions_within_sessions(spark):
    rng = random.Random(8)
    texts = [(s, i, "".join(rng.choice("abé ") for _ in range(rng.randrange(30)))) for s in range(3) for i in range(20)]
    names = [(s, "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))) for s in range(4) for _ in range(12)]
    got = mentions.mentions(spark.createDataFrame(texts, "s long, i long, t string"), spark.createDataFrame(names, "s long, n string"), "i", "t", "n", S)
    assert rows(got, "s", "i", "n") == sorted({(s, i, n) for s, i, t in texts for q, n in names if s == q and n in t}, key=repr)


def test_identities(spark):
    ids = spark.createDataFrame([("a", False), ("x:a", True), ("b", True), ("x:b", True), ("c", False), ("x:c", True), ("y:c", True), ("d", False)], "id string, listed boolean")
    got = dict(rows(pairing.merge_by_suffix(ids), "raw_id", "id"))
    assert (got["a"], got["b"], got["c"], got["d"]) == ("x:a", "b", "c", "d")
    how = {i: (o, h) for i, o, h in rows(pairing.match_declared(spark.createDataFrame([("A",), ("b",), ("c",), ("q",)], "id string"), ids.where("id like '%:%' or id = 'b'")), "id", "observed_id", "how")}
    assert how == {"A": ("x:a", "suffix"), "b": ("b", "exact"), "c": (None, "ambiguous"), "q": (None, "none")}


def test_occurrences(spark):
    r = [("k", 0.0, "t", 100, 1), ("k", 50.0, "t", 100, 2), ("k", 60.0, "u", 100, 3), ("k", 500.0, "u", 100, 4), ("k", None, "u", 100, 5), ("k", 55.0, "t", 5000, 6)]
    df = spark.createDataFrame([("s", *x) for x in r], "s string, c string, ts double, tool string, chars long, seq long")
    w = spark.createDataFrame([("s", 70.0, 80.0)], "s string, window_start double, window_end double")
    got = dict(rows(growth.classify_occurrences(df, w, ["s", "c"]), "seq", "class"))
    assert got == {1: None, 2: "poll", 6: "no_compaction", 3: "no_compaction", 4: "post_compaction", 5: "unclassified"}


def test_occurrences_without_evidence(spark):
    """Tools that aren't known are no poll; without any window of its session nothing is called a violation."""
    r = [("s", "k", 0.0, None, 100, 1), ("s", "k", 10.0, None, 100, 2), ("s", "k", 20.0, "t", 100, 3), ("s", "k", 30.0, "t", 100, 4), ("s", "k", 500.0, "t", 100, 5),
         ("q", "k", 0.0, "t", 100, 6), ("q", "k", 10.0, "t", 100, 7), ("q", "k", 900.0, "t", 100, 8), ("q", "k", 910.0, None, 100, 9)]
    df = spark.createDataFrame(r, "s string, c string, ts double, tool string, chars long, seq long")
    w = spark.createDataFrame([("s", 5000.0, 5001.0)], "s string, window_start double, window_end double")
    got = dict(rows(growth.classify_occurrences(df, w, ["s", "c"]), "seq", "class"))
    assert got == {1: None, 2: "no_compaction", 3: "no_compaction", 4: "poll", 5: "no_compaction", 6: None, 7: "poll", 8: "unclassified", 9: "unclassified"}


def test_turn_parts(spark):
    """What entered in a turn by kind, and the residual; turns that can't be compared have none."""
    t = spark.createDataFrame([("s", 1, 10, False), ("s", 2, 40, True), ("s", 3, 90, False), ("s", 4, 95, False)], "s string, turn_no long, context long, crossed boolean")
    parts = spark.createDataFrame([("s", 1, "tool", 12), ("s", 1, "tool", 3), ("s", 1, "output", 5), ("s", 2, "tool", 7), ("s", 3, "output", 50)], "s string, turn_no long, bucket string, tokens long")
    done = growth.turn_parts(growth.turn_growth(t, ["s"]), parts, ["s"], ["tool", "output"])
    assert rows(done, "turn_no", "added", "tool_added", "output_added", "system_added") == [(1, 30, 15, 5, 10), (2, 50, None, None, None), (3, 5, 0, 50, 0), (4, None, None, None, None)]
    assert rows(growth.part_totals(done, ["s"], ["tool", "output"]), "bucket", "bucket_tokens", "share") == [("output", 55, 0.6875), ("system", 10, 0.125), ("tool", 15, 0.1875)]


@pytest.mark.parametrize("t, n", [("审计报告", 4), ("hello world", 2), ("audit 审计", 3), ("", 0), ("a", 1), (None, 0), ("ひらカナ한글", 6)])
def test_token_estimate(spark, t, n):
    assert spark.createDataFrame([(t,)], "t string").select(text.estimate_tokens(F.col("t"))).first()[0] == n


CASES = [
    ("A goal has been set. 不是", "noise", "goal_nudge", "A goal has been set.", []),
    ("x <bash-input>ls", "self_serve", "operator_command", "<bash-input>", []),
    ("[Request interrupted by user for tool]", "interrupt", "interrupt_marker", "[Request interrupted by user", []),
    ("me@host ~/x % ls\nout 不是", "fact", "terminal_paste_back", "me@host ~/x %", []),
    (" ？? ", "status", "status_prod", "？?", []),
    ("进展如何了", "status", "status_prod", "进展", []),
    ("Commit  Push.", "chore", "operational_errand", "Commit  Push.", []),
    ("OK!", "confirm", "acknowledgement", "OK!", []),
    ("2", "confirm", "acknowledgement", "2", []),
    ("我说的是 b", "correction", "correction", "我说的是", []),
    ("是不是这样？", "question", "terminal_question", "是不是这样？", []),
    ("这不是", "correction", "correction", "不是", []),
    ("不要这样", "rejection", "rejection", "不要", []),
    ("不要" + "x" * 300, "unclassified", "unclassified", "", []),
    ("First. why is it?", "question", "terminal_question", "why is it?", []),
    ("see http://a.b/?q=1?", "unclassified", "unclassified", "", []),
    ("<command-name>/fix</command-name><command-args>do  it ok?</command-args>", "question", "terminal_question", "do it ok?", ["command"]),
    ("<command-name>/fix</command-name>", "chore", "bare_slash_command", "/fix", ["command"]),
    ("<image src=1>data</image> ok", "confirm", "acknowledgement", "ok", ["image_block"]),
    ("[Image #2]", "unclassified", "unclassified", "", ["image_ref"]),
    ("", "unclassified", "unclassified", "", []),
]


def test_interventions(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "i long, t string").select("i", interventions.classify(F.col("t")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert got.pop(99) is None
    assert [(c.label, c.rule, c.evidence, c.carriers) for _, c in sorted(got.items())] == [x[1:] for x in CASES]
