"""What judges read, which candidates they are asked about, co-loads with their agents, next steps: against plain loops."""

import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.test_transcripts import rows
from tracelake.operators import judging, pairing
from tracelake.sinks import documents


def test_digests(spark):
    rng = random.Random(4)
    lines = [(s, i, rng.choice([None, "", "é" * rng.randrange(40), "x" * rng.randrange(30)])) for s in range(30) for i in range(rng.choice([0, 1, 2, 9]))]
    of = defaultdict(list)
    for s, _, t in lines:
        of[s].append(t or "")
    df, sessions = spark.createDataFrame(lines, "s long, i long, text string").repartition(3), spark.range(30).withColumnRenamed("id", "s")
    cut = lambda t, n: t[:n] + (" ..." if len(t) > n else "")
    block = {s: "\n\n".join(f"Turn {n}: {cut(t, 20)}" for n, t in enumerate(of[s], 1)) if of[s] else "(no user turns found)" for s in range(30)}
    assert rows(judging.turns_block(sessions, df, ["s"], "i", most=20), "s", "block") == sorted(block.items(), key=repr)
    for budget in (0, 7, 50, 10_000):
        want = {s: cut("\n".join(ts), budget) for s, ts in of.items() if ts}
        assert rows(judging.trajectory(df, ["s"], ["i"], budget=budget), "s", "trajectory") == sorted(want.items(), key=repr)


def test_candidates_within_a_limit_become_prompts(spark):
    c = spark.createDataFrame([("s", x) for x in "dbac"] + [("q", "z")], "session string, skill_id string")
    asked = judging.within_limit(c, ["session"], ["skill_id"], 2)
    assert rows(asked, "session", "skill_id", "asked") == [("q", "z", True), ("s", "a", True), ("s", "b", True), ("s", "c", False), ("s", "d", False)]
    assert judging.within_limit(c, ["session"], ["skill_id"], None).where("asked").count() == 5
    blocks = spark.createDataFrame([("s", "Turn 1: go"), ("q", "Turn 1: no")], "session string, block string")
    p = judging.prompts(asked, blocks, ["session"], lambda name, turns: F.concat(name, F.lit("? "), turns))
    replies = judging.ask(p.select(F.concat_ws("/", "id.session", "id.skill_id").alias("id"), "prompt"), lambda text: text.upper())
    assert rows(replies, "id", "reply") == [("q/z", "Z? TURN 1: NO"), ("s/a", "A? TURN 1: GO"), ("s/b", "B? TURN 1: GO")]


def test_co_loads_with_their_agents(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(4), f"a{rng.randrange(6)}", f"k{rng.randrange(5)}") for _ in range(80)] + [(0, None, "k1"), (0, "a1", None)]
    held = defaultdict(set)
    for s, g, m in pairs:
        if g and m:
            held[s, g].add(m)
    edges = defaultdict(list)
    for (s, g), ms in held.items():
        for a in ms:
            for b in ms:
                if a < b:
                    edges[s, a, b].append(g)
    want = []
    for s in range(4):
        mine = sorted(((-len(g), a, b, sorted(g)) for (x, a, b), g in edges.items() if x == s))
        want += [(s, a, b, -w, g, n) for n, (w, a, b, g) in enumerate(mine, 1)]
    got = pairing.co_load_groups(spark.createDataFrame(pairs, "s long, g string, m string"), ["s"], "g", "m")
    assert rows(got, "s", "a", "b", "weight", "groups", "place") == sorted(want, key=repr)


def co_loaded(pairs):
    """Groups by session and pair of members, by plain loops."""
    held, edges = defaultdict(set), defaultdict(list)
    for s, g, m in pairs:
        held[s, g].add(m)
    for (s, g), ms in sorted(held.items()):
        for a, b in itertools.combinations(sorted(ms), 2):
            edges[s, a, b].append(g)
    return edges


def test_co_load_edges_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(pairing, "ROWS", 100)
    rng = random.Random(8)
    pairs = [("s", g, rng.randrange(40)) for g in range(600) for _ in range(rng.randrange(6))] + [("s", 999, m) for m in range(300)]
    got = pairing.co_load_edges(spark.createDataFrame(pairs, "s string, g long, m long"), "g", "m")
    assert got.rdd.getNumPartitions() == -(-len(pairs) // 100)
    assert rows(got, "a", "b", "weight") == sorted(((a, b, len(g)) for (_, a, b), g in co_loaded(pairs).items()), key=repr)


def test_co_load_groups_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(pairing, "ROWS", 100)
    rng = random.Random(9)
    pairs = [(g % 97, g, rng.randrange(9)) for g in range(600) for _ in range(rng.randrange(6))]
    frame = spark.createDataFrame(pairs, "s long, g long, m long")
    got = pairing.co_load_groups(frame, ["s"], "g", "m")
    assert got.rdd.getNumPartitions() == -(-len(pairs) // 100)
    want = sorted(((s, a, b, g) for (s, a, b), g in co_loaded(pairs).items()), key=repr)
    assert rows(got, "s", "a", "b", "groups") == want
    alone = pairing.co_load_groups(frame, [], "g", "m")
    every = co_loaded([(0, g, m) for _, g, m in pairs])
    assert rows(alone, "a", "b", "groups") == sorted(((a, b, g) for (_, a, b), g in every.items()), key=repr)


def test_a_diff_makes_the_edges_once(spark, monkeypatch):
    monkeypatch.setattr(pairing, "ROWS", 100)
    rng = random.Random(10)
    names = ["Own", "b", "c", "d", "n:b", "m:c", "n:c", "OWN", "x", "y:z"]
    pairs = [("s", g, rng.choice(names)) for g in range(150) for _ in range(rng.randrange(4))] + [("s", 998, "x"), ("s", 998, "q"), ("s", 999, "n:b"), ("s", 999, "once")]
    declared = spark.createDataFrame([("d", "b"), ("own", "c"), ("c", "gone"), ("x", "x"), ("b", "once")], "a string, b string")
    report = pairing.library_report(declared, spark.createDataFrame(pairs, "s string, g long, m string"), "g", "m")
    belongs = {r.observed_id: r.id or r.observed_id for r in report["resolved"].collect()}
    weight = {}
    for (_, a, b), g in co_loaded(pairs).items():
        pair = tuple(sorted((belongs[a], belongs[b])))
        weight[pair] = max(len(g), weight.get(pair, 0))
    d = {tuple(sorted(x)) for x in (("d", "b"), ("own", "c"), ("c", "gone"), ("b", "once"))}
    want = [(*x, "consistent" if x in weight else "over_declared") for x in d] + [(*x, "implicit") for x, w in weight.items() if w >= 2 and x not in d]
    assert rows(report["diff"], "a", "b", "verdict") == sorted(want, key=repr)
    assert len(re.findall(r"posexplode|Join.*_m#", report["diff"]._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_next_steps(spark):
    schema = "session string, missing array<string>, failed_coverages array<double>, judge_errors long, file_reads long, loads long, cache_hit_rate double, hash_flips long, repeat_extra long, post_compaction long, compaction_known boolean, growth_verdict string, judge_enabled boolean"
    quiet = {"loads": 1, "judge_enabled": True}
    cases = {
        "all null": ({}, [("no_skill_used", ""), ("judge_not_configured", "")]),
        "quiet": (quiet, [("nothing_found", "")]),
        "missing": (quiet | {"missing": ["a", "b", "c", "d"], "failed_coverages": [0.5, 0.256]}, [("missing_skills", "a, b, c"), ("playbook_below_gate", "0.50, 0.26")]),
        "three at most": (quiet | {"judge_errors": 2, "file_reads": 3, "cache_hit_rate": 0.494, "hash_flips": 1}, [("judgments_dropped", "2"), ("skill_files_read", "3"), ("cache_misses", "49%")]),
        "limits": (quiet | {"file_reads": 2, "cache_hit_rate": 0.5, "repeat_extra": 4999}, [("nothing_found", "")]),
        "legal repeats": (quiet | {"repeat_extra": 9000, "post_compaction": 4001, "compaction_known": True}, [("repeats_after_compaction", "4999")]),
        "taxed repeats": (quiet | {"repeat_extra": 9000, "post_compaction": 4000, "compaction_known": True, "growth_verdict": "accelerating"}, [("repeats", "9000"), ("growth_accelerates", "accelerating")]),
        "unknown compactions": (quiet | {"repeat_extra": 5000, "post_compaction": 5000}, [("repeats", "5000")]),
        "read, not loaded": ({"file_reads": 1, "judge_enabled": False}, [("judge_not_configured", "")]),
    }
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple([k, *[facts.get(n) for n in names[1:]]]) for k, (facts, _) in cases.items()], schema)
    got = {r.session: [tuple(x) for x in r.steps] for r in documents.suggestions(df).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
