"""Dispatches of sessions: the join both ways, tiers of evidence, phases, counters, stamps; rules and resolution against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_transcripts import answer, rows, said, write
from tracelake.model import session as model
from tracelake.operators import evidence
from tracelake.operators.evidence import Pattern, Rule
from tracelake.sources import transcripts as tr

RULES = (
    Rule("plan", "Planning", (Pattern(r"phase[-_ ]?1", "brief"), Pattern(r"/plans?/", "read", "dir"), Pattern("x", "read", "unheard of"))),
    Rule("code", "Coding", (Pattern(r"(?i)phase 2\b", "brief", "phase_file"), Pattern(r"\.py$", "read", "skill_file"))),
    Rule("code", "Second name", (Pattern("never", "brief"),)),
    Rule("late", None, (Pattern("late", "brief"),)),
)


def call(n, tool, **args):
    return answer([{"type": "tool_use", "id": f"t{n}", "name": tool, "input": args}], n, 50)


def read(n, path):
    return answer([{"type": "tool_use", "id": f"r{n}", "name": "Read", "input": {"file_path": path}}], n, 5)


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sent")
    write(d / "s1.jsonl", [
        call(1, "Agent", subagent_type="explore", description="look", prompt="p"),
        call(2, "Agent", subagent_type=5, description=None),
        call(3, "agent"), call(4, "Task"), call(5, "Agent"), call(6, "Agent"), call(7, "Agent"), call(8, "Read"), call(9, "Agent"),
        said("user", "in line: late", 10, isSidechain=True, parentToolUseId="t9"),
        said("assistant", "done", 11, isSidechain=True),
    ])
    kids = {
        "a": ([said("user", "é work on phase-1 and phase_1", 1, parentToolUseId="t1"), read(2, "/plan/a"), read(3, "/plan/a"), read(4, "/other")], None),
        "b": ([said("user", "nothing to see", 1, parentToolUseId="t2"), read(2, "/src/b.py")], {"toolUseId": "t4", "agentType": "from meta", "description": "said there"}),
        "c": ([said("user", "PHASE 2", 1)], {"toolUseId": "t4", "agentType": "typed", "description": "told"}),
        "d": ([said("user", "Base directory for this skill: /x/Alpha\nphase-1 body", 1, parentToolUseId="t5")], None),
        "e": ([said("user", "phase 1, then phase 2", 1, parentToolUseId="t6")], None),
        "f": ([answer([{"type": "text", "text": "no brief"}], 1, 5, parentToolUseId="t7")], None),
        "g": ([said("user", "phase 2", 1, parentToolUseId="nowhere")], None),
        "h": ([said("user", "phase 2", 1)], {"toolUseId": "", "agentType": "x"}),
        "chat": ([said("user", "phase 2", 1, parentToolUseId="t6")], None),
    }
    for name, (records, meta) in kids.items():
        write(d / "s1" / "subagents" / f"{name}.jsonl", records)
        if meta:
            (d / "s1" / "subagents" / f"{name}.meta.json").write_text(json.dumps(meta))
    write(d / "s2.jsonl", [said("user", "alone", 1)])
    events = tr.load(spark, [str(d / "s1.jsonl"), str(d / "s2.jsonl"), str(d / "s1/subagents/*.jsonl")])
    # child chats come from a database, not from a file
    events = events.withColumn("origin", F.when(F.col("origin") == "subagent:chat", "subagent:ide-db:z").otherwise(F.col("origin"))).checkpoint()
    return model.audit(events, lambda x: x.checkpoint(), tr.sidecars(spark, str(d / "s1/subagents/*.meta.json")), RULES, "v1")


def test_tiers(audit):
    got = {(r.tool_id, r.agent): r for r in audit.dispatches.where("session = 's1'").collect()}
    of = lambda t, kid: got[t, kid and f"subagent:{kid}"]
    told = {k: (r.link, r.link_source, r.tier, r.phase_id) for k, r in ((k, of(*k)) for k in (("t1", "a"), ("t2", "b"), ("t3", None), ("t4", "c"), ("t5", "d"), ("t6", "e"), ("t6", "ide-db:z"), ("t7", "f"), ("nowhere", "g")))}
    assert told == {
        ("t1", "a"): ("linked", "records", "B", "plan"),
        ("t2", "b"): ("linked", "records", "B", "code"),
        ("t3", None): ("orphan", None, "C", None),
        ("t4", "c"): ("linked", "meta", "B", "code"),
        ("t5", "d"): ("linked", "records", "A", "alpha"),
        ("t6", "e"): ("linked", "records", "B", None),
        ("t6", "ide-db:z"): ("linked", "records", "B", "code"),
        ("t7", "f"): ("linked", "records", "C", None),
        ("nowhere", "g"): ("unmatched", "records", None, None),
    }
    assert len(got) == 10 and [r.tier for (t, _), r in got.items() if t == "t9"] == ["B"]
    a, b, c = of("t1", "a"), of("t2", "b"), of("t4", "c")
    assert (a.subagent_type, a.description, b.subagent_type, b.description, c.subagent_type, c.description) == ("explore", "look", "from meta", "said there", "typed", "told")
    assert [tuple(x) for x in a.phase_refs] == [("phase-1", "unknown", "brief", 10, "plan"), ("/plan/", "dir", "read:/plan/a", 0, "plan"), ("/plan/", "dir", "read:/plan/a", 0, "plan")]
    assert [tuple(x) for x in of("t6", "e").phase_refs] == [("phase 1", "unknown", "brief", 0, "plan"), ("phase 2", "phase_file", "brief", 14, "code")]
    numbers = {r.tool_id: r.dispatch_id for r in got.values()}
    assert [numbers[f"t{n}"] for n in (1, 2, 3, 4, 5, 7, 9)] == [f"main:dispatch:{n}" for n in (1, 2, 3, 4, 5, 8, 9)] and numbers["nowhere"] is None


def test_phases_withhold_what_they_cannot_tell(audit):
    got = rows(audit.phases.where("dispatch_id like 'main:%'"), "dispatch_id", "phase_id", "name", "tokens")
    tokens = {r.dispatch_id: r.brief_tokens for r in audit.dispatches.collect()}
    t = lambda n: tokens[f"main:dispatch:{n}"]
    assert got == [(f"main:dispatch:{n}", p, name, cost) for n, p, name, cost in [
        (1, "plan", "Planning", t(1)), (2, "code", "Coding", t(2)), (4, "code", "Coding", t(4)), (5, "alpha", "Alpha", t(5)), (6, "code", "Coding", None), (6, "plan", "Planning", None), (7, "code", "Coding", t(7)), (9, "late", None, t(9)),
    ]]


def test_counters(audit):
    links = {r.session: r.asDict() for r in audit.dispatch_links.collect()}
    assert links["s1"] == {"session": "s1", "dispatches": 9, "joined": 6, "joined_via_ide_db": 1, "joined_via_meta_only": 1, "orphan_dispatches": 1, "unmatched_subagent_files": 2, "meta_files_loaded": 3, "briefs_found": 7, "briefs_missing": 2}
    assert set(links["s2"].values()) == {"s2", 0}
    assert rows(audit.phase_recognition, "session", "tierA", "tierB", "tierC", "rule_set_version") == [("s1", 1, 6, 2, "v1"), ("s2", 0, 0, 0, "v1")]


def test_items_are_stamped(audit):
    got = rows(audit.items.where("phase_id is not null"), "agent", "kind", "seq", "phase_id")
    assert got == [
        ("sidechain:u10", "dispatch_brief", 10, "late"), ("subagent:a", "dispatch_brief", 1, "plan"), ("subagent:a", "tool_call", 3, "plan"), ("subagent:b", "dispatch_brief", 1, "code"),
        ("subagent:b", "tool_call", 2, "code"), ("subagent:c", "dispatch_brief", 1, "code"), ("subagent:d", "skill_body", 1, "alpha"), ("subagent:ide-db:z", "dispatch_brief", 1, "code"),
    ]
    assert {r.bucket for r in audit.items.where("agent = 'subagent:d' and kind = 'skill_body'").collect()} == {"skill"}


def test_without_rules_nothing_is_told(spark):
    d = spark.createDataFrame([(1, "phase 1", None), (2, None, "f")], "id long, t string, fact string")
    got = evidence.resolved(d.withColumn("refs", evidence.match_refs(F.col("t"), F.lit("brief"), (), "brief")), "fact", F.col("fact").isNotNull())
    assert rows(got, "id", "tier", "phase_id") == [(1, "C", None), (2, "A", "f")]


def test_refs_against_a_loop(spark):
    rng = random.Random(3)
    rules = tuple(Rule(f"p{i % 4}", f"n{i}", (Pattern(p, rng.choice(["brief", "read"]), rng.choice([*evidence.REF_KINDS, "odd"])),)) for i, p in enumerate(["ab", "a+", "^b", "c$", "(?i)D", "[^a]b", "é.", "a|b", r"(.)\1", "zz"]))
    texts = [None, ""] + ["".join(rng.choice("abcdDé\U0001f600 ") for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for target in ("brief", "read"):
        got = df.select("id", evidence.match_refs(F.col("t"), F.lit("s"), rules, target).alias("refs")).collect()
        for r in got:
            want = []
            for rule in rules:
                for p in rule.patterns:
                    if p.target == target and p.kind in evidence.REF_KINDS and (m := re.search(p.regex, texts[r.id] or "")) and texts[r.id] is not None:
                        want.append((m.group(0), p.kind, "s", m.start(), rule.phase_id))
            assert [tuple(x) for x in r.refs] == want, texts[r.id]


def test_sidechains_with_cycles(spark, tmp_path):
    """Agents by climbing from each record in order: a cycle and what hangs on it are one agent, named where the first climb ends."""
    up = {"a": None, "b": "a", "t": "q", "p": "q", "q": "r", "r": "p", "w": "p", "x": "y", "y": "x", "z": "gone", "s": "s"}
    lines = [said("assistant", "x", i + 1) | {"isSidechain": True, "uuid": u, "parentUuid": p} for i, (u, p) in enumerate(up.items())]
    events = tr.load(spark, write(tmp_path / "s.jsonl", lines))
    want, memo = [], {}
    for u in up:
        chain, at = [], u
        while at in up and at not in memo and at not in chain:
            chain.append(at)
            at = up[at]
        root = memo.get(at, chain[-1] if chain else None)
        memo |= dict.fromkeys(chain, root)
        want.append((u, f"sidechain:{memo[u]}"))
    got = model.records_of(events).select("ref.uuid", "agent")
    assert rows(got, "uuid", "agent") == sorted(want, key=repr) and len({a for _, a in want}) == 5
