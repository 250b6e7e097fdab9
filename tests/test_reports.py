"""Reports over sessions: gaps, bills, parts of growth, trees, libraries and fleets, on small files and tables written here."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_transcripts import RICH, answer, rich, rows, said, write  # noqa: F401
from tracelake.model import analyses, fleet, timeline
from tracelake.model import session as model
from tracelake.operators import billing, gaps, loads, pairing
from tracelake.sources import transcripts as tr


@pytest.fixture(scope="module")
def audit(rich):  # noqa: F811
    return model.audit(rich, keep=lambda d: d.checkpoint())


def wire(kind, ts, **payload):
    return {"timestamp": ts, "message": {"type": kind, "payload": payload}}


def test_turn_parts_from_events(spark, tmp_path):
    """Typed text and what was wrapped around it, results of skills and of tools, what the model said, and the rest."""
    turn = lambda ts, text: wire("TurnBegin", ts, user_input=[{"type": "text", "text": text}])
    call = lambda i, ts, name, **a: wire("ToolCall", ts, id=i, function={"name": name, "arguments": json.dumps(a)})
    result = lambda i, ts, out: wire("ToolResult", ts, tool_call_id=i, return_value={"output": out})
    lines = [
        turn(1, "x" * 40 + "<system-reminder>" + "y" * 23 + "</system-reminder>"), wire("StatusUpdate", 2, context_tokens=100), call("a", 3, "Skill", skill="s"), result("a", 4, "z" * 80),
        call("b", 5, "grep"), result("b", 6, "z" * 20), call("c", 6.5, "cat"), result("c", 6.6, 'q <skill_content name="k">'), wire("ContentPart", 7, type="text", text="w" * 8), wire("ContentPart", 7.5, type="think", think="w" * 4),
        turn(10, "next"), wire("StatusUpdate", 11, context_tokens=100), wire("TurnTokens", 11.5), turn(20, "end"), wire("StatusUpdate", 20, context_tokens=160), turn(30, "z"), wire("StatusUpdate", 30, context_tokens=150), turn(40, "z"),
    ]
    write(tmp_path / "s1" / "wire.jsonl", lines)
    e = timeline.in_order(tr.load(spark, str(tmp_path / "s1/wire.jsonl"))).checkpoint()
    got = rows(timeline.turn_parts(e), "turn_no", "added", "history_added", "inject_added", "skill_added", "tool_added", "output_added", "system_added")
    assert got[:3] == [(1, 0, 10, 14, 26, 5, 3, 0), (2, 0, 1, 0, 0, 0, 0, 0), (3, 60, 1, 0, 0, 0, 0, 59)]
    assert got[3:] == [(4, -10, *[None] * 6), (5, None, *[None] * 6)]
    top = rows(timeline.top_items(e, 2).where("turn_no = 1"), "place", "bucket", "tokens")
    assert top == [(1, "skill", 20), (2, "inject", 14)]
    crossed = spark.createDataFrame([("s1", 15.0)], "session string, window_start double")
    assert [c for _, c in rows(timeline.turns(e, windows=crossed), "turn_no", "crossed")] == [False, True, False, False, False]


def test_billed_contexts_fill_in(spark, tmp_path):
    """Turns of a session without any measurement take their contexts from the billed series."""
    turn = lambda ts: wire("TurnBegin", ts, user_input=[{"type": "text", "text": "go"}])
    write(tmp_path / "s2" / "wire.jsonl", [turn(1), turn(10), turn(20)])
    write(tmp_path / "s3" / "wire.jsonl", [turn(1), wire("StatusUpdate", 1.5, context_tokens=7)])
    e = timeline.in_order(tr.load(spark, [str(tmp_path / f"s{k}/wire.jsonl") for k in (2, 3)])).checkpoint()
    assert rows(timeline.turns(e), "session") == [("s3",)]
    series = spark.createDataFrame([("s2", 2.0, 50, 1), ("s2", 12.0, 80, 2), ("s3", 1.2, 999, 1)], "session string, ts double, prompt long, row long")
    assert rows(timeline.turns(e, series), "session", "turn_no", "context") == [("s2", 1, 50), ("s2", 2, 80), ("s2", 3, 80), ("s3", 1, 7)]


def test_gaps(spark):
    o = [("s", "ns:alpha", "listing"), ("s", "ns:alpha", "listing"), ("s", "beta", "listing"), ("s", "beta", "body"), ("s", "gamma", "listing"), ("s", "delta", "listing"), ("s", "delta", "execution"), ("s", "eps", "stub"), ("q", "beta", "listing")]
    counted = gaps.counts(spark.createDataFrame(o, "session string, skill_id string, kind string"), ["session"])
    aliases = spark.createDataFrame([("s", "ns:alpha", "Alpha"), ("s", "gamma", "")], "session string, skill_id string, alias string")
    catalog = spark.createDataFrame([("ALPHA",), ("Beta",), ("beta",), ("Gamma",), ("unseen",)], "name string")
    names = gaps.names_of(counted, ["session"], aliases)
    matched = gaps.in_catalog(counted, names, catalog, ["session"])
    assert rows(matched.where("session = 's'"), "skill_id", "catalog_name") == [("beta", "Beta"), ("delta", None), ("eps", None), ("gamma", "Gamma"), ("ns:alpha", "ALPHA")]
    said_ = spark.createDataFrame([("s", "use the ALPHA one"), ("s", None), ("q", "gamma")], "session string, text string")
    open_ = gaps.candidates(matched, names, said_, ["session"])
    assert rows(open_, "session", "skill_id", "candidate") == [("q", "beta", False), ("s", "gamma", False), ("s", "ns:alpha", True)]
    judged = spark.createDataFrame([("s", "alpha", True, None), ("s", "beta", False, None), ("s", "x", None, "timeout"), ("s", "nowhere", True, None)], "session string, skill_name string, triggered boolean, error string")
    assert rows(gaps.missed_triggers(matched, judged, ["session"]), "skill_name", "skill_id") == [("alpha", "ns:alpha"), ("nowhere", None)]
    r = {x.session: x for x in gaps.report(matched, open_, catalog, judged, ["session"]).collect()}
    s = r["s"]
    assert (s.matched, s.ir_only, s.catalog_only, s.listed, s.loaded, s.executed) == (3, ["delta", "eps"], 1, 4, 2, 1)
    assert (s.listed_unloaded, s.loaded_unused) == (["gamma", "ns:alpha"], ["beta"])
    assert (s.candidates, s.prefiltered, s.missed, s.judge_errors, s.over_limit, s.unjudged) == (1, 1, 2, 1, 0, 2)
    assert (r["q"].over_limit, r["q"].unjudged) == (0, 1)
    assert {x.session: x.unjudged for x in gaps.report(matched, open_, catalog, judged.limit(0), ["session"], judge_configured=False).collect()} == {"s": 2, "q": 1}


def test_bill(spark):
    schema = "session string, growth long, repeat_extra long, post_compaction long, listing_extra long, loads long, load_cost long, dispatches long, return_tokens long, usage_records long, output long"
    f = spark.createDataFrame([("a", 100, 50, 20, 5, 2, 0, 1, 250, 3, 7), ("b", *[None] * 10)], schema)
    got = rows(billing.cost_rows(f, ["session"]).orderBy("session", "place"), "session", "place", "row_name", "volume", "share", "subtotal")
    assert got == [
        ("a", 1, "subagent_returns", 250, 0.625, 400), ("a", 2, "context_growth", 100, 0.25, 400), ("a", 3, "repeat_tax", 50, 0.125, 400), ("a", 4, "skill_load_cost", None, None, 400),
        ("a", 5, "ceremony", 25, None, 400), ("a", 6, "output", 7, None, 400), ("a", 7, "cache_signal", None, None, 400), ("b", 1, "output", None, None, 0), ("b", 2, "cache_signal", None, None, 0),
    ]
    r = spark.createDataFrame([("a", 4, 1, 2, 0.5, 3), ("b", 0, 0, 0, None, 0)], "session string, expected long, missing long, missed long, coverage double, file_reads long")
    assert rows(billing.routing(r, ["session"], True), "session", "line", "value") == [("a", "expect_missing", "1/4"), ("a", "file_reads", "3"), ("a", "judge_missed", "2"), ("a", "playbook_coverage", "0.50"), ("b", "judge_missed", "0")]
    assert billing.routing(r, ["session"], False).where("line = 'judge_missed'").count() == 0


def test_library(spark):
    pairs = [(g, m) for g, ms in {"1": ["ns:a", "b", "c:x"], "2": ["ns:a", "b", "d:x"], "3": ["B", "q"], "4": [None, "b"]}.items() for m in ms]
    declared = spark.createDataFrame([("a", "b"), ("b", "z"), ("x", "a"), ("a", "a")], "a string, b string")
    r = pairing.library_report(declared, spark.createDataFrame(pairs, "g string, m string"), "g", "m")
    assert rows(r["resolved"], "observed_id", "id", "how") == [("B", "b", "exact"), ("b", "b", "exact"), ("c:x", None, "ambiguous"), ("d:x", None, "ambiguous"), ("ns:a", "a", "suffix"), ("q", None, "none")]
    assert rows(r["diff"], "a", "b", "verdict") == [("a", "b", "consistent"), ("a", "x", "over_declared"), ("b", "z", "over_declared")]


def test_redundant_bodies_and_costs(spark):
    e = [("s", "k", 1, "stub", None, None, 1), ("s", "k", 2, "body", None, "t", 10), ("s", "k", 3, "body", None, "t", 11), ("s", "k", 4, "body", 9, "t", 12), ("s", "k", 5, "body", None, "u", 13), ("s", "z", 6, "stub", None, None, 1)]
    df = spark.createDataFrame(e, "session string, skill string, seq long, kind string, gone_seq long, channel string, tokens long")
    assert rows(loads.redundant_bodies(df, ["session"], "skill"), "session", "redundant_bodies") == [("s", 2)]
    ledger = loads.load_ledger(df, ["session"], "skill")
    priced = loads.load_costs(ledger, df.where("kind = 'body'"), ["session"], "skill")
    assert rows(priced, "skill", "load_kind", "cost_tokens", "channel") == [("k", "load", 10, "t"), ("k", "reload", 13, "u"), ("z", "unavailable", None, None)]


def test_tree_and_bundle(audit):
    tree = analyses.skill_tree(audit)
    nodes = {(r.session, r.agent): r for r in tree["nodes"].collect()}
    assert nodes["s1", "sidechain:u11"].parent_agent == "main" and not nodes["s1", "sidechain:u11"].loose
    assert nodes["s1", "subagent:kid"].loose and nodes["s1", "subagent:kid"].parent_agent is None
    main = nodes["s1", "main"]
    assert main.listed_skills == 2 and main.n_requests == 3 and main.listed_tokens > 0 and main.attachments == 2
    total = tree["totals"].first()
    assert (total.agents, total.loose, total.edges) == (3, 1, 1) and total.attached_tokens == sum(r.load_tokens for r in tree["attachments"].collect())
    for name, df in analyses.bundle(audit).items():
        assert df.collect() is not None, name
    edges = rows(analyses.co_loads(audit)["edges"], "a", "b", "weight")
    assert edges == [("beta", "ns:alpha", 1)]


def test_gap_report_of_an_audit(spark, audit):
    catalog = spark.createDataFrame([("alpha",), ("beta",), ("other",)], "name string")
    none = spark.createDataFrame([], "session string, skill_name string, triggered boolean, error string")
    open_, report = analyses.gap_report(audit, catalog, none)
    r = report.first()
    assert open_.count() == 0 and r.matched == 2 and r.catalog_only == 1 and r.listed == 2


def test_fleet(spark, tmp_path):
    """Two sessions below one root, one of them with a subagent's file of its own."""
    write(tmp_path / "p" / "s1.jsonl", RICH)
    write(tmp_path / "p" / "s1" / "subagents" / "kid.jsonl", [said("user", "find x", 1, parentToolUseId="t9"), answer([{"type": "text", "text": "x"}], 2, 50)])
    lines = [x for k in range(6) for x in (wire("TurnBegin", 10 * k + 1, user_input=[{"type": "text", "text": "go"}]), wire("StatusUpdate", 10 * k + 2, context_tokens=100 * k))]
    lines.insert(3, wire("UsageRecord", 5, input_other=30, input_cache_read=70, input_cache_creation=0, output=9))
    write(tmp_path / "q" / "s2" / "wire.jsonl", lines)
    every = fleet.sessions(spark, [str(tmp_path)], keep=lambda d: d.checkpoint()).checkpoint()
    got = {r.session: r for r in every.collect()}
    assert set(got) == {"s1", "s2"} and got["s2"].turns == 6 and got["s2"].growth == 400 and got["s2"].cache_hit_rate == 0.7 and got["s1"].compactions == 1
    r = fleet.report(every)
    overall = r["overall"].first()
    assert (overall.sessions, overall.with_usage, overall.compactions) == (2, 2, 1) and overall.output == got["s1"].output + 9
    assert dict(rows(r["shapes"], "shape", "sessions")) == {"accelerating": 1, "unavailable": 1}
    assert sum(x.sessions for x in r["by_style"].collect()) == sum(v.style is not None for v in got.values())
