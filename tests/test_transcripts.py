"""Scans of all formats and the session model, on small files written here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.model import analyses
from tracelake.model import session as model
from tracelake.sources import discovery, sidechannels
from tracelake.sources import transcripts as tr


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def said(kind, content, n, **more):
    return {"type": kind, "uuid": f"u{n}", "parentUuid": f"u{n - 1}", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "message": {"role": kind, "content": content}} | more


def anchor(n):
    return {"requestTokenAnchor": {"request": f"h{n}", "response": f"r{n}", "requestId": f"q{n}"}}


def answer(parts, n, tokens, **more):
    r = said("assistant", parts, n, **more)
    r["message"]["usage"] = {"input_tokens": tokens, "output_tokens": 5}
    return r


RICH = [
    {"type": "runtime-config", "model": "m", "contextWindow": 1000, "timestamp": 1767225600000},
    {"type": "attachment", "timestamp": "2026-01-01T00:00:01Z", "attachment": {"type": "skill_listing", "content": "- ns:alpha: does things\n- beta: other things"}},
    said("user", [{"type": "text", "text": "please 不是 so"}], 2, humanInput={"text": "please"}),
    answer([{"type": "text", "text": "well then"}, {"type": "tool_use", "id": "t1", "name": "Skill", "input": {"skill": "alpha", "b": 1}}], 3, 400, **anchor(1)),
    said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "Launching skill: alpha"}], 4),
    said("user", "Base directory for this skill: /x/alpha\nbody of it", 5),
    answer([{"type": "tool_use", "id": "t2", "name": "Read", "input": {"file_path": "/y/beta/SKILL.md"}}], 6, 500, **anchor(2)),
    said("user", [{"type": "tool_result", "tool_use_id": "t2", "content": [{"type": "text", "text": "beta body"}]}], 7),
    {"type": "system", "subtype": "compact_boundary", "timestamp": "2026-01-01T00:00:08Z", "compactMetadata": {"trigger": "auto", "preTokens": 900, "postTokens": 100}},
    {"type": "attachment", "timestamp": "2026-01-01T00:00:09Z", "attachment": {"type": "post_compact_restored_files", "files": [{"filePath": "a", "content": "kept"}, {"filePath": "b", "content": {"x": ["deep", {"y": "er"}]}}]}},
    answer([{"type": "tool_use", "id": "t3", "name": "Agent", "input": {"prompt": "go"}}], 10, 300, **anchor(3)),
    said("user", "do it", 11, isSidechain=True, parentToolUseId="t3"),
    said("assistant", "done", 12, isSidechain=True),
    "{broken",
    "[1]",
    {"type": "mystery"},
    {"type": "user", "message": 3},
    {"type": "user", "message": {"content": 3}},
]


@pytest.fixture(scope="module")
def rich(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("rich")
    write(d / "s1.jsonl", RICH)
    write(d / "s1" / "subagents" / "kid.jsonl", [said("user", "find x", 1, parentToolUseId="t9"), answer([{"type": "text", "text": "x"}], 2, 50, **anchor(9))])
    return tr.load(spark, [str(d / "s1.jsonl"), str(d / "s1/subagents/kid.jsonl")]).checkpoint()


@pytest.fixture(scope="module")
def audit(rich):
    return model.audit(rich, keep=lambda d: d.checkpoint())


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def test_events_in_order(rich):
    main = rich.where("origin = 'main'").orderBy("seq", "part")
    kinds = [r.type for r in main.collect()]
    assert kinds[:8] == ["RuntimeConfig", "Attachment", "TurnBegin", "ContentPart", "ToolCall", "UsageRecord", "ToolResult", "TurnBegin"]
    reasons = [r.reason for r in main.where("type = 'RecordDropped'").collect()]
    assert reasons == ["malformed_json", "non_dict", "record:mystery", "message_invalid", "content_invalid"]
    call = main.where("tool_id = 't1' and type = 'ToolCall'").first()
    assert call.tool_args == '{"skill": "alpha", "b": 1}'
    assert main.first().ts == 1767225600.0
    assert rich.where("origin = 'subagent:kid' and session = 's1'").count() == 3


def test_items(audit):
    got = {r.item_id: r for r in audit.items.collect()}
    assert (got["main:2:0"].bucket, got["main:2:0"].kind) == ("skill", "skill_catalog")
    assert got["main:5:0"].kind == "skill_stub" and got["main:5:0"].skill == "alpha"
    assert got["main:6:0"].kind == "skill_body" and got["main:6:0"].by_signature
    assert got["main:8:0"].skill == "beta" and got["main:8:0"].text == "beta body"
    assert [got[f"main:10:{i}"].text for i in (0, 1)] == ["kept", "b\ndeep\ner"]
    assert got["main:2:0"].gone_seq == 9 and got["main:10:0"].gone_seq is None
    assert got["sidechain:u11:12:0"].kind == "dispatch_brief" and got["subagent:kid:1:0"].bucket == "inject"
    assert got["main:3:0"].human == "please" and got["main:4:1"].skill == "alpha"


def test_calls_hold_what_is_alive(audit):
    calls = {r.call_id: r for r in audit.calls.collect()}
    items = audit.items.collect()
    for c in calls.values():
        alive = [i for i in items if i.agent == c.agent and i.seq < c.first_seq and (i.gone_seq is None or c.first_seq < i.gone_seq)]
        assert c.n_alive == len(alive)
        assert c.unattributed == c.anchor - sum(i.tokens for i in alive)
    assert calls["main:1"].anchor == 400 and calls["main:3"].inject_tokens > 0 and calls["main:3"].user_tokens == 0
    assert "sidechain:u11:1" not in calls  # no usage there


def test_observations_and_loads(audit):
    seen = rows(audit.observations, "kind", "skill_id", "channel", "call_id")
    assert ("listing", "ns:alpha", "skill_listing", "main:1") in seen
    assert ("body", "ns:alpha", "user_signature", "main:2") in seen
    assert ("body", "beta", "tool:read", "main:3") in seen
    assert ("execution", "ns:alpha", "skill_tool_call", "main:1") in seen
    loads = rows(audit.skill_loads, "skill_id", "load_kind", "opened_seq.seq", "body_seq.seq")
    assert loads == [("beta", "load", 8, 8), ("ns:alpha", "load", 5, 6)]


def test_links_compactions_interventions(audit):
    assert rows(audit.dispatches, "tool_id", "agent", "link") == [("t3", "sidechain:u11", "linked"), ("t9", "subagent:kid", "unmatched")]
    c = audit.compactions.first()
    assert (c.compaction_id, c.pre_tokens, c.n_restored) == ("main:compact:0", 900, 2)
    assert rows(audit.interventions, "item_id", "label", "evidence") == [("main:3:0", "correction", "不是")]
    assert rows(audit.dropped, "reason", "n")[0] == ("content_invalid", 1)
    tiers = dict(rows(audit.agents, "agent", "tier"))
    assert tiers["main"] == 1 and tiers["sidechain:u11"] == 3


def test_rollout(spark, tmp_path):
    p = write(tmp_path / "r.jsonl", [
        {"type": "session_meta", "payload": {}},
        {"timestamp": "2026-01-01T00:00:00+08:00", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "a"}, {"type": "input_text", "text": "b"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "no"}]}},
        {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"type": "summary_text", "text": "one"}, {"type": "summary_text", "text": "two"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "f", "arguments": "{}", "call_id": "c"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "o"}},
        {"type": "token_usage_record", "payload": {"usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}}},
        "{",
    ])
    e = tr.load(spark, p).orderBy("seq").collect()
    assert [(x.type, x.text) for x in e] == [("TurnBegin", "a\nb"), ("ContentPart", "one"), ("ToolCall", None), ("ToolResult", None), ("UsageRecord", None)]
    assert (e[4].usage.input_other, e[4].usage.cache_read) == (6, 4) and e[0].ts == 1767196800.0


def test_wire_formats(spark, tmp_path):
    cli = write(tmp_path / "s9" / "wire.jsonl", [
        {"timestamp": 1.5, "message": {"type": "TurnBegin", "payload": {"user_input": [{"type": "text", "text": "hi"}]}}},
        {"timestamp": 2.0, "message": {"type": "StatusUpdate", "payload": {"context_tokens": 7, "token_usage": {"input_other": 3}}}},
        {"timestamp": 3.0, "message": {"type": "LLMRequest", "payload": {"system_prompt_hash": "x"}}},
        {"message": {"type": "CompactionEnd"}},
        {"message": {"type": "Other"}},
    ])
    desk = write(tmp_path / "d" / "agents" / "agent-2" / "wire.jsonl", [
        {"timestamp": 1, "type": "turn.prompt", "origin": {"kind": "system"}, "input": []},
        {"timestamp": 2, "type": "turn.prompt", "input": [{"type": "text", "text": "yo"}]},
        {"timestamp": 3, "type": "context.append_loop_event", "event": {"type": "tool.call", "toolCallId": "t", "name": "n", "args": {"a": 1}}},
        {"timestamp": 4, "type": "usage.record", "usage": {"input_tokens": 5}, "model": "m"},
        {"timestamp": 5, "type": "token_counting.turn_recorded", "agentId": "other", "tokens": 3},
    ])
    e = tr.load(spark, [cli, desk]).orderBy("session", "seq").collect()
    assert [(x.session, x.origin, x.type) for x in e] == [
        ("d", "subagent:agent-2", "TurnBegin"), ("d", "subagent:agent-2", "ToolCall"), ("d", "subagent:agent-2", "UsageRecord"),
        ("s9", "main", "TurnBegin"), ("s9", "main", "StatusUpdate"), ("s9", "main", "LLMRequest"), ("s9", "main", "CompactionEnd"),
    ]
    assert e[4].usage.input_other == 3 and e[4].context_tokens == 7 and e[5].system_prompt_hash == "x"


def test_format_detection(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"type": "user", "message": {}}, {"type": "progress"}])
    write(tmp_path / "b.jsonl", [{"type": "session_meta", "data": {}}])
    write(tmp_path / "c.jsonl", [{"type": None}, {"other": 1}, "nonsense"])
    got = {r.source.rsplit("/", 1)[1]: r.format for r in tr.detect_format(tr.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.jsonl": "degraded", "b.jsonl": "degraded", "c.jsonl": None}
    assert tr.read_lines(spark, str(tmp_path / "c.jsonl")).where(F.col("v").isNull()).count() == 1


def test_analyses(spark, rich, audit):
    skills = {r.skill_id: r for r in analyses.skill_audit(audit).collect()}
    assert (skills["ns:alpha"].listings, skills["ns:alpha"].stubs, skills["ns:alpha"].bodies, skills["ns:alpha"].executions) == (1, 1, 1, 1)
    calls = {r.call_id: r for r in analyses.context_organization(audit).collect()}
    assert calls["main:1"].new_tokens > 0 and calls["main:1"].reinjected_tokens == 0
    assert calls["main:2"].reinjected_tokens == calls["main:1"].new_tokens and calls["main:3"].reinjected_tokens == 0
    made = rows(analyses.outputs(audit), "call_id", "kind")
    assert ("main:1", "assistant_text") in made and ("main:3", "tool_call") in made and len(made) == 5
    assert {r.item_id for r in analyses.short_lived(audit).collect()} == {"main:4:0", "main:4:1", "main:5:0", "main:6:0"}
    back = {r.tool_id: r for r in analyses.subagent_returns(audit).collect()}
    assert back["t3"].process_tokens == 2 and back["t3"].return_tokens is None
    p = analyses.process_signature(audit).first()
    assert (p.style, p.loads, p.signal, p.turns) == ("mixed", 2, 1, 1)
    assert analyses.usage(audit).first().input_other == 1250
    facts = analyses.runtime_facts(rich)
    assert facts.first().context_window == 1000
    assert analyses.window_shares(audit, facts).first().anchor == 0.3
    assert analyses.repeats(audit).count() == 0 and analyses.exact_resends(audit).count() == 0 and analyses.hash_runs(rich).count() == 0
    assert analyses.repeated_items(audit).count() == 0


def test_sidecars_and_discovery(spark, tmp_path):
    d = tmp_path / "ws"
    write(d / "s1.jsonl", [answer([{"type": "tool_use", "id": "t7", "name": "Task", "input": {}}], 1, 5)])
    for kid in ("a", "b", "c"):
        write(d / "s1" / "subagents" / f"{kid}.jsonl", [said("user", "go", 1)])
    (d / "s1" / "subagents" / "a.meta.json").write_text(json.dumps({"toolUseId": "t7", "agentType": "x"}))
    (d / "s1" / "subagents" / "b.meta.json").write_text("[")
    events = tr.load(spark, [str(d / "s1.jsonl"), str(d / "s1/subagents/*.jsonl")]).checkpoint()
    side = tr.sidecars(spark, str(d / "s1/subagents/*.meta.json"))
    assert rows(tr.sidecar_defects(events, side), "agent", "reason") == [("subagent:b", "meta_json_malformed"), ("subagent:c", "meta_json_missing")]
    assert rows(model.audit(events, lambda d: d.checkpoint(), side).dispatches, "tool_id", "agent", "link") == [("t7", "subagent:a", "linked")]
    found = discovery.discover(spark, [str(tmp_path)])
    assert rows(found, "session", "workspace") == [("s1", "ws")]
    assert discovery.search(found, "WS").count() == 1 and discovery.search(found, "none").count() == 0
    assert discovery.search(found, done=found.select("session")).first().cached and discovery.latest(found).first().session == "s1"


def test_child_events(spark):
    from pyspark.sql import functions as f

    key = b"0123456789abcdef"
    enc = lambda t: f.base64(f.expr("substring(aes_encrypt('%s', X'%s', 'CBC', 'PKCS', X'%s'), 17)" % (t.replace('"', '\\"'), key.hex(), key.hex())))
    base = spark.range(1).select(enc('{"contents": [{"type": "text", "text": "hi"}]}').alias("content"), f.lit("assistant").alias("role"), f.lit('{"prompt_tokens": 9, "completion_tokens": 2, "cached_tokens": 4}').alias("token_info"), f.lit(1).alias("id"))
    bad = spark.range(1).select(f.lit("???").alias("content"), f.lit("assistant").alias("role"), f.lit('{"prompt_tokens": 1, "completion_tokens": 1}').alias("token_info"), f.lit(2).alias("id"))
    m = base.unionByName(bad).select("*", f.lit("c").alias("session_id"), f.lit("p").alias("parent_session_id"), f.lit("t").alias("parent_tool_call_id"), f.lit("q").alias("request_id"), f.lit(1767225600000).alias("gmt_create"))
    got = sidechannels.child_events(m, f.lit(key), f.lit(key)).orderBy("seq", "part").collect()
    assert [(r.seq, r.type, r.text, r.usage and r.usage.input_other) for r in got] == [(1, "ContentPart", "hi", None), (1, "UsageRecord", None, 5), (2, "RecordDropped", None, None), (2, "UsageRecord", None, 1)]


def test_notes(spark, audit, rich):
    from tracelake.model import coverage

    chats = spark.createDataFrame([("s1", True, None, 3, 2, 40, 1, 1), ("s2", False, "no database", 0, 0, 0, 0, 0)], "session string, available boolean, reason string, children long, synthesized long, rows long, decrypt_failures long, skipped long")
    assert rows(coverage.notes(audit, rich, chats), "session", "place", "note", "subject") == [
        ("s1", 1, "no_system_channel", ""),
        ("s1", 2, "no_prefix_hashes", ""),
        ("s1", 3, "ungroupable", "sidechain:u11"),
        ("s1", 4, "child_chats", "children=3 synthesized=2 rows=40 decrypt_failures=1 skipped=1"),
        ("s2", 1, "child_chats_unavailable", "no database"),
    ]
    assert coverage.notes(audit, rich).count() == 3


def test_coverage(audit):
    from tracelake.model import coverage

    row = {r.session: r for r in coverage.sessions(audit).collect()}["s1"]
    assert (row.requests_with_anchor, row.tier1, row.tier3, row.ungroupable) == ("4/4", 2, 1, 1)
    assert (row.human_stamped, row.human_dropped, row.leads, row.residue) == (1, 0, 1, 0.0)
    assert ("anchor", 4, 0, 0) in rows(coverage.fields(audit), "field", "fact", "est", "missing")
    assert coverage.unknown_channels(audit).count() == 0


def test_timeline(spark, tmp_path):
    from tracelake.model import timeline

    def wire(kind, ts, **payload):
        return {"timestamp": ts, "message": {"type": kind, "payload": payload}}

    call = lambda i, ts, name, **a: wire("ToolCall", ts, id=i, function={"name": name, "arguments": json.dumps(a)})
    turn = lambda ts: wire("TurnBegin", ts, user_input=[{"type": "text", "text": "go"}])
    lines = [wire("CompactionEnd", 0.5), turn(1), wire("StatusUpdate", 2, context_tokens=10), call("a", 3, "Skill", skill="x"), wire("ToolResult", 4, tool_call_id="a", return_value={"output": "old", "is_error": True}),
             wire("ToolResult", 4.5, tool_call_id="a", return_value={"output": "new"}), turn(5), wire("StatusUpdate", 6, context_tokens=30), wire("CompactionBegin", 7), wire("CompactionEnd", 8), wire("CompactionEnd", 9), wire("CompactionBegin", 9.5),
             call("b", 10, "skill", skill="y"), call("c", 10, "Read", file_path="/z/skill.md"), turn(11)]
    write(tmp_path / "s5" / "wire.jsonl", lines)
    write(tmp_path / "s6" / "wire.jsonl", [turn(1)])
    e = timeline.in_order(tr.load(spark, [str(tmp_path / "s5/wire.jsonl"), str(tmp_path / "s6/wire.jsonl")])).checkpoint()
    assert rows(timeline.compactions(e), "i", "begin_ts", "end_ts") == [(0, 7.0, 9.0), (1, 9.5, None)]
    assert rows(timeline.skill_loads(e), "skill", "is_error", "content", "context_tokens", "evicted_ts") == [("x", False, "new", 30, 7.0), ("y", True, "", None, None)]
    assert rows(timeline.file_reads(e), "path") == [("/z/skill.md",)]
    assert rows(timeline.turns(e), "turn_no", "context", "added", "crossed", "comparable") == [(1, 10, 0, False, True), (2, 10, 20, True, False), (3, 30, None, False, False)]
    assert rows(timeline.verdicts(e), "session", "verdict") == [("s5", "insufficient data (1 turns)"), ("s6", "unavailable (no context telemetry)")]
    lines_of = [r.line for r in timeline.feed(e.where("session = 's5'"), 3).orderBy("n").collect()]
    assert lines_of == ['call skill({"skill": "y"})', 'call Read({"file_path": "/z/skill.md"})', "user: go"]


def test_load_reads_once(spark, tmp_path):
    """One text scan and no exchange at all, whatever the number of formats."""
    write(tmp_path / "a.jsonl", [{"type": "user", "parentUuid": None, "message": {"content": "hi"}}])
    plan = tr.load(spark, str(tmp_path / "a.jsonl"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("Exchange") == 0 and plan.count("ArrowEvalPython") == 1


def test_shared_children(spark, tmp_path):
    """A folder of subagents beside two transcripts belongs to both; one below a session's own folder to that session."""
    hi = lambda n: [said("user", "hi", n)]
    for path in ("w/a.jsonl", "w/b.jsonl", "w/a/subagents/own.jsonl", "w/subagents/kid.jsonl", "v/subagents/lone.jsonl"):
        write(tmp_path / path, hi(1))
    e = tr.with_shared_children(tr.load(spark, str(tmp_path), recursive=True))
    assert rows(e, "session", "origin") == [("a", "main"), ("a", "subagent:kid"), ("a", "subagent:own"), ("b", "main"), ("b", "subagent:kid"), ("v", "subagent:lone")]


def test_lines_are_numbered_split_by_split(spark, tmp_path):
    """Files in one split and in many, with lines longer than a split, blank ones, and a format that only a late line tells."""
    rng = random.Random(2)
    files = {}
    for f in range(6):
        late = rng.randrange(1, 300)
        lines = [rng.choice(["", "{", "[]", '{"type": "user"}', '{"a": NaN, "type": "progress"}', '{"b": "é%s"}' % ("y" * rng.randrange(300))]) for _ in range([3, 40, 400, 400, 1, 200][f])]
        if f in (1, 2, 3):
            lines.insert(min(late, len(lines)), '{"type": "%s", "origin": null}' % ["", "session_meta", "user", "a.b"][f])
        if f == 3:
            lines.insert(5, '{"long": "%s"}' % ("z" * 9000))
        files[f"f{f}.jsonl"] = lines
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "empty.jsonl").write_text("")
    told = {"f1.jsonl": "rollout", "f2.jsonl": "rich", "f3.jsonl": "wire"}
    want = sorted((name, n, line, told.get(name)) for name, lines in files.items() for n, line in enumerate(lines, 1))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for most, least in (("128m", "4m"), ("2000", "10")):
            spark.conf.set(keys[0], most)
            spark.conf.set(keys[1], least)
            df = tr.read_lines(spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange" in plan) == (most == "2000") and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
            got = df.select("source", "seq", "line", "format").collect()
            assert sorted((r.source.rsplit("/", 1)[1], r.seq, r.line, r.format) for r in got) == want
            by_plan = {r.source.rsplit("/", 1)[1]: r.format for r in tr.detect_format(df.drop("format")).collect()}
            assert {k: v for k, v in by_plan.items() if v} == told  # the rules in Python are those of the columns
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
