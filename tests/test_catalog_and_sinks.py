"""Catalog scans, side channels, sinks, judging, streams."""

import base64
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracelake.model import catalog as audit
from tracelake.operators import judging
from tracelake.sinks import documents as sinks
from tracelake.sources import catalog, sidechannels
from tracelake.streaming import sessions as streams


def skill(root, name, text):
    p = root / name / "SKILL.md"
    p.parent.mkdir(parents=True)
    p.write_text(text, encoding="utf-8")


def test_front_matter():
    m = catalog.front_matter("name: 'it''s'\ndescription: >-\n  one\n  two\n\n  three\nrequires:\n  - a\n  - \"b\"\nmetadata:\n  name: inner\nplain: some # note\nwrapped: one\n  two\nlit: |\n  x\n   y")
    assert m == {"name": "it's", "description": "one two\nthree", "requires": ["a", "b"], "plain": "some", "wrapped": "one two", "lit": "x\n y"}
    assert catalog.names("[a, 'b', a]") == ["a", "b"] and catalog.names("a,b ,") == ["a", "b"] and catalog.names(None) == []


def test_scan_merge_and_audit(spark, tmp_path):
    body = "\n".join(f"line {i} of the body" for i in range(30))
    skill(tmp_path, "alpha", f"---\nname: alpha\ndescription: does alpha things\nrequires: [beta, gone]\n---\n{body}\nsee [x](references/a.md#p)\n")
    skill(tmp_path, "beta", f"---\ndescription: x\ndisable-model-invocation: true\nrequires: gamma\n---\n{body}\nmore\n")
    skill(tmp_path, "deep/er/gamma", "no front matter")
    skill(tmp_path, "zz/alpha2", "---\nname: alpha\ndescription: second\n---\n")
    c = catalog.scan(spark, [str(tmp_path)]).cache()
    rows = {r.name: r for r in c.collect()}
    assert set(rows) == {"alpha", "beta", "gamma"} and rows["alpha"].description == "does alpha things"
    assert rows["beta"].disable_model_invocation and rows["beta"].description_parse_failed and rows["alpha"].requires == ["beta", "gone"]
    assert rows["gamma"].body == "no front matter"
    extra = catalog.injected(spark.createDataFrame([(json.dumps({"skills": {"ALPHA": {"description": "better", "intent": " i "}, "bad": 3, "new": {"description": "n"}}}),), ("[]",), ("{",)], "json string"))
    merged = {r.name: r.source for r in catalog.merge(c, extra).collect()}
    assert merged == {"ALPHA": "injected", "new": "injected", "beta": "scanned", "gamma": "scanned"}
    given = spark.createDataFrame([(json.dumps({"p": {"body_path": "/b/p.md"}, "q": {"description": "says", "body_path": "/b/none.md"}, "r": {"body_path": "/b/none.md"}}),)], "json string")
    held = {r.name: r for r in catalog.injected(given, spark.createDataFrame([("/b/p.md", "---\nx: y\n---\n the body \n")], "path string, text string")).collect()}
    assert set(held) == {"p", "q"} and held["p"].body == held["p"].trigger_excerpt == "the body" and held["q"].body == "" and held["q"].path == "/b/none.md"
    bodies, spoken = audit.duplicates(c)
    assert [(r.a, r.b) for r in bodies.collect()] == [("alpha", "beta")] and spoken.count() == 0
    closed = {r.root: r for r in audit.closures(c).collect()}
    assert closed["alpha"].unresolved == ["gone"] and closed["alpha"].members == 3 and not closed["alpha"].truncated
    assert {r.root: r.truncated for r in audit.closures(c, depth=1).collect()} == {"alpha": True, "beta": False}
    files = spark.createDataFrame([("alpha", "references/a.md", "x" * 40), ("alpha", "references/unknown.md", "y" * 400)], "name string, target string, text string")
    with_files = {r.root: r for r in audit.closures(c, files=files).collect()}
    assert (with_files["alpha"].n_files, with_files["alpha"].file_tokens) == (1, 10) and with_files["alpha"].tokens == closed["alpha"].tokens + 10 and with_files["beta"].n_files == 0
    lost = [(r.a, r.b, r.exact, r.waste > 0) for r in audit.wasted(c.unionByName(c.where("name = 'beta'").withColumn("name", F.lit("beta2")))).orderBy("a", "b").collect()]
    assert lost == [("alpha", "beta", False, True), ("beta", "beta2", True, True)]
    assert {r.target for r in audit.references(c).collect()} == {"references/a.md"}  # once for the link, once for the mention
    s = audit.summary(c).first()
    assert s.skills == 3 and s.parse_failures == 2 and s.activation > s.discovery > 0
    assert {r.name: r.tier for r in audit.sizes(c).collect()} == dict.fromkeys(("alpha", "beta", "gamma"), "ok")
    assert "unusable" in {r.tier for r in audit.descriptions(c).collect()}
    assert sinks.text_table(audit.sizes(c).select("name", "tier"), ["name"], 2) == "name   tier\nalpha  ok\nbeta   ok\n"


def test_side_channels(spark, tmp_path):
    db = tmp_path / "a.db"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE chat_message (session_id TEXT, gmt_create INTEGER, token_info TEXT)")
    info = lambda **k: json.dumps(k)
    con.executemany("INSERT INTO chat_message VALUES (?, ?, ?)", [
        ("s", 1767225600000, info(prompt_tokens=10, completion_tokens=2, cached_tokens=1)), ("s", 1767225601, info(prompt_tokens=4, completion_tokens=1, cached_tokens=0)),
        ("s", 5, info(prompt_tokens=4)), ("t", 1, None), ("t", 2, "{")])
    con.commit()
    con.close()
    rows = sidechannels.read_table(spark, [str(db), str(tmp_path / "none.db")], "chat_message", "session_id string, gmt_create long, token_info string")
    series = sidechannels.billed_series(rows).orderBy("ts").collect()
    assert [(r.ts, r.prompt) for r in series] == [(1767225600.0, 10), (1767225601.0, 4)]
    usage = {r.session_id: r for r in sidechannels.billed_usage(rows).collect()}
    assert (usage["s"].requests, usage["s"].prompt_tokens, usage["s"].status) == (2, 14, "billed") and usage["t"].status == "unparseable"
    name = spark.range(1).select(sidechannels.session_uuid(F.lit("/x/0A234567-89ab-4def-8123-456789abcdef-note.jsonl")).alias("u"), sidechannels.session_uuid(F.lit("x.jsonl")).alias("n")).first()
    assert name.u == "0a234567-89ab-4def-8123-456789abcdef" and name.n is None
    key = b"0123456789abcdef"
    made = spark.range(1).select(F.base64(F.aes_encrypt(F.lit("hello"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(key))).alias("c")).first().c
    stored = base64.b64encode(base64.b64decode(made)[16:]).decode()
    out = spark.createDataFrame([(stored,), ("no base64!",), ("AAAA",), (None,)], "c string").select(sidechannels.decrypted(F.col("c"), F.lit(key), F.lit(key)).alias("p"))
    assert [r.p for r in out.collect()] == ["hello", None, None, None]


def test_damaged_side_channels_fail(spark, tmp_path):
    (tmp_path / "bad.db").write_bytes(b"no database" * 100)
    sqlite3.connect(tmp_path / "empty.db").close()
    read = lambda name: sidechannels.read_table(spark, [str(tmp_path / name)], "chat_message", "session_id string").collect()
    assert read("empty.db") == [] and read("none.db") == []
    with pytest.raises(Exception, match="not a database"):
        read("bad.db")


def test_child_chats(spark):
    sessions = spark.createDataFrame([("c1", "p", "t1", "agent_sub_x"), ("c2", "p", "t2", "agent_sub"), ("c3", "p", "", "agent_sub"), ("c4", "p", "t4", "main")], "session_id string, parent_session_id string, parent_tool_call_id string, session_type string")
    messages = spark.createDataFrame([(c,) for c in ("c1", "c2", "c3", "c4")], "session_id string")
    claimed = spark.createDataFrame([("t2",)], "tool_id string")
    assert [r.session_id for r in sidechannels.child_chats(sessions, messages, claimed).collect()] == ["c1"]
    assert sidechannels.hint(spark.createDataFrame([("t1",), ("t2",), ("t9",)], "tool_id string"), sessions, claimed).first().n == 1


def test_json_documents(spark):
    a = spark.createDataFrame([("s", 2, "y"), ("s", 1, "x"), ('q"', 1, "z")], "session string, n int, v string")
    b = spark.createDataFrame([("s", 1.5)], "session string, w double")
    docs = {r.session: json.loads(r.document) for r in sinks.json_documents({"items": (a, ["n"]), "calls": (b, ["w"])}).collect()}
    assert docs["s"] == {"version": sinks.VERSION, "session": "s", "items": [{"n": 1, "v": "x"}, {"n": 2, "v": "y"}], "calls": [{"w": 1.5}]}
    assert docs['q"']["session"] == 'q"' and docs['q"']["calls"] == []


def test_judging(spark):
    c = spark.createDataFrame([(1, "p1", "the text"), (2, "p2", "other"), (3, "boom", "x")], "id long, prompt string, text string")

    def judge(prompt):
        if prompt == "boom":
            raise ValueError("no answer")
        return 'so: {"verdict": "covered", "evidence": "the text"}'

    replies = judging.ask(c, judge).join(c.select("id", "text"), "id")
    got = {r.id: r for r in judging.proven(replies).collect()}
    assert got[1].defect is None and got[2].defect == "not_verbatim" and got[3].error == "no answer" and got[3].defect == "unparsable"
    assert judging.coverage(judging.proven(replies).withColumn("k", F.lit(1)), ["k"]).first().coverage == 0.3333
    assert judging.ask(c, None).where("reply is not null").count() == 0
    p = spark.createDataFrame([(1, "---\na: b\n---\nintro\n1. first\n   goes on\nstray\n  two blanks\n\tand on\n2) not a step\n   1) nested\n\n   not this\n12. second \n\n3. third")], "id int, text string")
    assert [r.text for r in judging.playbook_steps(p).orderBy("step").collect()] == ["1. first goes on and on 1) nested", "12. second", "3. third"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("s", k, "assistant" if k % 4 else "user", k % 3 == 0, f"2026-01-01 00:{k:02d}:00", k, 1) for k in range(12)]
    schema = "session string, seq long, kind string, positive boolean, at timestamp, input long, output long"
    df = spark.createDataFrame(rows, "session string, seq long, kind string, positive boolean, at string, input long, output long").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.json(str(src))

    def run(out, name, mode):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        return spark.table(name).collect()

    stream = lambda: spark.readStream.schema(schema).json(str(src))
    windows = run(streams.usage_windows(stream()), "w", "complete")
    assert sorted((r.records, r.input) for r in windows) == [(2, 21), (10, 45)]
    assert run(streams.turns(stream(), "5 minutes"), "t", "complete")[0].records == 12
