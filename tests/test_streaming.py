"""Streams with state against the batch operators: records in any order over many micro-batches, late ones, sessions that end."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_transcripts import rows
from tracelake.operators import islands, loads
from tracelake.streaming import sessions as streams

START = datetime.datetime(2026, 1, 1)
SCHEMA = "session string, seq long, at timestamp, kind string, positive boolean, skill string"


def record(session, seq, kind, positive=False, skill=None, minute=None):
    return {"session": session, "seq": seq, "at": (START + datetime.timedelta(minutes=seq if minute is None else minute)).isoformat() + "Z", "kind": kind, "positive": positive, "skill": skill}


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over files of records, one file a micro-batch; a last file moves the watermark on for a day and more, twice."""

    def run(make, batches):
        src = tmp_path / "in"
        src.mkdir()
        ends = [[record("end", k, "user", minute=100_000 * k)] for k in (1, 2, 3)]
        for n, rs in enumerate([*batches, *ends]):
            (src / f"{n:03d}.json").write_text("".join(json.dumps(r) + "\n" for r in rs))
            import os

            os.utime(src / f"{n:03d}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        q = make(stream).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(280)
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        return spark.table("found").where("session <> 'end'"), state, streams.late_records(q)

    return run


def shuffled(records, rng, size, within):
    """Micro-batches in which records are up to ``within`` places out of order."""
    order = sorted(range(len(records)), key=lambda i: i + rng.random() * within)
    mixed = [records[i] for i in order]
    return [mixed[k : k + size] for k in range(0, len(mixed), size)]


def test_spans_in_any_order(spark, streamed):
    rng = random.Random(3)
    log = [record(f"s{n % 4}", n, rng.choice(["user", "assistant", "assistant", "meta"]), rng.random() < 0.4) for n in range(240)]
    got, state, late = streamed(lambda s: streams.span_stream(s, "1 hour", "2 hours"), shuffled(log, rng, 40, 30))
    table = spark.createDataFrame([(r["session"], r["seq"], r["kind"], r["positive"]) for r in log if r["kind"] != "meta"], "session string, seq long, kind string, positive boolean")
    cols = ["session", "first_seq", "last_seq", "n_records"]
    assert rows(got, *cols) == rows(islands.spans(table, ["session"]), *cols)
    assert state <= 1 and late == 0  # but for the session that ends the stream


def test_ledger_in_any_order_with_a_late_record(spark, streamed):
    rng = random.Random(5)
    log = [record(f"s{n % 3}", n, rng.choice(["stub", "body", "body", "boundary"]), skill=rng.choice("ab")) for n in range(200)]
    batches = shuffled(log, rng, 40, 30)
    batches[-1].append(record("s0", 1000, "body", skill="late", minute=1))
    got, state, late = streamed(lambda s: streams.ledger_stream(s, "1 hour", "2 hours"), batches)
    entries = []
    for r in log:
        if r["kind"] != "boundary":
            gone = [b["seq"] for b in log if b["session"] == r["session"] and b["kind"] == "boundary" and b["seq"] > r["seq"]]
            entries.append((r["session"], r["seq"], r["skill"], r["kind"], min(gone, default=None)))
    table = spark.createDataFrame(entries, "session string, seq long, skill string, kind string, gone_seq long")
    cols = ["session", "skill", "load_kind", "opened_seq", "body_seq"]
    assert rows(got, *cols) == rows(loads.load_ledger(table, ["session"], "skill"), *cols)
    assert state <= 1 and late == 1
    assert {r.load_kind for r in got.select("load_kind").distinct().collect()} == {"load", "reload", "unavailable"}
