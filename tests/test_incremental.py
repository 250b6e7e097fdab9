"""Audits of changed logs alone: what is read, and that the result is that of a full run."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_transcripts import RICH, anchor, answer, said, write
from tracelake.model import fleet, incremental
from tracelake.sources import transcripts as tr


def keep(df):
    return df.checkpoint()


def counted(events, keep):
    return keep(events.groupBy("session").agg(F.count("*").alias("events"), F.count_distinct("origin").alias("agents"), F.max("text").alias("last")))


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "logs"
    for k in range(5):
        write(root / f"w{k % 2}" / f"s{k}.jsonl", [said("user", f"hello {k}", 1), answer([{"type": "text", "text": f"answer {k}"}], 2, 9, **anchor(k))])
    write(root / "w0" / "s0" / "subagents" / "kid.jsonl", [said("user", "find", 1)])
    write(root / "w1" / "subagents" / "shared.jsonl", [said("user", "of all in w1", 1)])
    return root


@pytest.fixture
def reads(monkeypatch):
    seen = []
    load = tr.load
    monkeypatch.setattr(tr, "load", lambda spark, paths, recursive=False: seen.append(sorted(os.path.relpath(p, p.split("/logs/")[0] + "/logs") for p in paths)) or load(spark, paths, recursive))
    return seen


def full(spark, root, counting=counted):
    events = tr.with_shared_children(tr.load(spark, [str(root)], recursive=True))
    return {r.session: (r.events, r.agents, r.last) for r in counting(events, keep).collect() if r.session != "w1"}


def test_only_what_changed_is_read(spark, logs, reads, tmp_path):
    store = str(tmp_path / "store")
    go = lambda **p: {r.session: (r.events, r.agents, r.last) for r in incremental.refresh(spark, [str(logs)], store, keep, p, counted).collect()}

    def read(compare=False, **p):
        reads.clear()
        got = go(**p)
        files = reads[0] if reads else []
        reads.clear()
        assert not compare or got == full(spark, logs)
        return files

    assert len(read(True)) == 7
    assert read() == []  # nothing new
    with open(logs / "w0" / "s2.jsonl", "a") as f:
        f.write('{"type": "user", "message": {"content": "more"}}\n')
    assert read(True) == ["w0/s2.jsonl"]
    write(logs / "w0" / "s4" / "subagents" / "new.jsonl", [said("user", "find more", 1)])
    assert read() == ["w0/s4.jsonl", "w0/s4/subagents/new.jsonl"]
    write(logs / "w1" / "subagents" / "shared.jsonl", [said("user", "another text, of other length", 1)])
    assert read(True) == ["w1/s1.jsonl", "w1/s3.jsonl", "w1/subagents/shared.jsonl"]  # a folder that two sessions share
    os.remove(logs / "w0" / "s2.jsonl")
    assert read() == []
    write(logs / "w0" / "s9.jsonl", [said("user", "late", 1)])
    assert read(True) == ["w0/s9.jsonl"]
    assert len(read(True, catalog="other")) == 8 and read() == []  # parameters have figures of their own


def test_runs_that_break_off_and_runs_that_overlap(spark, logs, reads, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    go = lambda: {r.session: r.events for r in incremental.refresh(spark, [str(logs)], store, keep, None, counted).collect()}
    first = go()
    with open(logs / "w0" / "s2.jsonl", "a") as f:
        f.write('{"type": "user", "message": {"content": "more"}}\n')
    # figures were written, the manifest wasn't
    shutil.copytree(f"{store}/manifest", f"{tmp_path}/before")
    second = go()
    assert second["s2"] == first["s2"] + 1
    shutil.rmtree(f"{store}/manifest")
    shutil.copytree(f"{tmp_path}/before", f"{store}/manifest")
    reads.clear()
    assert go() == second and reads[0] == ["w0/s2.jsonl"]
    # the same lines twice
    manifest = spark.read.parquet(f"{store}/manifest").checkpoint()
    manifest.write.mode("append").parquet(f"{store}/manifest")
    assert go() == second


def test_more_files_than_are_read_by_name(spark, logs, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MANY_FILES", 2)
    got = incremental.refresh(spark, [str(logs)], str(tmp_path / "store"), keep, None, counted)
    assert {r.session: (r.events, r.agents, r.last) for r in got.collect()} == full(spark, logs)


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    assert incremental.refresh(spark, [str(tmp_path / "logs")], str(tmp_path / "store"), keep, None, counted).count() == 0


def test_figures_are_those_of_a_full_run(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "w" / "a.jsonl", RICH)
    roots, store = [str(root)], str(tmp_path / "store")
    incremental.refresh(spark, roots, store, keep)
    write(root / "w" / "b.jsonl", RICH[:8])
    got, want = incremental.refresh(spark, roots, store, keep), fleet.sessions(spark, roots, keep)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(str(r.asDict()) for r in df.select(sorted(want.columns)).collect())
    assert plain(got) == plain(want)
