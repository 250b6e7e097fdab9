"""Transcripts as streams: usage by session and time window; spans and the load ledger with state that ends; late records counted."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Records that wait, and what is open, as JSON; time of the last record taken, in milliseconds.
_STATE = "held string, carried string, last long"
_LEDGER = "session string, skill string, load_kind string, opened_seq long, body_seq long"
_SPAN = "session string, first_seq long, last_seq long, n_records long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line and arrival of files that come into a folder."""
    return spark.readStream.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"), F.current_timestamp().alias("arrival"))


def usage_windows(records: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """session, window, input, output tokens and records of a stream (session, at timestamp, input, output). Records that come
    later than ``lateness`` are left out by the watermark; the state of closed windows goes."""
    w = records.withWatermark("at", lateness).groupBy("session", F.window("at", window).alias("window"))
    return w.agg(F.count("*").alias("records"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def turns(records: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """session, start, end and records: activity without a gap."""
    w = F.session_window("at", gap)
    g = records.withWatermark("at", lateness).groupBy("session", w.alias("w")).agg(F.count("*").alias("records"))
    return g.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def late_records(query: StreamingQuery) -> int:
    """Records that came after the watermark, by the progress reports that the query still holds: they change nothing, but are counted."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def _in_order(step: Callable, close: Callable, columns: list[str], idle_ms: int) -> Callable:
    """A state function over records that come in any order: they wait until the watermark has passed them, and are then taken by seq.

    step(state, row) and close(state) give the next state, which is None where nothing is open, and rows. A session that is idle for
    ``idle_ms`` after its last record is closed, and nothing is kept of it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, carried, last = (json.loads(state.get[0]), json.loads(state.get[1]), state.get[2]) if state.exists else ([], None, 0)
        if not state.hasTimedOut:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    held.append([int(row.seq), int(row.at.timestamp() * 1000), *[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row[3:]]])
        held.sort(key=lambda r: r[0])
        mark, out = state.getCurrentWatermarkMs(), []
        while held and held[0][1] <= mark:
            row = held.pop(0)
            last = max(last, row[1])
            carried, rows = step(carried, row[0], *row[2:])
            out += rows
        if not held and carried is not None and mark >= last + idle_ms:
            out += close(carried)
            carried = None
        if held or carried is not None:
            state.update((json.dumps(held), json.dumps(carried), last))
            state.setTimeoutTimestamp(max(mark + 1, held[0][1] if held else last + idle_ms))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *r) for r in out], columns=columns)

    return run


def _stateful(records: DataFrame, fields: list[str], step: Callable, close: Callable, schema: str, lateness: str, idle: str) -> DataFrame:
    kept = records.select("session", "seq", "at", *fields).withWatermark("at", lateness)
    names = [c.split()[0] for c in schema.split(", ")]
    run = _in_order(step, close, names, int(pd.Timedelta(idle).total_seconds() * 1000))
    return kept.groupBy("session").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _span_step(open_: list | None, seq: int, kind: str, positive: bool) -> tuple[list | None, list[tuple]]:
    """A user record or one with usage ends a span, as in the batch operator; an open span is the state."""
    if kind == "user":
        return None, []
    if kind != "assistant":
        return open_, []
    first, n = open_ or (seq, 0)
    return (None, [(first, seq, n + 1)]) if positive else ([first, n + 1], [])


def span_stream(records: DataFrame, lateness: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Spans of a stream of records (session, seq, at, kind, positive), as islands.spans gives them of a table. Records may come in any
    order within ``lateness``; what is open when a session has been idle is left, as a table would leave it."""
    return _stateful(records, ["kind", "positive"], _span_step, lambda open_: [], _SPAN, lateness, idle)


def _ledger_step(skills: dict | None, seq: int, kind: str, skill: str | None) -> tuple[dict | None, list[tuple]]:
    """Of each skill: stub (its open one), base (whether there was a body, and whether a boundary came since), waiting (bodies after a base
    that is still there: loads once a boundary comes, else redundant)."""
    skills = skills or {}
    if kind == "boundary":
        out = [(k, "reload", s, s) for k, of in skills.items() for s in of["waiting"]]
        for of in skills.values():
            of["gone"], of["waiting"] = of["body"], []
        return skills or None, out
    of = skills.setdefault(skill, {"stub": None, "body": False, "gone": False, "waiting": []})
    stub, out = of["stub"], []
    if kind == "stub":
        of["stub"] = seq
        return skills, [(skill, "unavailable", stub, None)] if stub is not None else []
    if kind == "body":
        if stub is not None or not of["body"]:
            out = [(skill, "load", seq if stub is None else stub, seq)]
        elif of["gone"]:
            out = [(skill, "reload", seq, seq)]
        else:
            of["waiting"].append(seq)
            return skills, []
        of["stub"], of["body"], of["gone"] = None, True, False
    return skills, out


def _ledger_close(skills: dict) -> list[tuple]:
    return [(k, "unavailable", of["stub"], None) for k, of in skills.items() if of["stub"] is not None]


def ledger_stream(records: DataFrame, lateness: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """The load ledger of a stream of records (session, seq, at, kind: stub, body or boundary, skill), as loads.load_ledger gives it of a
    table, without numbers. A stub waits for its body, and a second body for the boundary that makes it a reload, until the session has
    been idle."""
    return _stateful(records, ["kind", "skill"], _ledger_step, _ledger_close, _LEDGER, lateness, idle)
