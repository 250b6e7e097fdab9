"""Transcripts: JSONL files of several formats as one table of events.

An event is a row of (source, seq, part): what one line of a file says, in order. Unknown stays null. Lines of the rich format
that can't be used become RecordDropped events with a reason, so that they are counted; other formats skip them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.graph import cut

#: Splits of large files whose line counts are broadcast: some 20 MB.
MANY_SPLITS = 200_000
#: Fields of an event beside its place; an event has the fields that its type gives it, the others are null.
USAGE = "struct<input_other:long,output:long,cache_read:long,cache_creation:long,cache_5m:long,cache_1h:long,ratio:double,request_id:string,credits:double,billable:boolean>"
COMPACT = "struct<trigger:string,pre_tokens:long,post_tokens:long,messages_summarized:long,duration_ms:long>"
FIELDS = {
    "text": "string", "part_type": "string", "tool_id": "string", "tool_name": "string", "tool_args": "string", "output": "string", "is_error": "boolean",
    "context_tokens": "long", "context_usage": "double", "turn_id": "long", "turn_tokens": "long", "model": "string", "context_window": "long",
    "system_prompt_hash": "string", "tools_hash": "string", "leaf_uuid": "string", "attachment_type": "string", "entries": "array<struct<name:string,text:string>>",
    "reason": "string", "usage": USAGE, "compact": COMPACT,
}
REF = "struct<uuid:string,parent_uuid:string,is_sidechain:boolean,parent_tool_id:string,request_id:string,request_hash:string,response_hash:string,is_summary:boolean,human_text:string>"
EVENTS = "source string, seq long, part int, ts double, type string, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items()) + f", ref {REF}"

# Attachments that hold entries (type: list, text, name), the key of others' text and name, and keys whose strings
# are no text.
ENTRIES = {"invoked_skills": ("skills", "content", "name"), "post_compact_restored_files": ("files", "content", "filePath"), "relevant_memories": ("files", "content", "filePath")}
TEXT_KEYS = {"skill_listing": "content", "critical_system_reminder": "content", "task_reminder": "content", "auto_mode": "reminderType", "queued_command": "prompt", "hook_output": "output"}
NAME_KEYS = {"auto_mode": "reminderType", "edited_text_file": "filename", "file": "filename", "directory": "path", "hook_non_blocking_error": "hookName"}
RESULT_SKIPS, ATTACHMENT_SKIPS, ENTRY_SKIPS = ("type", "is_error", "data", "media_type"), ("type", "filePath", "path", "name"), ("type", "path", "name")


# Types of records that tell a format.
ROLLOUT_TYPES = ("session_meta", "response_item", "event_msg", "token_usage_record", "world_state", "turn_context")
RICH_TYPES = ("user", "assistant", "metadata")


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """source, seq (from 1), line, format (what the first line that tells one tells, else null), v (variant; null if the line is no JSON
    object), is_json. recursive: the paths are folders, and all .jsonl files below them are read.

    Nothing is shuffled: a task reads a split from its beginning, so it numbers the lines as they come. Only of files that are read in
    several splits are the lines of each split counted first, by a scan of those files alone, and running sums added. They travel as a
    broadcast up to MANY_SPLITS of them, a row for each; beyond that Spark joins them as it sees fit."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl") if recursive else spark.read
    at = {n: F.col(f"_metadata.{n}") for n in ("file_path", "file_block_start", "file_block_length", "file_size")}
    text = reader.text(paths)
    raw = text.select("value", at["file_path"].alias("source"), at["file_block_start"].alias("start"))
    numbered = raw.mapInArrow(_numbered, "source string, start long, seq long, line string, format string")
    # no split is smaller than a file's opening cost, so smaller files are left out of the scan by name
    parted = text.where((at["file_size"] > _open_cost(spark)) & (at["file_block_length"] < at["file_size"])).select("value", at["file_path"].alias("source"), at["file_block_start"].alias("start"))
    before = Window.partitionBy("source").orderBy("start")
    splits = parted.mapInArrow(_counted, "source string, start long, n long, format string")
    splits = splits.select("source", "start", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.first("format", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_said"))
    splits = cut(splits)
    n = splits.count()
    if n:
        joined = numbered.join(F.broadcast(splits) if n <= MANY_SPLITS else splits, ["source", "start"], "left")
        numbered = joined.withColumns({"seq": F.col("seq") + F.coalesce("_before", F.lit(0)), "format": F.when(F.col("_before").isNull(), F.col("format")).otherwise(F.col("_said"))})
    return parse_lines(numbered.select("source", "seq", "line", "format"))


def _open_cost(spark: SparkSession) -> int:
    """spark.sql.files.openCostInBytes as a number."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", spark.conf.get("spark.sql.files.openCostInBytes").lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Lines in pieces of one split each, with its file and start. A partition holds splits one after another."""
    for batch in batches:
        source, start = batch.column("source").dictionary_encode(), batch.column("start").to_numpy()
        code = source.indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            yield (source.dictionary[int(code[a])].as_py(), int(start[a])), batch.column("value").slice(a, b - a)


def _first_said(lines: pa.Array) -> str | None:
    """What the first line that tells a format tells, by the rules of format_said()."""
    for line in lines:
        try:
            v = json.loads(line.as_py(), parse_constant=_no_constant)
        except (ValueError, RecursionError):
            continue
        if isinstance(v, dict) and (said := _said(v)):
            return said
    return None


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _said(v: dict) -> str | None:
    kind = v.get("type") if isinstance(v.get("type"), str) else None
    if kind == "progress" or kind == "session_meta" and isinstance(v.get("data"), dict):
        return "degraded"
    if kind in ROLLOUT_TYPES:
        return "rollout"
    if kind in RICH_TYPES:
        return "rich" if "origin" in v or "parentUuid" in v else None
    return "wire" if isinstance(v.get("message"), dict) or kind is not None and "." in kind else None


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number within the split and the split's format. Lines wait until a line tells it, or the split ends."""
    now, seq, said, waiting = None, 0, None, []

    def out(lines: pa.Array, first: int) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.repeat(now[0], n), pa.repeat(now[1], n), pa.array(np.arange(first, first + n)), lines, pa.repeat(pa.scalar(said, pa.string()), n)], names=["source", "start", "seq", "line", "format"])

    for key, lines in _runs(batches):
        if key != now:
            yield from (out(*w) for w in waiting)
            now, seq, said, waiting = key, 0, None, []
        said = said or _first_said(lines)
        waiting.append((lines, seq + 1))
        seq += len(lines)
        if said:
            yield from (out(*w) for w in waiting)
            waiting = []
    yield from (out(*w) for w in waiting)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its lines and its format."""
    found: dict[tuple[str, int], list] = {}
    for key, lines in _runs(batches):
        of = found.setdefault(key, [0, None])
        of[0] += len(lines)
        of[1] = of[1] or _first_said(lines)
    rows = [(*key, n, said) for key, (n, said) in found.items()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["source", "start", "n", "format"])


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds v and is_json to (source, seq, line). Of repeated keys the last counts. That is a setting of the session, and it stays:
    plans are lazy, and it decides nothing but JSON objects that repeat a key, which would be errors otherwise."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    v = F.try_parse_json("line")
    return lines.withColumn("is_json", v.isNotNull()).withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def first_decisive(rows: DataFrame, key: str, order: str, verdict: str) -> DataFrame:
    """key and the first verdict in order that is not null; null if there is none."""
    first = F.min_by(verdict, F.when(F.col(verdict).isNotNull(), F.col(order)))
    return rows.groupBy(key).agg(first.alias(verdict))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, kind: str) -> Column:
    """Whether the value at path is of that kind (OBJECT, ARRAY, STRING, ...)."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind), F.lit(False))


def _string(v: Column, path: str) -> Column:
    """The value if it is a string; other kinds are not turned into one."""
    return F.when(_is(v, path, "STRING"), get(v, path))


def format_said(v: Column) -> Column:
    """The format that a line tells, null if it tells none."""
    kind = _string(v, "$.type")
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    return (
        F.when(((kind == "session_meta") & _is(v, "$.data", "OBJECT")) | (kind == "progress"), "degraded")
        .when(kind.isin(*ROLLOUT_TYPES), "rollout")
        .when(kind.isin(*RICH_TYPES), F.when(has("$.origin") | has("$.parentUuid"), "rich"))
        .when(_is(v, "$.message", "OBJECT") | F.contains(kind, F.lit(".")), "wire")
    )


def detect_format(lines: DataFrame) -> DataFrame:
    """source, format: rich, degraded, rollout, wire or null. The first line that decides does."""
    return first_decisive(lines.withColumn("format", format_said(F.col("v"))), "source", "seq", "format")


_blank: dict = {}


def _nulls() -> dict[str, Column]:
    """A null column for each of FIELDS. They are made once for the gateway to Spark: events name hundreds of them, and each costs calls."""
    gateway = SparkContext._gateway
    if _blank.get("gateway") is not gateway or "columns" not in _blank:
        _blank.update(gateway=gateway, columns={n: F.lit(None).cast(t).alias(n) for n, t in FIELDS.items()})
    return _blank["columns"]


def _event(kind: Column | str, **fields: Column) -> Column:
    named = [F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type")]
    blank = _nulls()
    return F.struct(*named, *[fields[n].cast(t).alias(n) if n in fields else blank[n] for n, t in FIELDS.items()])


def _iso(s: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(s)) / 1e6


def _seconds(v: Column, path: str) -> Column:
    """ISO strings, or milliseconds as a number."""
    number = _is(v, path, "BIGINT") | _is(v, path, "DECIMAL") | _is(v, path, "DOUBLE")
    return F.when(number, get(v, path, "double") / 1000).when(_is(v, path, "STRING"), _iso(get(v, path)))


def _flat(value: object, skip: tuple[str, ...]) -> str:
    """All strings inside, in the order of the text, joined by newlines."""
    if isinstance(value, str):
        return value
    inner = value if isinstance(value, list) else [x for k, x in value.items() if k not in skip] if isinstance(value, dict) else []
    return "\n".join(t for t in (_flat(x, skip) for x in inner) if t)


def _texts(line: str) -> dict:
    """What the order of keys decides, which variants don't keep: arguments as JSON text, and flattened results and attachments."""
    r = json.loads(line)
    message = r.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    parts = [{"args": None, "flat": None} if not isinstance(p, dict) else
             {"args": json.dumps(p.get("input") or {}, ensure_ascii=False) if p.get("type") == "tool_use" else None,
              "flat": _flat(p.get("content", ""), RESULT_SKIPS) if p.get("type") == "tool_result" else None} for p in content] if isinstance(content, list) else None
    a = r.get("attachment")
    if not isinstance(a, dict):
        return {"parts": parts, "whole": None, "name": None, "entries": None}
    kind = a.get("type") or "unknown"
    text, name = a.get(TEXT_KEYS.get(kind, "")), a.get(NAME_KEYS.get(kind, ""))
    entries = None
    if kind in ENTRIES:
        key, t, n = ENTRIES[kind]
        listed = a.get(key)
        entries = [{"name": e.get(n) if isinstance(e.get(n), str) and e.get(n) else None, "text": e[t] if isinstance(e.get(t), str) else _flat(e, ENTRY_SKIPS)}
                   for e in (listed if isinstance(listed, list) else []) if isinstance(e, dict)]
    return {"parts": parts, "whole": text if isinstance(text, str) else _flat(a, ATTACHMENT_SKIPS), "name": name if isinstance(name, str) and name else None, "entries": entries}


_TEXTS = "struct<parts:array<struct<args:string,flat:string>>,whole:string,name:string,entries:array<struct<name:string,text:string>>>"


def _ordered_texts(line: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_texts(x) if x is not None else {"parts": None, "whole": None, "name": None, "entries": None} for x in line], columns=["parts", "whole", "name", "entries"])


def _ref(v: Column) -> Column:
    # an explicit null under the first name stays null: the second name is for its absence alone
    camel = F.try_variant_get(v, "$.parentToolUseId", "variant")
    return F.struct(
        get(v, "$.uuid").alias("uuid"),
        get(v, "$.parentUuid").alias("parent_uuid"),
        get(v, "$.isSidechain", "boolean").alias("is_sidechain"),
        F.when(camel.isNotNull(), get(v, "$.parentToolUseId")).otherwise(get(v, "$.parent_tool_use_id")).alias("parent_tool_id"),
        F.coalesce(get(v, "$.requestTokenAnchor.requestId"), get(v, "$.message.usage.request_id")).alias("request_id"),
        get(v, "$.requestTokenAnchor.request").alias("request_hash"),
        get(v, "$.requestTokenAnchor.response").alias("response_hash"),
        F.coalesce(get(v, "$.isCompactSummary", "boolean"), F.lit(False)).alias("is_summary"),
        _string(v, "$.humanInput.text").alias("human_text"),
    )


def _usage(u: Column, request: bool = True) -> Column:
    n = lambda p: F.coalesce(get(u, p, "long"), F.lit(0))
    return F.struct(
        n("$.input_tokens").alias("input_other"), n("$.output_tokens").alias("output"), n("$.cache_read_input_tokens").alias("cache_read"),
        n("$.cache_creation_input_tokens").alias("cache_creation"), n("$.cache_creation.ephemeral_5m_input_tokens").alias("cache_5m"),
        n("$.cache_creation.ephemeral_1h_input_tokens").alias("cache_1h"), get(u, "$.context_usage_ratio", "double").alias("ratio"),
        get(u, "$.request_id").alias("request_id"), get(u, "$.credits", "double").alias("credits"), get(u, "$.billable", "boolean").alias("billable"),
    )


def _spread(lines: DataFrame, *more: str) -> DataFrame:
    """A row for each event of a line (columns events, ts and ref), in order; nulls among them are left out."""
    kept = F.filter("events", lambda e: e.isNotNull())
    rows = lines.select("source", "seq", *more, "ts", "ref", F.posexplode(kept).alias("part", "e"))
    return rows.select("source", "seq", "part", "ts", "e.*", F.col("ref").cast(REF).alias("ref"), *more)


def _with_texts(lines: DataFrame, mine: Column) -> DataFrame:
    """Adds _t, what the order of keys decides. Python sees only lines that hold tool calls, results or an attachment."""
    v = F.col("v")
    parts = F.try_variant_get(v, "$.message.content", "array<variant>")
    tools = F.coalesce(F.exists(parts, lambda p: _string(p, "$.type").isin("tool_use", "tool_result")), F.lit(False))
    needed = mine & (tools | _is(v, "$.attachment", "OBJECT"))
    return lines.withColumn("_t", F.pandas_udf(_ordered_texts, _TEXTS)(F.when(needed, F.col("line"))))


def rich_events(lines: DataFrame) -> DataFrame:
    """The rich format, with envelopes, attachments and measured compactions; also reads the degraded one, which lacks them."""
    events, ts, ref = _rich()
    return _spread(_with_texts(lines, F.lit(True)).withColumns({"events": events, "ts": ts, "ref": ref}))


def _rich() -> tuple[Column, Column, Column]:
    """Events, time and envelope of a line (columns v, is_json, _t)."""
    v, t, kind = F.col("v"), F.col("_t"), _string(F.col("v"), "$.type")
    said = kind.isin("user", "assistant")
    single = F.array(_event("TurnBegin", text=get(v, "$.message.content")))
    spoken = F.array(_event("ContentPart", part_type=F.lit("text"), text=get(v, "$.message.content")))
    parts = F.try_variant_get(v, "$.message.content", "array<variant>")
    is_text = lambda p: (_string(p, "$.type") == "text") & _is(p, "$.text", "STRING")
    texts = F.filter(parts, lambda p: _string(p, "$.type") == "text")
    turn = F.when(F.size(texts) > 0, _event("TurnBegin", text=F.array_join(F.transform(F.filter(parts, is_text), lambda p: get(p, "$.text")), "\n")))

    def result(p: Column, i: Column) -> Column:
        flat = F.get(t["parts"], i)["flat"]
        bad = F.coalesce(get(p, "$.is_error", "boolean"), F.lit(False))
        return F.when(_string(p, "$.type") == "tool_result", _event("ToolResult", tool_id=get(p, "$.tool_use_id"), output=flat, is_error=bad))

    def spoke(p: Column, i: Column) -> Column:
        k = _string(p, "$.type")
        return (
            F.when(k == "text", _event("ContentPart", part_type=F.lit("text"), text=F.coalesce(_string(p, "$.text"), F.lit(""))))
            .when(k == "thinking", _event("ContentPart", part_type=F.lit("think"), text=F.coalesce(_string(p, "$.thinking"), F.lit(""))))
            .when(k == "tool_use", _event("ToolCall", tool_id=get(p, "$.id"), tool_name=get(p, "$.name"), tool_args=F.get(t["parts"], i)["args"]))
        )

    whole = _is(v, "$.message.content", "STRING")
    user = F.when(whole, single).otherwise(F.concat(F.array(turn), F.transform(parts, result)))
    model = F.coalesce(get(v, "$.message.model"), get(v, "$.model"), F.lit(""))
    used = F.when(_is(v, "$.message.usage", "OBJECT"), _event("UsageRecord", usage=_usage(F.try_variant_get(v, "$.message.usage", "variant")), model=model))
    assistant = F.concat(F.when(whole, spoken).otherwise(F.transform(parts, spoke)), F.array(used))
    m = lambda p, k="long": get(v, f"$.compactMetadata.{p}", k)
    compact = F.struct(m("trigger", "string").alias("trigger"), m("preTokens").alias("pre_tokens"), m("postTokens").alias("post_tokens"), m("messagesSummarized").alias("messages_summarized"), m("durationMs").alias("duration_ms"))
    attached = F.when(_is(v, "$.attachment", "OBJECT"), _event("Attachment", attachment_type=F.coalesce(F.nullif(get(v, "$.attachment.type"), F.lit("")), F.lit("unknown")), text=t["whole"], tool_name=t["name"], entries=t["entries"]))
    dropped = lambda why: _event("RecordDropped", reason=why)
    meta = (
        F.when(kind == "system", F.when(get(v, "$.subtype") == "compact_boundary", _event("CompactionBegin", compact=compact)).otherwise(_event("SystemNotice", part_type=get(v, "$.subtype"), text=_string(v, "$.content"))))
        .when(kind == "runtime-config", _event("RuntimeConfig", model=get(v, "$.model"), context_window=get(v, "$.contextWindow", "long")))
        .when(kind == "active-leaf", _event("ActiveLeaf", leaf_uuid=get(v, "$.leafUuid")))
        .when(kind == "attachment", attached)
    )
    events = (
        F.when(~F.col("is_json"), F.array(dropped(F.lit("malformed_json"))))
        .when(v.isNull(), F.array(dropped(F.lit("non_dict"))))
        .when(~F.coalesce(said, F.lit(False)), F.array(F.coalesce(meta, dropped(F.concat(F.lit("record:"), F.coalesce(get(v, "$.type"), F.lit("None")))))))
        .when(~_is(v, "$.message", "OBJECT"), F.array(dropped(F.lit("message_invalid"))))
        .when(~whole & ~_is(v, "$.message.content", "ARRAY"), F.array(dropped(F.lit("content_invalid"))))
        .when(kind == "user", user)
        .otherwise(assistant)
    )
    return events, _seconds(v, "$.timestamp"), F.when(v.isNotNull(), _ref(v))


def rollout_events(lines: DataFrame) -> DataFrame:
    """The rollout format: response items and usage records. Cached input is part of the input there, and is taken off."""
    events, ts = _rollout()
    return _spread(lines.where("v is not null").withColumns({"events": events, "ts": ts, "ref": F.lit(None).cast(REF)}))


def _rollout() -> tuple[Column, Column]:
    v, kind = F.col("v"), _string(F.col("v"), "$.type")
    p, role = _string(v, "$.payload.type"), _string(v, "$.payload.role")
    content = F.try_variant_get(v, "$.payload.content", "array<variant>")
    of = lambda k: F.transform(F.filter(content, lambda c: _string(c, "$.type") == k), lambda c: F.coalesce(get(c, "$.text"), F.lit("")))
    turn = F.when(F.size(of("input_text")) > 0, _event("TurnBegin", text=F.array_join(of("input_text"), "\n")))
    thought = F.filter(F.try_variant_get(v, "$.payload.summary", "array<variant>"), lambda c: _string(c, "$.type") == "summary_text")
    n = lambda f: F.coalesce(get(v, f"$.payload.usage.{f}", "long"), F.lit(0))
    cached = n("cached_input_tokens")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    usage = F.struct(
        (n("input_tokens") - cached).alias("input_other"), n("output_tokens").alias("output"), cached.alias("cache_read"), n("cache_write_input_tokens").alias("cache_creation"),
        zero.alias("cache_5m"), zero.alias("cache_1h"), none.cast("double").alias("ratio"), none.cast("string").alias("request_id"), none.cast("double").alias("credits"), none.cast("boolean").alias("billable"),
    )
    item = (
        F.when((p == "message") & (role == "user"), F.array(turn))
        .when((p == "message") & (role == "assistant"), F.transform(of("output_text"), lambda x: _event("ContentPart", part_type=F.lit("text"), text=x)))
        .when(p == "reasoning", F.transform(F.slice(thought, 1, 1), lambda c: _event("ContentPart", part_type=F.lit("think"), text=F.coalesce(get(c, "$.text"), F.lit("")))))
        .when(p == "function_call", F.array(_event("ToolCall", tool_id=get(v, "$.payload.call_id"), tool_name=get(v, "$.payload.name"), tool_args=F.coalesce(get(v, "$.payload.arguments"), F.lit("{}")))))
        .when(p == "function_call_output", F.array(_event("ToolResult", tool_id=get(v, "$.payload.call_id"), output=F.coalesce(get(v, "$.payload.output"), F.lit("")), is_error=F.lit(False))))
    )
    events = F.when(kind == "response_item", item).when(kind == "token_usage_record", F.array(_event("UsageRecord", usage=usage, model=F.lit(""))))
    return events, _iso(_string(v, "$.timestamp"))


def wire_events(lines: DataFrame) -> DataFrame:
    """The wire formats: typed messages of a terminal, and dotted records of a desktop application."""
    events, ts = _wire()
    return _spread(lines.where("v is not null").withColumns({"events": events, "ts": ts, "ref": F.lit(None).cast(REF)}))


def _wire() -> tuple[Column, Column]:
    v, kind = F.col("v"), _string(F.col("v"), "$.type")
    e = _string(v, "$.event.type")
    none, zero = F.lit(None), F.lit(0).cast("long")
    joined = lambda path: F.array_join(F.transform(F.filter(F.try_variant_get(v, path, "array<variant>"), lambda c: _string(c, "$.type") == "text"), lambda c: _string(c, "$.text")), "\n")

    def usage(root: str, other: str, read: str, creation: str, output: str) -> Column:
        n = lambda f: F.coalesce(get(v, f"{root}.{f}", "long"), zero)
        return F.struct(n(other).alias("input_other"), n(output).alias("output"), n(read).alias("cache_read"), n(creation).alias("cache_creation"), zero.alias("cache_5m"), zero.alias("cache_1h"),
                        none.cast("double").alias("ratio"), none.cast("string").alias("request_id"), none.cast("double").alias("credits"), none.cast("boolean").alias("billable"))

    def part(root: str) -> Column:
        k = _string(v, f"{root}.type")
        return _event("ContentPart", part_type=k, text=F.when(k == "think", get(v, f"{root}.think")).otherwise(get(v, f"{root}.text")))

    loop = (
        F.when(e == "step.begin", _event("StepBegin", turn_id=get(v, "$.event.step", "long")))
        .when(e == "content.part", part("$.event.part"))
        .when(e == "tool.call", _event("ToolCall", tool_id=get(v, "$.event.toolCallId"), tool_name=get(v, "$.event.name"), tool_args=F.coalesce(get(v, "$.event.args"), F.lit("{}"))))
        .when(e == "tool.result", _event("ToolResult", tool_id=get(v, "$.event.toolCallId"), output=get(v, "$.event.result.output"), is_error=F.coalesce(get(v, "$.event.result.is_error", "boolean"), F.lit(False))))
    )
    desktop = (
        F.when(kind == "turn.prompt", F.when(F.coalesce(get(v, "$.origin.kind"), F.lit("user")) == "user", _event("TurnBegin", text=joined("$.input"))))
        .when(kind == "context.append_loop_event", loop)
        .when(kind == "token_counting.measured", _event("StatusUpdate", context_tokens=get(v, "$.tokens", "long")))
        .when((kind == "token_counting.turn_recorded") & (F.coalesce(get(v, "$.agentId"), F.lit("main")) == "main"),
              _event("TurnTokens", turn_id=F.coalesce(get(v, "$.turnId", "long"), zero), turn_tokens=F.coalesce(get(v, "$.tokens", "long"), zero)))
        .when(kind == "usage.record", _event("UsageRecord", usage=usage("$.usage", "input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens"), model=F.coalesce(get(v, "$.model"), F.lit(""))))
        .when(kind == "subagent.spawned", _event("SubagentSpawned", tool_id=get(v, "$.agentId"), turn_id=get(v, "$.turnId", "long")))
    )
    k, own = _string(v, "$.message.type"), ("input_other", "input_cache_read", "input_cache_creation", "output")
    typed = (
        F.when(k == "TurnBegin", _event(k, text=joined("$.message.payload.user_input")))
        .when(k == "ContentPart", part("$.message.payload"))
        .when(k == "ToolCall", _event(k, tool_id=get(v, "$.message.payload.id"), tool_name=get(v, "$.message.payload.function.name"), tool_args=get(v, "$.message.payload.function.arguments")))
        .when(k == "ToolResult", _event(k, tool_id=get(v, "$.message.payload.tool_call_id"), output=get(v, "$.message.payload.return_value.output"), is_error=F.coalesce(get(v, "$.message.payload.return_value.is_error", "boolean"), F.lit(False))))
        .when(k == "StatusUpdate", _event(k, context_tokens=get(v, "$.message.payload.context_tokens", "long"), context_usage=get(v, "$.message.payload.context_usage", "double"),
                                          usage=F.when(_is(v, "$.message.payload.token_usage", "OBJECT"), usage("$.message.payload.token_usage", *own))))
        .when(k == "LLMRequest", _event(k, system_prompt_hash=get(v, "$.message.payload.system_prompt_hash"), tools_hash=get(v, "$.message.payload.tools_hash"), model=get(v, "$.message.payload.model")))
        .when(k == "UsageRecord", _event(k, usage=usage("$.message.payload", *own), model=get(v, "$.message.payload.model")))
        .when(k.isin("CompactionBegin", "CompactionEnd", "StepBegin"), _event(k))
    )
    dotted = F.contains(F.coalesce(kind, F.lit("")), F.lit("."))
    ts = F.coalesce(F.when(~dotted, F.nullif(get(v, "$.timestamp", "double"), F.lit(0.0))), F.when(dotted, get(v, "$.timestamp", "double")), get(v, "$.message.timestamp", "double"))
    return F.array(F.when(dotted, desktop).otherwise(typed)), ts


def load(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Events of all files with session, origin and format. A file in ``<session>/subagents/`` belongs to that session, as does
    ``agents/<id>/wire.jsonl``. Files that tell no format are read as rich ones, so that their lines are counted.

    One scan, without a shuffle: each line is read as its file's format says.
    """
    return with_sessions(events_of(read_lines(spark, paths, recursive)))


def events_of(lines: DataFrame) -> DataFrame:
    """Events of lines as read_lines() gives them."""
    lines = lines.withColumn("format", F.coalesce("format", F.lit("rich")))
    rich, rollout = F.col("format").isin("rich", "degraded"), F.col("format") == "rollout"
    (rich_e, rich_ts, ref), (rollout_e, rollout_ts), (wire_e, wire_ts) = _rich(), _rollout(), _wire()
    pick = lambda x, y, z: F.when(rich, x).when(rollout, y).otherwise(z)
    read = _with_texts(lines, rich).withColumns({"events": pick(rich_e, rollout_e, wire_e), "ts": pick(rich_ts, rollout_ts, wire_ts), "ref": F.when(rich, ref)})
    return _spread(read, "format")


def with_sessions(events: DataFrame) -> DataFrame:
    """session and origin, from the path."""
    src = F.col("source")
    child = r"/([^/]+)/subagents/([^/]+?)(?:/wire)?\.jsonl$"
    agent = r"/([^/]+)/agents/([^/]+)/wire\.jsonl$"
    wire = r"/([^/]+)/wire\.jsonl$"
    session = F.when(src.rlike(child), F.regexp_extract(src, child, 1)).when(src.rlike(agent), F.regexp_extract(src, agent, 1)).when(src.rlike(wire), F.regexp_extract(src, wire, 1))
    session = session.otherwise(F.regexp_extract(src, r"([^/]+?)(?:\.jsonl)?$", 1))
    name = F.regexp_extract(src, agent, 2)
    origin = F.when(src.rlike(child), F.concat(F.lit("subagent:"), F.regexp_extract(src, child, 2))).when(src.rlike(agent) & (name != "main"), F.concat(F.lit("subagent:"), name)).otherwise("main")
    return events.withColumns({"session": session, "origin": origin})


def with_shared_children(events: DataFrame) -> DataFrame:
    """``events`` where files of a ``subagents/`` folder that lies beside several transcripts belong to each of these. Such a folder
    names no session of its own; the children of one that does are left alone, as are those of a folder without any transcript."""
    folder = F.regexp_extract("source", r"^(.*)/subagents/[^/]+$", 1)
    mains = events.where("origin = 'main'").select("session", F.regexp_extract("source", r"^(.*)/[^/]+$", 1).alias("_folder")).distinct()
    own = mains.select("session", F.lit(True).alias("_own")).distinct()
    marked = events.withColumn("_folder", F.when(F.col("origin") != "main", F.nullif(folder, F.lit("")))).join(own, "session", "left")
    each = mains.select("_folder", F.col("session").alias("_of"))
    shared = marked.where("_own is null and _folder is not null").join(each, "_folder", "left")
    named = shared.withColumn("session", F.coalesce("_of", "session")).select(events.columns)
    return marked.where("_own or _folder is null").select(events.columns).unionByName(named)


def sidecars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session, agent, tool_id, agent_type, description, status (ok or malformed) of ``<child>.meta.json`` files."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", ".jsonl").alias("source"))
    v = F.try_parse_json("value")
    ok = F.schema_of_variant(v).startswith("OBJECT")
    named = with_sessions(raw.withColumn("v", F.when(ok, v)))
    return named.select("session", F.col("origin").alias("agent"), _string(F.col("v"), "$.toolUseId").alias("tool_id"), _string(F.col("v"), "$.agentType").alias("agent_type"),
                        _string(F.col("v"), "$.description").alias("description"), F.when(F.col("v").isNotNull(), "ok").otherwise("malformed").alias("status"))


def sidecar_defects(events: DataFrame, found: DataFrame) -> DataFrame:
    """session, agent, reason of subagent files whose sidecar is missing or malformed: counted, never guessed."""
    kids = events.where("origin <> 'main'").select("session", F.col("origin").alias("agent")).distinct()
    j = kids.join(found.select("session", "agent", "status"), ["session", "agent"], "left").where("status is null or status <> 'ok'")
    return j.select("session", "agent", F.when(F.col("status").isNull(), "meta_json_missing").otherwise("meta_json_malformed").alias("reason"))
