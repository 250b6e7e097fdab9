"""What happened in a session in the order of time: loads, reads, compactions, turns and how their context grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import estimate_tokens, split_injected
from tracelake.model.session import signature
from tracelake.operators import asof, billing, growth, liveness

# Tools that load a skill, file of a skill, tags of what is put into a person's text, kinds of what grows a context.
SKILL_TOOLS = ["skill", "skill_loaded"]
SKILL_FILE = r"(?i)SKILL\.md"
INJECTED_TAGS = ("system-reminder", "system_reminder", "restored_files", "user-prompt-submit-hook", "command-name", "command-message", "command-args", "local-command-stdout")
PARTS = ["history", "inject", "skill", "tool", "output"]


def in_order(events: DataFrame) -> DataFrame:
    """Adds n, the place in the session: by time, unknown times last, then by file and line."""
    w = Window.partitionBy("session").orderBy(F.col("ts").asc_nulls_last(), "seq", "source", "part")
    return events.withColumn("n", F.row_number().over(w).cast("long"))


def compactions(events: DataFrame) -> DataFrame:
    """session, i, begin_ts, end_ts of the main agent: an end closes the latest begin before it, the last end counts. An end
    without a begin closes nothing."""
    e = events.where("origin = 'main'")
    begins = e.where("type = 'CompactionBegin'").select("session", "n", F.col("n").alias("begin_n"), F.col("ts").alias("begin_ts"))
    ends = asof.asof(e.where("type = 'CompactionEnd'").select("session", "n", F.col("ts").alias("end_ts")), begins.select("session", "n", "begin_n"), ["session"], "n", ["begin_n"])
    last = ends.where("begin_n is not null").groupBy("session", "begin_n").agg(F.max_by("end_ts", "n").alias("end_ts"))
    i = F.row_number().over(Window.partitionBy("session").orderBy("begin_n")) - 1
    return begins.join(last, ["session", "begin_n"], "left").select("session", i.cast("long").alias("i"), "begin_ts", "end_ts")


def skill_loads(events: DataFrame) -> DataFrame:
    """Calls of the skill tools with their last result (none: an error without content), the first status at or after them and the
    first compaction at or after them, which is an inference."""
    calls = events.where((F.col("type") == "ToolCall") & F.lower("tool_name").isin(SKILL_TOOLS))
    calls = calls.select("session", "n", "ts", "tool_id", F.coalesce(F.get_json_object("tool_args", "$.skill"), F.get_json_object("tool_args", "$.name")).alias("skill"))
    results = events.where("type = 'ToolResult' and tool_id is not null").groupBy("session", "tool_id").agg(F.max_by(F.struct("output", "is_error"), "n").alias("r"))
    j = calls.join(results, ["session", "tool_id"], "left")
    j = j.select("session", "n", "ts", "skill", F.coalesce("r.is_error", F.col("r").isNull()).alias("is_error"), F.coalesce("r.output", F.lit("")).alias("content"), F.coalesce("ts", F.lit(0.0)).alias("at"))
    status = events.where("type = 'StatusUpdate' and ts is not null").select("session", F.col("ts").alias("at"), "n", "context_tokens")
    j = asof.asof(j, status, ["session"], "at", ["context_tokens"], "forward", ["n"])
    ends = events.where("type = 'CompactionBegin' and origin = 'main' and ts is not null").select("session", F.col("ts").alias("at"), F.col("ts").alias("evicted_ts"))
    return asof.asof(j, ends, ["session"], "at", ["evicted_ts"], "forward").drop("at")


def file_reads(events: DataFrame) -> DataFrame:
    path = F.coalesce(F.get_json_object("tool_args", "$.file_path"), F.get_json_object("tool_args", "$.path"))
    return events.where("type = 'ToolCall'").select("session", "n", "ts", path.alias("path")).where(F.col("path").rlike(SKILL_FILE))


def turns(events: DataFrame, billed: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """session, turn_no, n, context (measured at the turn by number, else the last status before it, else the first), crossed (a
    compaction lies before the next turn), added, comparable. Sessions without any measurement have no rows.

    billed: session, ts, prompt, row: the context of turns of sessions that have no measurement of their own. windows: session,
    window_start of compactions that a billed series shows; they cross a turn as those of the transcript do.
    """
    e = events.where("origin = 'main'")
    w = Window.partitionBy("session").orderBy("n")
    t = e.where("type = 'TurnBegin'").select("session", "n", "ts").withColumns({"turn_no": F.row_number().over(w).cast("long"), "next_n": F.lead("n").over(w), "next_ts": F.lead("ts").over(w)})
    status = e.where("type = 'StatusUpdate' and context_tokens is not null").select("session", "n", F.col("context_tokens").alias("status"))
    exact = e.where("type = 'TurnTokens'").groupBy("session", (F.col("turn_id") + 1).alias("turn_no")).agg(F.max_by("turn_tokens", "n").alias("exact"))
    first = status.groupBy("session").agg(F.min_by("status", "n").alias("first"))
    t = asof.asof(t, status, ["session"], "n", ["status"]).join(exact, ["session", "turn_no"], "left").join(first, "session", "left")
    t = t.withColumn("context", F.coalesce("exact", "status", "first"))
    whole = Window.partitionBy("session")
    t = t.withColumn("known", F.max(F.col("context").isNotNull()).over(whole))
    if billed is not None:
        paid = billing.turn_contexts(t.select("session", "ts", "turn_no"), billed, ["session"]).select("session", "turn_no", F.col("context").alias("paid"))
        has = billed.select("session").distinct().withColumn("has_bill", F.lit(True))
        t = t.join(paid, ["session", "turn_no"]).join(has, "session", "left")
        t = t.withColumns({"context": F.when(F.col("known"), F.col("context")).when(F.col("has_bill"), F.col("paid")), "known": F.col("known") | F.coalesce("has_bill", F.lit(False))}).drop("paid", "has_bill")
    t = t.where("known")
    ends = e.where("type = 'CompactionBegin'").select("session", F.col("n"))
    t = liveness.gone_after(t, ends, ["session"], "n")
    crossed = F.coalesce(F.col("gone_seq") < F.col("next_n"), F.lit(False))
    if windows is not None:
        starts = windows.where("window_start is not null").select("session", F.col("window_start").alias("ts"), F.col("window_start").alias("at"))
        t = asof.asof(t, starts, ["session"], "ts", ["at"], "forward")
        crossed = crossed | F.coalesce(F.col("at") <= F.col("next_ts"), F.lit(False))
    return growth.turn_growth(t.select("session", "turn_no", "n", "context", crossed.alias("crossed")), ["session"])


def part_items(events: DataFrame) -> DataFrame:
    """session, n, bucket, tokens, preview: what the main agent's context got from outside or made itself, a row for each item. The
    result of a call that loads a skill, or one that reads like a skill's body, is a skill's, not a tool's."""
    e = events.where("origin = 'main' and ts is not null")
    path = F.coalesce(F.get_json_object("tool_args", "$.file_path"), F.get_json_object("tool_args", "$.path"))
    tool = F.lower("tool_name")
    loading = (F.col("type") == "ToolCall") & (tool.isin(SKILL_TOOLS) | ((tool == "read") & path.rlike(SKILL_FILE)))
    loaders = events.where(F.col("origin") == "main").where(loading).select("session", "tool_id").distinct().withColumn("_skill", F.lit(True))
    human, injected = split_injected(F.coalesce("text", F.lit("")), INJECTED_TAGS)
    said = e.where("type = 'TurnBegin'").select("session", "n", F.explode(F.array(F.struct(F.lit("history").alias("bucket"), human.alias("body")), F.struct(F.lit("inject").alias("bucket"), injected.alias("body")))).alias("p")).select("session", "n", "p.*")
    out = F.coalesce("output", F.lit(""))
    results = e.where("type = 'ToolResult'").join(loaders, ["session", "tool_id"], "left")
    results = results.select("session", "n", F.when(F.col("_skill") | signature(out).isNotNull(), "skill").otherwise("tool").alias("bucket"), out.alias("body"))
    made = e.where("type = 'ContentPart' and part_type in ('text', 'think')").select("session", "n", F.lit("output").alias("bucket"), F.coalesce("text", F.lit("")).alias("body"))
    every = said.unionByName(results).unionByName(made).where("body <> ''")
    return every.select("session", "n", "bucket", estimate_tokens(F.col("body")).alias("tokens"), F.substring(F.regexp_replace(F.trim("body"), r"\s+", " "), 1, 160).alias("preview"))


def turn_parts(events: DataFrame, billed: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """turns() with <part>_added of each of PARTS and system_added, the growth that they leave unexplained."""
    t = turns(events, billed, windows)
    own = asof.asof(part_items(events), t.select("session", "n", "turn_no"), ["session"], "n", ["turn_no"]).where("turn_no is not null")
    return growth.turn_parts(t, own, ["session"], PARTS)


def top_items(events: DataFrame, n: int = 5) -> DataFrame:
    """The largest items of each turn, the first of equal ones first: session, turn_no, place, bucket, tokens, preview."""
    t = turns(events).select("session", "n", "turn_no")
    own = asof.asof(part_items(events), t, ["session"], "n", ["turn_no"]).where("turn_no is not null")
    w = Window.partitionBy("session", "turn_no").orderBy(F.desc("tokens"), "n", "bucket", "preview")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("session", "turn_no", "place", "bucket", "tokens", "preview")


def verdicts(events: DataFrame) -> DataFrame:
    """A verdict for each session; without measurements it says so."""
    known = growth.growth_verdict(turns(events), ["session"])
    none = events.select("session").distinct().join(known, "session", "left_anti").select("session", F.lit(0).cast("long").alias("n_turns"), F.lit(None).cast("double").alias("relative_slope"), F.lit("unavailable (no context telemetry)").alias("verdict"))
    return known.unionByName(none)


def preview(limit: int = 120) -> Column:
    """An event in one line."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, limit)
    n = lambda c: F.coalesce(F.col(f"usage.{c}"), F.lit(0))
    k = F.col("type")
    return (
        F.when(k == "ToolCall", F.concat(F.lit("call "), F.coalesce("tool_name", F.lit("?")), F.lit("("), cut("tool_args"), F.lit(")")))
        .when(k == "ToolResult", F.concat(F.lit("result "), cut("output")))
        .when(k == "ContentPart", F.concat(F.coalesce("part_type", F.lit("content")), F.lit(" "), cut("text")))
        .when(k == "TurnBegin", F.concat(F.lit("user: "), cut("text")))
        .when(k == "StatusUpdate", F.concat(F.lit("ctx "), s("context_tokens"), F.lit(" tokens")))
        .when(k == "UsageRecord", F.format_string("usage in=%d out=%d cache=%d", n("input_other") + n("cache_read"), n("output"), n("cache_read")))
        .when(k == "LLMRequest", F.concat(F.lit("llm.request "), s("model"), F.lit(" syshash="), F.substring(F.coalesce("system_prompt_hash", F.lit("")), 1, 8)))
        .when(k == "TurnTokens", F.concat(F.lit("turn "), s("turn_id"), F.lit(" ctx="), s("turn_tokens"), F.lit(" tokens")))
        .otherwise(k)
    )


def feed(events: DataFrame, last: int = 400) -> DataFrame:
    """The last events of each session, a line each."""
    w = Window.partitionBy("session").orderBy(F.desc("n"))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).select("session", "n", "ts", "type", preview().alias("line"))
