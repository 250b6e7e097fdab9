"""From events to the audit of each session, for one log or a corpus at once: every window and join has the session as its key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import interventions as people
from tracelake.functions.text import digest, estimate_tokens, let
from tracelake.model import dispatch
from tracelake.operators import asof, graph, islands, liveness, loads, pairing
from tracelake.operators.evidence import Rule

# Buckets of a context, what attachments are (bucket, kind), channels of bodies, patterns.
BUCKETS = ["system", "tools", "user", "inject", "skill", "assistant", "tool"]
UNATTRIBUTED = "unattributed"
ATTACHMENTS = {
    "skill_listing": ("skill", "skill_catalog"),
    "invoked_skills": ("skill", "skill_body"),
    "critical_system_reminder": ("inject", "reminder"),
    "task_reminder": ("inject", "reminder"),
    "goal_state": ("inject", "goal_state"),
    "auto_mode": ("inject", "auto_mode"),
    "auto_mode_exit": ("inject", "auto_mode_exit"),
    "queued_command": ("inject", "queued_command"),
    "edited_text_file": ("inject", "file_snapshot"),
    "file": ("inject", "file_snapshot"),
    "post_compact_restored_files": ("inject", "compact_restore"),
    "directory": ("inject", "directory_listing"),
    "date_change": ("inject", "date_change"),
    "relevant_memories": ("inject", "memory"),
    "hook_non_blocking_error": ("inject", "hook_error"),
    "mcp_instructions_delta": ("tools", "tool_schema"),
    "agent_listing_delta": ("inject", "listing_delta"),
}
BODY_CHANNELS = {"attachment:invoked_skills": "invoked_skills", "attachment:hook_output": "hook_output", "signature:skill_body": "user_signature"}
SKILL_CONTENT = r'<skill_content\s+name="([^"]+)"'
BASE_DIRECTORY = r"Base directory for this skill:\s*(\S+)"
LISTING_LINE = r"^- (.+?): "
STUB = r"\ALaunching skill: ([^\n]+)\z"
SKILL_FILE = r"(?i)SKILL\.md"

SA = ["session", "agent"]
PREVIEW = 200


@dataclass
class Audit:
    records: DataFrame
    agents: DataFrame
    items: DataFrame
    calls: DataFrame
    compactions: DataFrame
    observations: DataFrame
    skill_loads: DataFrame
    dispatches: DataFrame
    phases: DataFrame
    dispatch_links: DataFrame
    phase_recognition: DataFrame
    interventions: DataFrame
    dropped: DataFrame


def signature(text: Column) -> Column:
    """The name of a skill whose body this is: by its tag, else by the last part of its base directory; null if neither is there."""

    def of(t: Column) -> Column:
        folder = F.element_at(F.split(F.regexp_replace(F.regexp_extract(t, BASE_DIRECTORY, 1), "/+$", ""), "/"), -1)
        return F.coalesce(F.nullif(F.regexp_extract(t, SKILL_CONTENT, 1), F.lit("")), F.nullif(folder, F.lit("")))

    return let(text, of)


def records_of(events: DataFrame) -> DataFrame:
    """A row for each line: kind, positive (it has usage), identity and place."""
    u = F.col("usage")
    counters = sum(F.coalesce(u[c], F.lit(0)) for c in ("input_other", "output", "cache_read", "cache_5m", "cache_1h"))
    has = lambda *t: F.bool_or(F.col("type").isin(*t))
    r = events.groupBy("session", "origin", "source", "seq").agg(
        F.min("ts").alias("ts"),
        F.when(has("ContentPart", "ToolCall", "UsageRecord"), "assistant").when(has("TurnBegin", "ToolResult"), "user").otherwise("meta").alias("kind"),
        F.bool_or(F.coalesce((F.col("type") == "UsageRecord") & (counters > 0), F.lit(False))).alias("positive"),
        F.max_by(F.when(F.col("type") == "UsageRecord", u), F.when(F.col("type") == "UsageRecord", F.col("part"))).alias("usage"),
        F.min_by("ref", "part").alias("ref"),
        F.bool_or(F.col("type") == "CompactionBegin").alias("boundary"),
        F.min_by(F.col("compact"), F.when(F.col("type") == "CompactionBegin", F.col("part"))).alias("compact"),
    )
    return _attributed(r)


def _attributed(records: DataFrame) -> DataFrame:
    """Adds agent: main, subagent:<file> or sidechain:<topmost sidechain record>. Records on a cycle, and those below one, are one agent:
    of the cycle's record that is reached last from where the first of them enters it."""
    side = records.where("origin = 'main' and ref.is_sidechain").select("session", "source", F.col("ref.uuid").alias("uuid"), F.col("ref.parent_uuid").alias("up"), "seq")
    known = side.where("uuid is not null").groupBy("session", "source", "uuid").agg(F.min_by("up", "seq").alias("up"), F.min("seq").alias("seq"))
    node = F.struct("session", "source", "uuid")
    links = known.select(node.alias("node"), F.when(F.col("up").isNotNull(), F.struct("session", "source", F.col("up").alias("uuid"))).alias("parent"), "seq")
    found = graph.parents_to_roots(links)
    # a cycle is named by the record before the one where its first record enters
    first = found.where("cyclic").join(links.select("node", "seq"), "node").groupBy("root").agg(F.min_by("entry", "seq").alias("_first"))
    before = found.where("cyclic and depth = 0").join(links.select("node", F.col("parent").alias("_first")), "node").join(first, ["root", "_first"])
    named = found.join(before.select("root", F.col("node").alias("_last")), "root", "left")
    roots = named.select("node.session", "node.source", F.col("node.uuid").alias("_uuid"), F.coalesce("_last.uuid", "root.uuid").alias("_root"))
    r = records.withColumn("_uuid", F.when((F.col("origin") == "main") & F.col("ref.is_sidechain"), F.col("ref.uuid"))).join(roots, ["session", "source", "_uuid"], "left")
    name = F.when(F.col("origin") != "main", F.col("origin")).when(F.col("ref.is_sidechain"), F.concat(F.lit("sidechain:"), F.coalesce("_root", F.lit("unknown")))).otherwise("main")
    return r.withColumn("agent", name).drop("_uuid", "_root")


def items_of(events: DataFrame, records: DataFrame) -> DataFrame:
    """What went into contexts, a row for each item: bucket, kind, channel, sizes, digests, the skill it stands for."""
    place = ["session", "source", "seq"]
    e = events.drop("origin").join(records.select(*place, "agent"), place)
    e = _read_links(e)
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    sig, out = signature(text), F.coalesce("output", F.lit(""))
    att = F.col("attachment_type")
    item = "struct<bucket:string,kind:string,text:string,channel:string,name:string,skill:string,by_signature:boolean,human:string>"

    def one(bucket: str | Column, what: str | Column, body: Column, channel: str | Column, name: Column | None = None, skill: Column | None = None, by_signature: bool = False, human: Column | None = None) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        null = F.lit(None).cast("string")
        c = [lit(bucket), lit(what), body, lit(channel), null if name is None else name, null if skill is None else skill, F.lit(by_signature), null if human is None else human]
        return F.struct(*[x.alias(n) for x, n in zip(c, ["bucket", "kind", "text", "channel", "name", "skill", "by_signature", "human"], strict=True)]).cast(item)

    human = F.when(F.col("agent") == "main", F.col("ref.human_text"))
    turn = (
        F.when(F.col("ref.is_summary"), one("inject", "compact_summary", text, "user:compact_summary", human=human))
        .when(sig.isNotNull(), one("skill", "skill_body", text, "signature:skill_body", sig, F.lower(sig), True, human))
        .otherwise(one("user", "user_message", text, "user", human=human))
    )
    stub = F.trim(F.regexp_extract(F.trim(out), STUB, 1))
    folder = F.col("_folder")
    result = (
        F.when(stub != "", one("skill", "skill_stub", out, "tool_result", stub, F.lower(stub)))
        .when(folder.isNotNull() & ~F.col("is_error"), one("tool", "tool_result", out, "tool_result", F.nullif(folder, F.lit("")), F.nullif(F.lower(folder), F.lit(""))))
        .otherwise(one("tool", "tool_result", out, "tool_result"))
    )
    args, tool = F.coalesce("tool_args", F.lit("")), F.lower(F.coalesce("tool_name", F.lit("")))
    asked = F.when(tool == "skill", F.lower(F.nullif(F.get_json_object(args, "$.skill"), F.lit(""))))
    call = one("assistant", "tool_call", args, "assistant", F.nullif(F.col("tool_name"), F.lit("")), asked)
    channel = F.concat(F.lit("attachment:"), att)
    known = F.create_map(*[F.lit(x) for k, (b, w) in ATTACHMENTS.items() for x in (k, f"{b}/{w}")])
    cls = F.split(F.try_element_at(known, att), "/")
    hook = F.when(sig.isNotNull(), one("skill", "skill_body", text, channel, sig, F.lower(sig), True)).otherwise(one("inject", "hook_inline", text, channel))

    def entry(x: Column) -> Column:
        shown = F.coalesce(x["name"], F.when(cls[0] == "skill", signature(x["text"])))
        return one(cls[0], cls[1], x["text"], channel, shown, F.when(cls[0] == "skill", F.lower(shown)))

    attached = (
        F.when(att == "hook_output", F.array(hook))
        .when(cls.isNull(), F.array(one(UNATTRIBUTED, "unknown", text, channel)))
        .when(F.col("entries").isNotNull(), F.transform("entries", entry))
        .otherwise(F.array(one(cls[0], cls[1], text, channel, F.col("tool_name"))))
    )
    spoken = F.when(F.col("part_type") == "text", "assistant_text").when(F.col("part_type") == "think", "thinking")
    each = (
        F.when((kind == "ContentPart") & spoken.isNotNull(), F.array(one("assistant", spoken, text, "assistant")))
        .when(kind == "ToolCall", F.array(call))
        .when(kind == "TurnBegin", F.array(turn))
        .when(kind == "ToolResult", F.array(result))
        .when(kind == "Attachment", attached)
    )
    use = F.when(kind.isin("ToolCall", "ToolResult"), F.col("tool_id"))
    path = F.when(kind == "ToolCall", F.nullif(F.get_json_object(args, "$.file_path"), F.lit("")))
    x = e.select("session", "agent", "source", "seq", "part", "ts", "is_error", use.alias("tool_id"), path.alias("file_path"), F.posexplode(each).alias("entry", "i"))
    index = F.row_number().over(Window.partitionBy(*SA, "source", "seq").orderBy("part", "entry")) - 1
    x = x.select(*SA, "source", "seq", index.cast("long").alias("part_index"), "ts", "tool_id", "file_path", "is_error", "i.*")
    x = x.withColumns({"item_id": F.concat_ws(":", "agent", "seq", "part_index"), "tokens": estimate_tokens(F.col("text")), "sha1": F.sha1("text"), "norm_sha1": digest(F.col("text")), "size_chars": F.length("text").cast("long")})
    return _briefs(x)


def _read_links(events: DataFrame) -> DataFrame:
    """_folder on results of reads of a skill's file: the folder's name. The first result after the call takes it."""
    args, tool = F.coalesce("tool_args", F.lit("")), F.lower(F.coalesce("tool_name", F.lit("")))
    path = F.get_json_object(args, "$.file_path")
    reads = (F.col("type") == "ToolCall") & (tool == "read") & path.rlike(SKILL_FILE)
    stub = F.trim(F.coalesce("output", F.lit(""))).rlike(STUB)
    mark = F.when(reads, path).when((F.col("type") == "ToolResult") & ~stub, F.lit(""))
    w = Window.partitionBy(*SA, "tool_id").orderBy("source", "seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    # events without a tool id have nothing to link, and must not meet in one window
    tools = events.where(F.col("type").isin("ToolCall", "ToolResult") & F.col("tool_id").isNotNull())
    others = events.where(~F.col("type").isin("ToolCall", "ToolResult") | F.col("tool_id").isNull())
    open_read = F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit(""))
    parent = F.regexp_extract(F.regexp_replace(open_read, "/+$", ""), r"([^/]*)/[^/]*$", 1)
    tools = tools.withColumn("_folder", F.when((F.col("type") == "ToolResult") & ~stub & open_read.isNotNull(), parent))
    return tools.unionByName(others.withColumn("_folder", F.lit(None).cast("string")))


def _briefs(items: DataFrame) -> DataFrame:
    """Adds brief: the first thing said to a subagent is what it was sent to do. It was injected, no person wrote it."""
    said = (F.col("kind") == "user_message") | ((F.col("kind") == "skill_body") & (F.col("channel") == "signature:skill_body"))
    n = F.sum(said.cast("int")).over(Window.partitionBy(*SA).orderBy("source", "seq", "part_index").rowsBetween(Window.unboundedPreceding, 0))
    brief = said & (n == 1) & (F.col("agent") != "main")
    sent = brief & (F.col("kind") == "user_message")  # a skill's body stays one
    return items.withColumns({"was_kind": F.col("kind"), "brief": brief, "kind": F.when(sent, "dispatch_brief").otherwise(F.col("kind")), "bucket": F.when(sent, "inject").otherwise(F.col("bucket"))})


def calls_of(records: DataFrame, items: DataFrame) -> DataFrame:
    """Requests: spans of records with what was alive in their context by bucket. Agents without any identity have none."""
    known = F.bool_or(F.col("ref.request_hash").isNotNull() | F.col("ref.request_id").isNotNull()).over(Window.partitionBy(*SA))
    r = records.withColumn("_known", F.coalesce(known, F.lit(False))).where("_known")
    s = islands.spans(r, SA, anchor="usage").withColumnRenamed("anchor", "usage")
    s = s.withColumns({"call_id": F.concat_ws(":", "agent", F.col("span_no")), "anchor": F.nullif(F.col("usage.input_other"), F.lit(0))})
    filled = liveness.alive_sums(items.where(F.col("bucket") != UNATTRIBUTED), s, SA, BUCKETS)
    return filled.withColumn("unattributed", F.col("anchor") - sum(F.col(f"{b}_tokens") for b in BUCKETS))


def tiers_of(records: DataFrame) -> DataFrame:
    """agent rows: how their requests are known (1 by hash, 2 by id, 3 not at all), and counts."""
    tier = F.when(F.max("ref.request_hash").isNotNull(), 1).when(F.max("ref.request_id").isNotNull(), 2).otherwise(3)
    parent = F.min_by("ref.parent_tool_id", F.when(F.col("ref.parent_tool_id").isNotNull(), F.col("seq")))
    return records.groupBy(*SA).agg(tier.alias("tier"), F.count("*").alias("n_records"), F.min("seq").alias("first_seq"), parent.alias("parent_tool_id"))


def compactions_of(records: DataFrame, items: DataFrame) -> DataFrame:
    b = records.where("boundary")
    stops = records.where("kind = 'assistant'").select(*SA, "seq")
    back = liveness.first_after_boundary(items.where("kind = 'compact_restore'"), b, stops, SA).withColumnRenamed("boundary_seq", "seq")
    n = F.row_number().over(Window.partitionBy(*SA).orderBy("seq")) - 1
    return b.join(back, [*SA, "seq"]).select(*SA, F.concat_ws(":", "agent", F.lit("compact"), n).alias("compaction_id"), "ts", F.col("seq").alias("boundary_seq"), "compact.*", "n_restored")


def observations_of(items: DataFrame, calls: DataFrame) -> DataFrame:
    """Listings, bodies, stubs and executions of skills, each with the call that holds it or comes next. Bare names take the only
    name with a namespace that ends in them, unless they are listed themselves."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n", -1), lambda s: F.trim(s)), lambda s: s.rlike(LISTING_LINE))
    listed = items.where("kind = 'skill_catalog'").select("*", F.explode(lines).alias("_line"))
    shown = F.trim(F.regexp_extract("_line", LISTING_LINE, 1))
    listed = listed.select(*SA, "source", "seq", "part_index", "item_id", "ts", F.lit("listing").alias("kind"), F.lit("skill_listing").alias("channel"), F.lower(shown).alias("raw_id"), shown.alias("name"), estimate_tokens(F.col("_line")).alias("tokens"), F.sha1("_line").alias("sha1"), "gone_seq")
    own = items.where("skill is not null and was_kind in ('skill_body', 'tool_result', 'skill_stub', 'tool_call')")
    bodies = F.create_map(*[F.lit(x) for p in BODY_CHANNELS.items() for x in p])
    k = F.col("was_kind")
    kind = F.when(k.isin("skill_body", "tool_result"), "body").when(k == "skill_stub", "stub").otherwise("execution")
    channel = F.when(k == "skill_body", F.coalesce(F.try_element_at(bodies, "channel"), "channel")).when(k == "tool_result", "tool:read").when(k == "skill_stub", "tool_result").otherwise("skill_tool_call")
    own = own.select(*SA, "source", "seq", "part_index", "item_id", "ts", kind.alias("kind"), channel.alias("channel"), F.col("skill").alias("raw_id"), F.when(k != "tool_call", F.col("name")).alias("name"), "tokens", F.when(kind == "body", F.col("sha1")).alias("sha1"), "gone_seq")
    every = listed.unionByName(own)
    ids = every.groupBy("session", "raw_id").agg(F.bool_or(F.col("kind") == "listing").alias("listed")).withColumn("id", F.col("raw_id"))
    merged = pairing.merge_by_suffix(ids.select("session", "id", "listed"), within=["session"])
    every = every.join(merged.withColumnRenamed("id", "skill_id"), ["session", "raw_id"])
    return asof.holding_or_next(every, calls.select(*SA, "last_seq", "call_id"), SA, "seq", ["call_id"])


def interventions_of(items: DataFrame) -> DataFrame:
    said = items.where("agent = 'main' and kind = 'user_message'")
    return said.select("session", "item_id", "seq", people.classify(F.col("text")).alias("c"), F.sha1(people.strip_carriers(F.col("text"))["lead"]).alias("lead_sha1")).select("session", "item_id", "seq", "c.*", "lead_sha1")


def audit(events: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d, sidecars: DataFrame | None = None, rules: Sequence[Rule] = (), rule_set_version: str | None = None) -> Audit:
    """All of it. rules: how briefs and files that were read name phases of work. Lazy, but for the roots of sidechains, which are found in rounds. ``keep`` gets what several tables are built
    from; let it checkpoint or write a table, so that neither work nor plans repeat."""
    records = keep(records_of(events))
    agents = tiers_of(records)
    boundaries = records.where("boundary").select(*SA, "seq")
    items = keep(liveness.gone_after(items_of(events, records), boundaries, SA))
    calls = keep(calls_of(records, items))
    observations = keep(observations_of(items, calls))
    entries = observations.where("kind in ('stub', 'body')").withColumn("place", F.struct("seq", "part_index"))
    ledger = loads.load_ledger(entries, SA, "skill_id", seq="place")
    d = dispatch.dispatched(items, agents, sidecars, rules, rule_set_version, keep)
    return Audit(records, agents, d.items, calls, compactions_of(records, items), observations, ledger, d.dispatches, d.phases, d.links, d.recognition, interventions_of(items),
                 events.where("type = 'RecordDropped'").groupBy("session", "reason").agg(F.count("*").alias("n")))
