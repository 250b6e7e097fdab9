"""Dispatches: calls that sent a subagent, what it was sent to do, and the phase of work that the evidence names.

All tables have the session as their key. The join is by string equality of tool ids alone, which records carry or else a sidecar does;
nothing is made up from names. Sides without the other are counted, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import evidence

SA = ["session", "agent"]
# Fixed value: agents that are child chats of an editor's database.
CHILD_CHAT = "subagent:ide-db:"


@dataclass
class Dispatched:
    """dispatches: a row for each joined or orphaned call, and for each subagent that no call sent (link: linked, orphan, unmatched).
    phases: a row for each phase that a dispatch is evidence of. links, recognition: counts by session. items: with phase_id."""

    dispatches: DataFrame
    phases: DataFrame
    links: DataFrame
    recognition: DataFrame
    items: DataFrame


def _argument(args: Column, name: str) -> Column:
    """A member of a JSON object if it is a string."""
    v = F.try_variant_get(F.try_parse_json(args), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def ranked_agents(agents: DataFrame) -> DataFrame:
    """agents with rank: main first, then sidechains by their first record, then subagents by name."""
    group = F.when(F.col("agent") == "main", 0).when(F.col("agent").startswith("sidechain:"), 1).otherwise(2)
    return agents.withColumn("rank", F.struct(group.alias("group"), F.when(group == 1, F.col("first_seq")).otherwise(F.lit(0)).alias("seq"), F.col("agent").alias("name")))


def linked_agents(agents: DataFrame, sidecars: DataFrame | None) -> DataFrame:
    """Subagents with link_id and link_source (records, meta), and what their sidecars say."""
    kids = agents.where("agent <> 'main'").withColumn("link_source", F.when(F.col("parent_tool_id").isNotNull(), "records"))
    if sidecars is None:
        none = F.lit(None).cast("string")
        return kids.withColumns({"link_id": F.col("parent_tool_id"), "meta_type": none, "meta_description": none, "has_meta": F.lit(False)})
    said = sidecars.where("status = 'ok'").groupBy(*SA).agg(F.min(F.struct(F.nullif("tool_id", F.lit("")).alias("tool_id"), "agent_type", "description")).alias("_m"))
    j = kids.join(said, SA, "left")
    return j.select(
        *[c for c in kids.columns if c != "link_source"],
        F.coalesce("parent_tool_id", "_m.tool_id").alias("link_id"),
        F.coalesce("link_source", F.when(F.col("_m.tool_id").isNotNull(), "meta")).alias("link_source"),
        F.col("_m.agent_type").alias("meta_type"),
        F.col("_m.description").alias("meta_description"),
        F.col("_m").isNotNull().alias("has_meta"),
    )


def dispatched(items: DataFrame, agents: DataFrame, sidecars: DataFrame | None = None, rules: Sequence[evidence.Rule] = (), rule_set_version: str | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> Dispatched:
    """items and agents as the session model makes them. No rules ship with this: without any, tier B can't occur. ``keep`` gets what
    several tables are built from: a row for each dispatch, and what is stamped on items."""
    order = ranked_agents(agents).select(*SA, "rank")
    calls = items.where("kind = 'tool_call' and tool_id is not null")
    place = F.struct("rank", "source", "seq", "part_index")
    calls = calls.join(order, SA).select("session", F.col("agent").alias("parent_agent"), "tool_id", "item_id", "name", "seq", "ts", F.col("text").alias("args"), place.alias("place"))
    first = calls.groupBy("session", "tool_id").agg(F.min_by(F.struct(*[c for c in calls.columns if c not in ("session", "tool_id")]), "place").alias("c"))
    kids = linked_agents(agents, sidecars).join(order, SA)
    kids = kids.select("session", "agent", F.col("link_id").alias("tool_id"), "link_source", "meta_type", "meta_description", F.col("rank").alias("kid_rank"))
    joined = first.join(kids.where("tool_id is not null"), ["session", "tool_id"]).select("session", "tool_id", "c.*", *kids.columns[1:2], *kids.columns[3:])
    claimed = joined.select("session", "tool_id").distinct()
    orphans = calls.where("lower(name) = 'agent'").join(claimed, ["session", "tool_id"], "left_anti")
    loose = kids.join(claimed, ["session", "tool_id"], "left_anti")
    number = F.row_number().over(Window.partitionBy("session", "parent_agent").orderBy("seq", "item_id", "kid_rank"))
    rows = joined.withColumn("link", F.lit("linked")).unionByName(orphans.withColumn("link", F.lit("orphan")), allowMissingColumns=True)
    rows = rows.withColumn("dispatch_id", F.concat_ws(":", "parent_agent", F.lit("dispatch"), number))
    rows = rows.withColumns({"subagent_type": F.coalesce(_argument(F.col("args"), "subagent_type"), "meta_type"), "description": F.coalesce(_argument(F.col("args"), "description"), "meta_description")})

    said = items.where("brief").select(*SA, F.struct("item_id", "tokens", "channel", "kind", "skill", "name").alias("b"), evidence.match_refs(F.col("text"), F.lit("brief"), rules, "brief").alias("said"))
    path = F.concat(F.lit("read:"), F.col("file_path"))
    reads = items.where("kind = 'tool_call' and lower(name) = 'read' and file_path is not null and agent <> 'main'")
    reads = reads.select(*SA, "source", "seq", "part_index", "item_id", "file_path", evidence.match_refs(F.col("file_path"), path, rules, "read").alias("found")).where(F.size("found") > 0)
    seen = reads.groupBy(*SA).agg(F.sort_array(F.collect_list(F.struct("source", "seq", "part_index", "found"))).alias("s")).select(*SA, F.flatten(F.col("s.found")).alias("seen"))
    rows = rows.join(said, SA, "left").join(seen, SA, "left")
    none = F.array().cast(f"array<{evidence.REF}>")
    body = F.coalesce(F.col("b.kind") == "skill_body", F.lit(False))
    refs = F.when(~body & F.col("agent").isNotNull(), F.concat(F.coalesce("said", none), F.coalesce("seen", none))).otherwise(none)
    rows = rows.withColumns({"phase_refs": refs, "fact": F.col("b.skill"), "brief_tokens": F.col("b.tokens"), "brief_name": F.col("b.name"), "brief_channel": F.col("b.channel"), "brief_item_id": F.col("b.item_id")})
    rows = keep(evidence.resolved(rows, "fact", body, "phase_refs").drop("b", "said", "seen", "args"))

    phases = evidence.observed(rows, "brief_tokens", rules, "brief_name").select(
        "session", F.col("observed_phase").alias("phase_id"), F.col("phase_name").alias("name"), F.lit("dispatch").alias("kind"), F.col("parent_agent").alias("agent"),
        "dispatch_id", "ts", F.col("brief_tokens").alias("tokens"), F.col("brief_channel").alias("channel"),
    )
    count = lambda c: F.count_if(c)
    chat = F.col("agent").startswith(CHILD_CHAT)
    tally = rows.groupBy("session").agg(
        F.count("*").alias("dispatches"),
        count((F.col("link_source") == "records") & ~chat).alias("joined"),
        count((F.col("link_source") == "records") & chat).alias("joined_via_ide_db"),
        count(F.col("link_source") == "meta").alias("joined_via_meta_only"),
        count(F.col("link") == "orphan").alias("orphan_dispatches"),
        count(F.col("brief_item_id").isNotNull()).alias("briefs_found"),
        count(F.col("brief_item_id").isNull()).alias("briefs_missing"),
        *[count(F.col("tier") == t).alias(f"tier{t}") for t in "ABC"],
    )
    lost = loose.groupBy("session").agg(F.count("*").alias("unmatched_subagent_files"))
    loaded = F.lit(None).cast("string") if sidecars is None else F.col("agent")
    meta = (agents if sidecars is None else sidecars.where("status = 'ok'")).groupBy("session").agg(F.count_distinct(loaded).alias("meta_files_loaded"))
    every = agents.select("session").distinct().join(tally, "session", "left").join(lost, "session", "left").join(meta, "session", "left").fillna(0)
    links = every.select("session", "dispatches", "joined", "joined_via_ide_db", "joined_via_meta_only", "orphan_dispatches", "unmatched_subagent_files", "meta_files_loaded", "briefs_found", "briefs_missing")
    recognition = every.select("session", "tierA", "tierB", "tierC", F.lit(rule_set_version).cast("string").alias("rule_set_version"))

    known = rows.where("phase_id is not null and agent is not null").select(*SA, "phase_id", "tier", "brief_item_id")
    on_brief = known.where("brief_item_id is not null").select("session", F.col("brief_item_id").alias("item_id"), "phase_id")
    # of several reads of one path the last stands for it
    last = reads.groupBy(*SA, "file_path").agg(F.max_by("item_id", F.struct("source", "seq", "part_index")).alias("item_id"), F.max("found").alias("found"))
    on_reads = last.join(known.where("tier = 'B'"), SA).where(F.exists("found", lambda r: r["phase_id"] == F.col("phase_id"))).select("session", "item_id", "phase_id")
    stamps = on_brief.unionByName(on_reads).groupBy("session", "item_id").agg(F.max("phase_id").alias("phase_id"))
    stamped = items.join(keep(stamps), ["session", "item_id"], "left").select(*items.columns, "phase_id")

    cols = ["session", "dispatch_id", "parent_agent", "tool_id", "item_id", "name", "agent", "link", "link_source", "brief_item_id", "brief_tokens", "subagent_type", "description", "phase_refs", "tier", "phase_id", "ts"]
    unmatched = loose.where("tool_id is not null").select("session", "tool_id", "agent", "link_source", F.lit("unmatched").alias("link"))
    dispatches = rows.select(cols).unionByName(unmatched, allowMissingColumns=True)
    return Dispatched(dispatches, phases, links, recognition, stamped)
