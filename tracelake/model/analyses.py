"""Analyses of an audit: the generic operators on the tables of model.session, for all sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model.session import BUCKETS, SA, UNATTRIBUTED, Audit
from tracelake.operators import asof, billing, gaps, growth, islands, liveness, loads, pairing, redundancy, returns

# Files that steer a workflow, tools that read and write them, sizes of results that may repeat.
WORKFLOW_FILE = r"(?i)(?:^|/)progress\.md$|(?:^|/)\.changes(?:/|$)"
READ_TOOLS, WRITE_TOOLS = ["read"], ["write", "edit", "multiedit"]
REPEAT_CHARS = 200
INJECTED = ["inject", "skill"]


def skill_audit(a: Audit) -> DataFrame:
    o = a.observations.withColumn("at", F.struct(F.col("ts").isNull(), "ts", "item_id"))
    return loads.observation_audit(o, ["session", "skill_id"], "kind", "sha1", "tokens", "channel", "at")


def outputs(a: Audit) -> DataFrame:
    """Items that a call produced: of its span's records, assistant texts, thoughts and tool calls."""
    made = a.items.where("kind in ('assistant_text', 'thinking', 'tool_call')").select(*SA, "seq", "part_index", "item_id", "kind", "tokens")
    held = asof.holding_or_next(made, a.calls.select(*SA, "first_seq", "last_seq", "call_id"), SA, "seq", ["call_id", "first_seq"])
    return held.where("first_seq <= seq").drop("first_seq")


def refs(a: Audit) -> DataFrame:
    """A row for each call and item in its context."""
    return liveness.alive_refs(a.items.where(F.col("bucket") != UNATTRIBUTED), a.calls.select(*SA, "call_id", "first_seq"), SA)


def context_organization(a: Audit) -> DataFrame:
    """By call: buckets, the share they don't explain, and injected tokens that are new or were in an earlier context."""
    r = refs(a).where(F.col("item_bucket").isin(INJECTED))
    marked = redundancy.new_and_repeated(r, SA, "item_sha1", ["first_seq", "item_seq", "item_part_index"])
    total = lambda new: F.coalesce(F.sum(F.when(F.col("is_new") == F.lit(new), F.col("item_tokens"))), F.lit(0))
    sums = marked.groupBy(*SA, "call_id").agg(total(True).alias("new_tokens"), total(False).alias("reinjected_tokens"))
    j = a.calls.join(sums, [*SA, "call_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("new_tokens", "reinjected_tokens")}
    return j.withColumns(zero).select(*SA, "call_id", "anchor", *[f"{b}_tokens" for b in BUCKETS], "unattributed", F.bround(F.col("unattributed") / F.col("anchor"), 4).alias("unattributed_share"), *zero)


def repeated_items(a: Audit) -> DataFrame:
    i = a.items.withColumn("at", F.struct("agent", "seq", "part_index"))
    return redundancy.duplicate_groups(i.withColumn("digest", F.concat_ws(":", "session", "norm_sha1")), "digest", "item_id", "bucket", "tokens", "at")


def exact_resends(a: Audit) -> DataFrame:
    h = a.records.where("ref.request_hash is not null").groupBy(*SA, F.col("ref.request_hash").alias("h"), F.col("ref.request_id").alias("q")).agg(F.count("*").alias("_"))
    return redundancy.resends(h, SA, "h")


def short_lived(a: Audit) -> DataFrame:
    """Items that a compaction removed after a single call had seen them."""
    once = refs(a).groupBy("session", F.col("item_item_id").alias("item_id")).agg(F.count("*").alias("n")).where("n = 1")
    return a.items.where("gone_seq is not null").join(once, ["session", "item_id"], "left_semi").select("session", "item_id", "kind", "tokens")


def subagent_returns(a: Audit) -> DataFrame:
    d = a.dispatches.where("item_id is not null").withColumn("k", F.concat_ws("\u0000", "session", "tool_id"))
    results = a.items.where("kind in ('tool_result', 'skill_stub') and tool_id is not null").withColumn("k", F.concat_ws("\u0000", "session", "tool_id")).withColumn("at", F.struct("seq", "part_index"))
    work = a.items.join(d.where("agent is not null").select("session", "agent", "k"), ["session", "agent"])
    return returns.subagent_returns(d, results, work, "k", digest="norm_sha1", order="at").select(F.split("k", "\u0000")[0].alias("session"), F.split("k", "\u0000")[1].alias("tool_id"), "process_tokens", "return_tokens", "ratio", "echo", "flags")


def process_signature(a: Audit) -> DataFrame:
    """How each session worked: workflow files touched, listings, loads, interventions, and its style."""
    tool = F.lower(F.coalesce("name", F.lit("")))
    on = F.coalesce(F.col("file_path").rlike(WORKFLOW_FILE), F.lit(False)) & (F.col("kind") == "tool_call")
    i = a.items.groupBy("session").agg(
        F.count_if(on & tool.isin(READ_TOOLS)).alias("reads"), F.count_if(on & tool.isin(WRITE_TOOLS)).alias("writes"), F.count_if(F.col("bucket") == "inject").alias("injected"),
        F.coalesce(F.sum(F.when(F.col("bucket") == "inject", F.col("tokens"))), F.lit(0)).alias("injected_tokens"), F.sum("tokens").alias("total"), F.count_if(F.col("kind") == "user_message").alias("turns"),
    )
    n = a.skill_loads.groupBy("session").agg(F.count("*").alias("loads"), F.count_if(F.col("load_kind") == "reload").alias("reloads"))
    v = a.interventions.groupBy("session").agg(F.count("*").alias("interventions"), F.count_if(F.col("label") != "noise").alias("signal"))
    j = i.join(n, "session", "left").join(v, "session", "left").fillna(0, ["loads", "reloads", "interventions", "signal"])
    return j.withColumn("style", loads.process_style(F.col("reads") + F.col("writes") > 0, F.col("loads") > 0))


ATTACHED = ["body", "stub", "execution"]


def listings(a: Audit) -> DataFrame:
    """session, skills, occurrences, listing_extra: skills that were listed, how often, and the tokens of listings after each first."""
    o = a.observations.where("kind = 'listing'").withColumn("nth", F.row_number().over(Window.partitionBy("session", "skill_id").orderBy(F.col("ts").isNull(), "ts", "item_id")))
    return o.groupBy("session").agg(F.count_distinct("skill_id").alias("skills"), F.count("*").alias("occurrences"), F.coalesce(F.sum(F.when(F.col("nth") > 1, F.col("tokens"))), F.lit(0)).alias("listing_extra"))


def load_costs(a: Audit) -> DataFrame:
    """The ledger of loads with the tokens and channel of each body."""
    bodies = a.observations.where("kind = 'body'").withColumn("place", F.struct("seq", "part_index"))
    return loads.load_costs(a.skill_loads, bodies, SA, "skill_id", "place")


def load_totals(a: Audit) -> DataFrame:
    """session, loads, reloads, unavailable, load_cost (tokens of bodies) and redundant_bodies, which have no row of their own."""
    n = lambda k: F.count_if(F.col("load_kind") == k)
    g = load_costs(a).groupBy("session").agg(n("load").alias("loads"), n("reload").alias("reloads"), n("unavailable").alias("unavailable"), F.coalesce(F.sum("cost_tokens"), F.lit(0)).alias("load_cost"))
    entries = a.observations.where("kind in ('stub', 'body')").withColumn("place", F.struct("seq", "part_index"))
    extra = loads.redundant_bodies(entries, SA, "skill_id", "place").groupBy("session").agg(F.sum("redundant_bodies").alias("redundant_bodies"))
    return g.join(extra, "session", "full").fillna(0)


def skill_tree(a: Audit) -> dict[str, DataFrame]:
    """nodes (agents with their requests, the agent that sent them, listed and attached tokens; loose: no call sent them),
    attachments (skills by agent: loads, their tokens, executed, versions) and totals by session."""
    sent = a.dispatches.where("agent is not null and item_id is not null")
    parent = sent.groupBy("session", "agent").agg(F.min("item_id").alias("via"))
    own = a.items.where("kind = 'tool_call'").select("session", F.col("item_id").alias("via"), F.col("agent").alias("parent_agent"))
    parent = parent.join(own, ["session", "via"], "left")
    calls = a.calls.groupBy(*SA).agg(F.count("*").alias("n_requests"))
    ambient = a.observations.where("kind = 'listing'").groupBy(*SA).agg(F.count_distinct("skill_id").alias("listed_skills"), F.count("*").alias("listings"), F.sum("tokens").alias("listed_tokens"))
    priced = load_costs(a).groupBy(*SA, "skill_id").agg(F.count("*").alias("loads"), F.coalesce(F.sum("cost_tokens"), F.lit(0)).alias("load_tokens"), F.array_sort(F.collect_set("channel")).alias("channels"))
    held = a.observations.where(F.col("kind").isin(ATTACHED)).groupBy(*SA, "skill_id").agg(F.bool_or(F.col("kind") == "execution").alias("executed"), F.count_if(F.col("kind") == "execution").alias("executions"), F.array_sort(F.collect_set("sha1")).alias("sha1s"))
    attachments = held.join(priced, [*SA, "skill_id"], "left").fillna(0, ["loads", "load_tokens"])
    attached = attachments.groupBy(*SA).agg(F.count("*").alias("attachments"), F.sum("load_tokens").alias("attached_tokens"), F.sum("executions").alias("executions"))
    has_main = F.max(F.col("agent") == "main").over(Window.partitionBy("session"))
    nodes = a.agents.select(*SA).join(calls, SA, "left").join(parent, SA, "left").join(ambient, SA, "left").join(attached, SA, "left")
    nodes = nodes.fillna(0, ["n_requests", "listed_skills", "listings", "listed_tokens", "attachments", "attached_tokens", "executions"])
    nodes = nodes.withColumn("loose", has_main & (F.col("agent") != "main") & F.col("via").isNull())
    edges = a.dispatches.where("item_id is not null and agent is not null").groupBy("session").agg(F.count("*").alias("edges"))
    totals = nodes.groupBy("session").agg(F.count("*").alias("agents"), F.count_if("loose").alias("loose"), F.sum("listed_tokens").alias("listed_tokens"), F.sum("attached_tokens").alias("attached_tokens"), F.sum("executions").alias("executions"))
    return {"nodes": nodes, "attachments": attachments, "totals": totals.join(edges, "session", "left").fillna(0, ["edges"])}


def co_loads(a: Audit, declared: DataFrame | None = None) -> dict[str, DataFrame]:
    """Skills that agents of all sessions held together, the declared names (a, b of ``declared`` edges) they belong to, and diff."""
    pairs = a.observations.where(F.col("kind").isin(ATTACHED)).select(F.struct(*SA).alias("agent"), "skill_id")
    if declared is None:
        return {"edges": pairing.co_load_edges(pairs, "agent", "skill_id")}
    return pairing.library_report(declared, pairs, "agent", "skill_id")


def gap_report(a: Audit, catalog: DataFrame, judgments: DataFrame, judge_configured: bool = True) -> tuple[DataFrame, DataFrame]:
    """The candidates for a judge, and the report of each session. judgments: session, skill_name, triggered, error."""
    counted = gaps.counts(a.observations, ["session"])
    aliases = a.observations.where("raw_id <> skill_id").select("session", "skill_id", F.col("raw_id").alias("alias")).distinct()
    names = gaps.names_of(counted, ["session"], aliases)
    matched = gaps.in_catalog(counted, names, catalog, ["session"])
    said = a.items.where("kind = 'user_message' and agent = 'main'").select("session", "text")
    open_ = gaps.candidates(matched, names, said, ["session"])
    return open_, gaps.report(matched, open_, catalog, judgments, ["session"], judge_configured=judge_configured)


def bundle(a: Audit, declared: DataFrame | None = None) -> dict[str, DataFrame]:
    """All analyses of an audit under their names, lazy."""
    out = {
        "skill_audit": skill_audit(a), "context_organization": context_organization(a), "repeated_items": repeated_items(a), "exact_resends": exact_resends(a), "short_lived": short_lived(a),
        "skill_loads": load_costs(a), "load_totals": load_totals(a), "dispatches": a.dispatches, "subagent_returns": subagent_returns(a), "process": process_signature(a), "repeats": repeats(a), "usage": usage(a),
    }
    out |= {f"tree_{k}": v for k, v in skill_tree(a).items()}
    return out | {f"library_{k}": v for k, v in co_loads(a, declared).items()}


def session_figures(a: Audit, events: DataFrame) -> DataFrame:
    """A row for each session with what bills and fleets are made of. events: as timeline.in_order gives them."""
    from tracelake.model import timeline

    parted = timeline.turn_parts(events)
    grown = parted.where("comparable").groupBy("session").agg(F.sum("added").alias("growth"), F.sum("system_added").alias("residual"))
    extra = repeats(a).where("class is not null")
    extra = extra.groupBy("session").agg(F.sum("tokens").alias("repeat_extra"), F.coalesce(F.sum(F.when(F.col("class") == "post_compaction", F.col("tokens"))), F.lit(0)).alias("post_compaction"))
    back = subagent_returns(a).groupBy("session").agg(F.count("*").alias("dispatches"), F.coalesce(F.sum("return_tokens"), F.lit(0)).alias("return_tokens"), F.count_if(F.col("flags") != "").alias("flagged"))
    used = usage(a).select("session", "output", "cache_hit_rate").join(a.records.where("usage is not null").groupBy("session").agg(F.count("*").alias("usage_records")), "session")
    begun = timeline.compactions(events).groupBy("session").agg(F.count("*").alias("compactions"))
    how = process_signature(a).select("session", "style", "signal")
    said = events.where("origin = 'main' and type = 'TurnBegin'").groupBy("session").agg(F.count("*").alias("turns"))
    out = events.select("session").distinct()
    for part in (said, how, grown, extra, listings(a).select("session", "listing_extra"), load_totals(a), back, used, begun, timeline.verdicts(events).select("session", "verdict")):
        out = out.join(part, "session", "left")
    return out.fillna(0, ["turns", "signal", "compactions"])


def bill(a: Audit, events: DataFrame) -> DataFrame:
    """The rows of each session's bill."""
    return billing.cost_rows(session_figures(a, events), ["session"])


def repeats(a: Audit) -> DataFrame:
    """Classes of results that came again: after a compaction, by polling, or for no reason that is seen."""
    calls = a.items.where("kind = 'tool_call'").groupBy(*SA, "tool_id").agg(F.max_by("name", F.struct("seq", "part_index")).alias("tool"))
    r = a.items.where((F.col("kind") == "tool_result") & (F.col("size_chars") >= REPEAT_CHARS)).select(*SA, "seq", "part_index", "tool_id", "ts", "sha1", "tokens", "size_chars")
    r = r.join(calls, [*SA, "tool_id"], "left").withColumn("place", F.struct("agent", "seq", "part_index"))
    w = a.compactions.where("agent = 'main' and ts is not null").select("session", F.col("ts").alias("window_start"), F.col("ts").alias("window_end"))
    return growth.classify_occurrences(r, w, ["session", "sha1"], chars="size_chars", tie="place")


def usage(a: Audit) -> DataFrame:
    u = a.records.where("usage is not null")
    f = lambda c: F.col(f"usage.{c}")
    return growth.usage_totals(u, ["session"], f("input_other"), f("cache_read"), f("cache_creation"), f("output"))


def hash_runs(events: DataFrame) -> DataFrame:
    """Runs of equal prompt and tool hashes; a hash that is missing skips only its own kind."""
    h = events.where("type = 'LLMRequest'").select("session", "seq", F.explode(F.create_map(F.lit("system"), "system_prompt_hash", F.lit("tools"), "tools_hash")).alias("what", "hash"))
    return islands.value_runs(h, ["session", "what"], "hash", ["seq"])


def runtime_facts(events: DataFrame) -> DataFrame:
    """The last model, context window and leaf of each session that are known."""
    last = lambda c, t: F.max_by(c, F.when((F.col("type") == t) & F.col(c).isNotNull(), F.struct("seq", "part"))).alias(c)
    return events.where("origin = 'main'").groupBy("session").agg(last("model", "RuntimeConfig"), last("context_window", "RuntimeConfig"), last("leaf_uuid", "ActiveLeaf"))


def window_shares(a: Audit, facts: DataFrame) -> DataFrame:
    """Shares of the context window that the main agent's last call filled, by bucket and unexplained; nothing without a window."""
    w = Window.partitionBy("session").orderBy(F.desc("first_seq"))
    last = a.calls.where("agent = 'main'").withColumn("_n", F.row_number().over(w)).where("_n = 1").join(facts.where("context_window > 0"), "session")
    share = lambda c: F.bround(F.col(c) / F.col("context_window"), 4).alias(c.removesuffix("_tokens"))
    return last.select("session", *[share(f"{b}_tokens") for b in BUCKETS], share("unattributed"), share("anchor"))
