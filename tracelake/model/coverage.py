"""What an audit knows, estimates and lacks, by session: absent evidence is counted, not left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model.session import Audit


def fields(a: Audit) -> DataFrame:
    """session, field, fact, est, missing: facts of calls, and estimated sizes of items."""
    names = {"anchor": "anchor", "context_usage_ratio": "usage.ratio", "request_id": "usage.request_id", "credits": "usage.credits"}
    known = a.calls.groupBy("session").agg(F.count("*").alias("n"), *[F.count(c).alias(k) for k, c in names.items()])
    long = known.unpivot(["session", "n"], list(names), "field", "fact").select("session", "field", "fact", F.lit(0).cast("long").alias("est"), (F.col("n") - F.col("fact")).alias("missing"))
    est = a.items.groupBy("session").agg(F.count("*").alias("est")).select("session", F.lit("tokens_est").alias("field"), F.lit(0).cast("long").alias("fact"), "est", F.lit(0).cast("long").alias("missing"))
    return long.unionByName(est)


def sessions(a: Audit) -> DataFrame:
    """A row for each session: calls with an anchor ("n/m"), agents by how their requests are known, records in no call, items by
    human hand, stamps that were withheld outside the main agent, distinct leads and the share that no rule fits."""
    anchored = a.calls.groupBy("session").agg(F.concat_ws("/", F.count("anchor").cast("string"), F.count("*").cast("string")).alias("requests_with_anchor"), F.sum("n_records").alias("grouped"))
    tier = lambda t: F.count_if(F.col("tier") == t).alias(f"tier{t}")
    tiers = a.agents.groupBy("session").agg(tier(1), tier(2), tier(3))
    spoke = a.records.groupBy("session").agg(F.count_if(F.col("kind") == "assistant").alias("spoke"))
    human = a.items.groupBy("session").agg(F.count("human").alias("human_stamped"))
    withheld = a.records.where("ref.human_text is not null and agent <> 'main'").groupBy("session").agg(F.count("*").alias("human_dropped"))
    leads = a.interventions.groupBy("session").agg(F.count_distinct("lead_sha1").alias("leads"), F.count_distinct(F.when(F.col("label") == "unclassified", F.col("lead_sha1"))).alias("_none"))
    j = tiers.join(anchored, "session", "left").join(spoke, "session", "left").join(human, "session", "left").join(withheld, "session", "left").join(leads, "session", "left")
    return j.select("session", F.coalesce("requests_with_anchor", F.lit("0/0")).alias("requests_with_anchor"), "tier1", "tier2", "tier3", (F.coalesce("spoke", F.lit(0)) - F.coalesce("grouped", F.lit(0))).alias("ungroupable"),
                    F.coalesce("human_stamped", F.lit(0)).alias("human_stamped"), F.coalesce("human_dropped", F.lit(0)).alias("human_dropped"), F.coalesce("leads", F.lit(0)).alias("leads"),
                    F.bround(F.try_divide(F.col("_none"), F.col("leads")), 4).alias("residue"))


def unknown_channels(a: Audit) -> DataFrame:
    return a.items.where("kind = 'unknown'").groupBy("session", "channel").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


# What the rich format is known not to hold; of other formats nothing is claimed.
RICH_LACKS = ("no_system_channel", "no_prefix_hashes")


def notes(a: Audit, events: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """session, place, note, subject: what a reader of an audit should know, in order. Notes on the format come first, then agents whose
    requests aren't known (ungroupable: their records are in no call), then what became of child chats.

    chats: session, available, reason, children, synthesized, rows, decrypt_failures, skipped, where an editor's database was asked for."""
    rich = events.where("format = 'rich'").select("session").distinct()
    lacks = F.posexplode(F.array(*[F.lit(x) for x in RICH_LACKS])).alias("_k", "note")
    rows = rich.select("session", lacks).select("session", F.struct(F.lit(0).alias("group"), F.col("_k").cast("string").alias("of")).alias("_at"), "note", F.lit("").alias("subject"))
    third = a.agents.where("tier = 3").select("session", F.struct(F.lit(1).alias("group"), F.col("agent").alias("of")).alias("_at"), F.lit("ungroupable").alias("note"), F.col("agent").alias("subject"))
    rows = rows.unionByName(third)
    if chats is not None:
        counts = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("children", "synthesized", "rows", "decrypt_failures", "skipped")])
        told = F.when(F.col("available"), counts).otherwise(F.coalesce("reason", F.lit("")))
        rows = rows.unionByName(chats.select("session", F.struct(F.lit(2).alias("group"), F.lit("").alias("of")).alias("_at"), F.when(F.col("available"), "child_chats").otherwise("child_chats_unavailable").alias("note"), told.alias("subject")))
    place = F.row_number().over(Window.partitionBy("session").orderBy("_at")).cast("long")
    return rows.withColumn("place", place).select("session", "place", "note", "subject")
