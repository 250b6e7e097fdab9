"""A ledger of loads: stubs that announce a body, bodies that arrive, and what became of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_ledger(entries: DataFrame, keys: Sequence[str], what: str, seq: str = "seq", kind: str = "kind", gone: str = "gone_seq") -> DataFrame:
    """A row for each load: keys, what, load_kind (load, reload, unavailable), opened_seq, body_seq, load_no.

    ``entries`` are stubs and bodies (kind) of ``what``. A body right after a stub is its load; a stub that no body follows is
    unavailable; another body is a load if it is the first, a reload if the body before it is gone by some boundary, else
    redundant and no row.
    """
    w = Window.partitionBy(*keys, what).orderBy(seq)
    bodies = w.rowsBetween(Window.unboundedPreceding, -1)
    e = entries.withColumns(
        {
            "_before": F.lag(kind).over(w),
            "_after": F.lead(kind).over(w),
            "_opened": F.lag(seq).over(w),
            "_earlier": F.count(F.when(F.col(kind) == "body", 1)).over(bodies),
            "_last": F.last(F.when(F.col(kind) == "body", F.struct(F.col(gone).alias("gone"))), ignorenulls=True).over(bodies),
        }
    )
    marked = F.col("_before") == "stub"
    load_kind = (
        F.when((F.col(kind) == "stub") & ~(F.coalesce("_after", F.lit("")) == "body"), "unavailable")
        .when((F.col(kind) == "body") & (marked | (F.col("_earlier") == 0)), "load")
        .when((F.col(kind) == "body") & F.col("_last.gone").isNotNull(), "reload")
    )
    e = e.withColumn("load_kind", load_kind).where("load_kind is not null")
    e = e.withColumns(
        {
            "opened_seq": F.when((F.col(kind) == "body") & marked, F.col("_opened")).otherwise(F.col(seq)),
            "body_seq": F.when(F.col(kind) == "body", F.col(seq)),
        }
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("opened_seq", seq)).cast("long")
    return e.withColumn("load_no", number).select(*keys, what, "load_kind", "opened_seq", "body_seq", "load_no")


def redundant_bodies(entries: DataFrame, keys: Sequence[str], what: str, seq: str = "seq", kind: str = "kind", gone: str = "gone_seq") -> DataFrame:
    """keys, redundant_bodies: bodies that came without a stub while the one before was still alive; the ledger has no row for them.
    The body they are measured against is the last that made a row, so a redundant one never becomes the base."""
    w = Window.partitionBy(*keys, what).orderBy(seq)
    e = entries.withColumns({"_before": F.lag(kind).over(w), "_earlier": F.count(F.when(F.col(kind) == "body", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    last = F.last(F.when(F.col(kind) == "body", F.struct(F.col(gone).alias("gone"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_last", last).where((F.col(kind) == "body") & (F.col("_earlier") > 0) & (F.coalesce("_before", F.lit("")) != "stub") & F.col("_last.gone").isNull())
    return e.groupBy(*keys).agg(F.count("*").alias("redundant_bodies"))


def load_costs(ledger: DataFrame, bodies: DataFrame, keys: Sequence[str], what: str, seq: str = "seq", tokens: str = "tokens", channel: str = "channel") -> DataFrame:
    """``ledger`` with cost_tokens and channel of the body that each load brought; null for the unavailable."""
    own = bodies.select(*keys, what, F.col(seq).alias("body_seq"), F.col(tokens).alias("cost_tokens"), F.col(channel).alias("channel"))
    return ledger.join(own, [*keys, what, "body_seq"], "left")


def load_rollup(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of each kind."""
    n = lambda k: F.count_if(F.col("load_kind") == k).alias(f"n_{k}")
    return ledger.groupBy(*keys).agg(F.count("*").alias("n_loads"), n("load"), n("reload"), n("unavailable"))


def observation_audit(rows: DataFrame, keys: Sequence[str], kind: str, digest: str, tokens: str, channel: str, order: str) -> DataFrame:
    """keys, listings, listing_tokens, repeat_tokens (listings of a version that was listed before), versions, stubs, bodies,
    executions, channels (distinct, sorted) and version_drift (bodies of more than one version)."""
    nth = F.row_number().over(Window.partitionBy(*keys, kind, digest).orderBy(order))
    r = rows.withColumn("_again", nth > 1)
    of = lambda k: F.col(kind) == k
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(tokens))), F.lit(0))
    versions = lambda k: F.count_distinct(F.when(of(k), F.col(digest)))
    return r.groupBy(*keys).agg(
        F.count_if(of("listing")).alias("listings"),
        total(of("listing")).alias("listing_tokens"),
        total(of("listing") & F.col("_again")).alias("repeat_tokens"),
        versions("listing").alias("versions"),
        F.count_if(of("stub")).alias("stubs"),
        F.count_if(of("body")).alias("bodies"),
        F.count_if(of("execution")).alias("executions"),
        F.array_sort(F.collect_set(channel)).alias("channels"),
        (versions("body") > 1).alias("version_drift"),
    )


def process_style(touched: Column, loaded: Column) -> Column:
    """How a session worked: along workflow files and loads (pipeline), with neither (direct), or mixed."""
    return F.when(touched & loaded, "pipeline").when(~touched & ~loaded, "direct").otherwise("mixed")


def fleet(signatures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions, average turns, tokens and interventions that carry a signal, for each group or, without keys, overall."""
    g = signatures.groupBy(*keys).agg(F.count("*").alias("sessions"), F.sum("turns").alias("_turns"), F.sum("total").alias("total"), F.sum("signal").alias("signal"))
    return g.select(*keys, "sessions", F.round(F.col("_turns") / F.nullif(F.col("sessions"), F.lit(0)), 1).alias("avg_turns"), "total", "signal")


def fleet_report(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions together, by group or overall: sessions, with_usage, avg_turns, avg_cache_hit_rate (of those with usage), sums of
    output, repeat_extra, listing_extra, ceremony (listings shown again and re-reads after compactions), compactions, and
    avg_signal. sessions: turns, cache_hit_rate, output, repeat_extra, post_compaction, listing_extra, compactions, signal."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = sessions.groupBy(*keys).agg(
        F.count("*").alias("sessions"), F.count("cache_hit_rate").alias("with_usage"), F.round(F.sum("turns") / F.count("*"), 1).alias("avg_turns"),
        F.round(F.sum(F.col("cache_hit_rate").cast("decimal(20,4)")).cast("double") / F.nullif(F.count("cache_hit_rate"), F.lit(0)), 3).alias("avg_cache_hit_rate"),
        total("output").alias("output"), total("repeat_extra").alias("repeat_extra"), total("listing_extra").alias("listing_extra"),
        (total("listing_extra") + total("post_compaction")).alias("ceremony"), total("compactions").alias("compactions"), F.round(F.sum("signal") / F.count("*"), 1).alias("avg_signal"),
    )
    return g


def shapes(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, shape, sessions: the first word of each session's growth verdict; unknown without one."""
    return verdicts.groupBy(*keys, F.split(F.coalesce("verdict", F.lit("unknown")), " ")[0].alias("shape")).agg(F.count("*").alias("sessions"))
