"""Contexts of turns from a billed series, windows of compaction, and the bill of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are estimates, by which shares are taken, and the rows that follow them in this order.
ESTIMATES = ["context_growth", "repeat_tax", "skill_load_cost", "subagent_returns"]
OTHERS = ["ceremony", "output", "cache_signal"]


def turn_contexts(turns: DataFrame, series: DataFrame, keys: Sequence[str], ts: str = "ts", turn: str = "turn_no", prompt: str = "prompt", tie: str = "row") -> DataFrame:
    """``turns`` with context: the first prompt in [turn, next turn), else the last known context, else the first prompt, else 0."""
    t = turns.select(*keys, F.col(ts).alias("_ts"), F.col(turn).alias("_turn"), F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast("long").alias("_prompt"))
    s = series.select(*keys, F.col(ts).alias("_ts"), F.lit(None).cast("long").alias("_turn"), F.lit(1).alias("_rank"), F.col(tie).cast("long").alias("_tie"), F.col(prompt).cast("long").alias("_prompt"))
    both = t.unionByName(s)
    order = Window.partitionBy(*keys).orderBy("_ts", "_rank", "_turn", "_tie")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_of": F.last("_turn", ignorenulls=True).over(so_far), "_place": F.row_number().over(order)})
    own = both.where("_prompt is not null").groupBy(*keys, "_of").agg(F.min_by("_prompt", "_place").alias("_own"))
    first = series.groupBy(*keys).agg(F.min_by(prompt, F.struct(ts, tie)).cast("long").alias("_first"))
    j = turns.join(own.withColumnRenamed("_of", turn), [*keys, turn], "left").join(first, list(keys), "left")
    known = F.last("_own", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("context", F.coalesce(known, "_first", F.lit(0).cast("long"))).select(*turns.columns, "context")


def merge_windows(transcript: DataFrame, billed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, window_start, window_end and source: transcript, billed or transcript+billed."""
    every = transcript.withColumn("_s", F.lit("transcript")).unionByName(billed.withColumn("_s", F.lit("billed")))
    g = every.groupBy(*keys, "window_start", "window_end").agg(F.array_join(F.sort_array(F.collect_set("_s"), asc=False), "+").alias("source"))
    return g


def bill(rows: DataFrame, keys: Sequence[str], estimates: Sequence[str], name: str = "row_name", volume: str = "volume") -> DataFrame:
    """``rows`` with share (of the estimates' sum, for estimates only) and place: estimates by volume, then the others by name.

    Estimates and billed numbers never meet in one ratio.
    """
    est = F.col(name).isin(*estimates)
    w = Window.partitionBy(*keys)
    part = F.when(est, F.round(F.col(volume) / F.nullif(F.sum(F.when(est, F.col(volume))).over(w), F.lit(0)), 6))
    order = w.orderBy(est.desc(), F.when(est, -F.col(volume)).otherwise(0), name)
    return rows.withColumns({"share": part, "place": F.row_number().over(order).cast("long")})


def cost_rows(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row_name, volume (tokens, may be null), share, place and subtotal: the rows of each session's bill that apply.

    sessions: a row of each with growth (tokens that contexts grew by), repeat_extra, post_compaction (its part after compactions),
    listing_extra (listings shown again), loads and load_cost, dispatches and return_tokens, usage_records and output; nulls count
    as 0. Shares (4 places) are of the subtotal, the sum of the estimates. Ceremony is a lens: its parts lie in other rows already,
    so it never enters the subtotal, nor does anything measured or billed.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ceremony = n("listing_extra") + n("post_compaction")
    some = lambda c: F.nullif(c, F.lit(0).cast("long"))
    null = F.lit(None).cast("long")
    rows = [
        ("context_growth", n("growth") > 0, n("growth")),
        ("repeat_tax", n("repeat_extra") > 0, n("repeat_extra")),
        ("skill_load_cost", n("loads") > 0, some(n("load_cost"))),
        ("subagent_returns", n("dispatches") > 0, some(n("return_tokens"))),
        ("ceremony", ceremony > 0, ceremony),
        ("output", F.lit(True), F.when(n("usage_records") > 0, n("output"))),
        ("cache_signal", F.lit(True), null),
    ]
    each = F.array_compact(F.array(*[F.when(applies, F.struct(F.lit(name).alias("row_name"), volume.alias("volume"))) for name, applies, volume in rows]))
    long = sessions.select(*keys, F.inline(each))
    est, w = F.col("row_name").isin(ESTIMATES), Window.partitionBy(*keys)
    subtotal = F.coalesce(F.sum(F.when(est, F.col("volume"))).over(w), F.lit(0))
    order = w.orderBy(est.desc(), F.when(est, -F.coalesce("volume", F.lit(0))), F.array_position(F.array(*[F.lit(x) for x in (*ESTIMATES, *OTHERS)]), F.col("row_name")))
    long = long.withColumns({"subtotal": subtotal, "place": F.row_number().over(order).cast("long")})
    return long.withColumn("share", F.when(est, F.round(F.col("volume") / F.nullif(F.col("subtotal"), F.lit(0)), 4)))


def billed_block(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, requests, sums of prompt, completion and cached, and cached_share (4 places): as billed, never mixed with estimates."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total")
    g = series.groupBy(*keys).agg(F.count("*").alias("requests"), total("prompt"), total("completion"), total("cached"))
    return g.withColumn("cached_share", F.round(F.col("cached_total") / F.nullif(F.col("prompt_total"), F.lit(0)), 4))


def routing(sessions: DataFrame, keys: Sequence[str], judged: bool) -> DataFrame:
    """keys, line, value: where to look next. sessions: expected and missing (names that were to be loaded), missed (triggers, told
    only if a judge was asked), coverage (mean over playbooks, null without any) and file_reads."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    lines = [
        ("expect_missing", n("expected") > 0, F.concat(n("missing").cast("string"), F.lit("/"), n("expected").cast("string"))),
        ("judge_missed", F.lit(judged), n("missed").cast("string")),
        ("playbook_coverage", F.col("coverage").isNotNull(), F.format_number("coverage", 2)),
        ("file_reads", n("file_reads") > 0, n("file_reads").cast("string")),
    ]
    each = F.array_compact(F.array(*[F.when(applies, F.struct(F.lit(name).alias("line"), value.alias("value"))) for name, applies, value in lines]))
    return sessions.select(*keys, F.inline(each))
