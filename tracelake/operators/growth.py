"""Growth of context from turn to turn, its verdict, repeats of content, usage series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the analyses.
ACCELERATING, LEAST_TURNS = 0.2, 4
POLL_SECONDS, POLL_CHARS = 120, 2000
SAWTOOTH = 0.75
TOP_REPEATS = 10


def turn_growth(turns: DataFrame, keys: Sequence[str], order: str = "turn_no", context: str = "context", crossed: str = "crossed") -> DataFrame:
    """``turns`` with added (the next turn's context less this one's; null for the last) and comparable."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = turns.withColumn("added", F.lead(context).over(w) - F.col(context))
    return out.withColumn("comparable", F.coalesce((F.col("added") >= 0) & ~F.col(crossed), F.lit(False)))


def turn_parts(grown: DataFrame, parts: DataFrame, keys: Sequence[str], kinds: Sequence[str], turn: str = "turn_no", kind: str = "bucket", tokens: str = "tokens") -> DataFrame:
    """``grown`` with <kind>_added of each of ``kinds``, what was seen to enter in the turn, and system_added, what grew beyond that
    (never below 0). Only comparable turns have them; others have nulls."""
    sums = parts.groupBy(*keys, turn).agg(*[F.sum(F.when(F.col(kind) == k, F.col(tokens))).alias(f"_{k}") for k in kinds])
    j = grown.join(sums, [*keys, turn], "left")
    seen = {f"{k}_added": F.when(F.col("comparable"), F.coalesce(F.col(f"_{k}"), F.lit(0))) for k in kinds}
    j = j.withColumns(seen)
    rest = F.when(F.col("comparable"), F.greatest(F.lit(0), F.col("added") - sum(F.col(c) for c in seen)))
    return j.withColumn("system_added", rest).select(*grown.columns, *seen, "system_added")


def part_totals(parted: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """keys, bucket, bucket_tokens and share (6 places): sums of turn_parts over comparable turns; nothing where they are all 0."""
    sums = parted.groupBy(*keys).agg(*[F.coalesce(F.sum(f"{k}_added"), F.lit(0)).cast("long").alias(k) for k in (*kinds, "system")])
    long = sums.unpivot(list(keys), [*kinds, "system"], "bucket", "bucket_tokens")
    long = long.withColumn("_all", F.sum("bucket_tokens").over(Window.partitionBy(*keys))).where("_all > 0")
    return long.select(*keys, "bucket", "bucket_tokens", F.round(F.col("bucket_tokens") / F.col("_all"), 6).alias("share"))


def growth_verdict(grown: DataFrame, keys: Sequence[str], order: str = "turn_no") -> DataFrame:
    """keys, n_turns, relative_slope (6 places) and verdict: the slope of added over the turn number, relative to its mean.

    The slope comes from whole-number sums, so it is the same on any engine.
    """
    c = grown.where("comparable").select(*keys, F.col(order).cast("double").alias("x"), F.col("added").cast("double").alias("y"))
    s = c.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    every = grown.select(*keys).distinct().join(s, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(low != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / low).otherwise(F.lit(0.0))
    mean = F.col("sy") / F.when(F.col("n") > 0, F.col("n"))
    relative = F.when(F.col("n") >= LEAST_TURNS, F.round(slope / F.when(mean == 0, F.lit(1.0)).otherwise(mean), 6))
    verdict = (
        F.when(F.col("n") < LEAST_TURNS, F.concat(F.lit("insufficient data ("), F.col("n").cast("string"), F.lit(" turns)")))
        .when(F.col("rel") > ACCELERATING, "accelerating").when(F.col("rel") < -ACCELERATING, "sublinear").otherwise("linear")
    )
    return every.withColumn("rel", relative).select(*keys, F.col("n").alias("n_turns"), F.col("rel").alias("relative_slope"), verdict.alias("verdict"))


def classify_occurrences(rows: DataFrame, windows: DataFrame, content: Sequence[str], ts: str = "ts", tool: str = "tool", chars: str = "chars", tie: str = "seq") -> DataFrame:
    """``rows`` with occurrence (1 is the first) and class, from the pair with the occurrence before it.

    windows: window_start, window_end by the columns of ``content`` that it shares; a window that overlaps the open interval
    between the two occurrences makes the later one post_compaction. A poll takes a tool that is known. Where there is no window at
    all, nothing tells whether a compaction lies between: what is neither is unclassified, not no_compaction.
    """
    w = Window.partitionBy(*content).orderBy(F.col(ts).asc_nulls_last(), tie)
    r = rows.withColumns({"occurrence": F.row_number().over(w).cast("long"), "_prev": F.lag(ts).over(w), "_prev_tool": F.lag(tool).over(w), "_prev_any": F.lag(F.lit(1)).over(w)})
    shared = [c for c in content if c in windows.columns]
    # the latest window that starts before this occurrence overlaps if it ends after the one before: keep the latest end so far
    ends = windows.select(*shared, F.col("window_start").alias("_at"), F.col("window_end").alias("_end"), F.lit(0).alias("_rank"))
    asks = r.withColumns({"_at": F.col(ts), "_rank": F.lit(-1)})
    both = ends.unionByName(asks, allowMissingColumns=True)
    upto = Window.partitionBy(*shared).orderBy(F.col("_at").asc_nulls_last(), "_rank").rowsBetween(Window.unboundedPreceding, 0)
    any_window = F.max(F.col("_rank") == 0).over(Window.partitionBy(*shared))
    seen = both.withColumns({"_latest": F.max("_end").over(upto), "_known": any_window}).where("_rank = -1")
    compacted = F.coalesce(F.col("_latest") > F.col("_prev"), F.lit(False))
    same_tool = F.coalesce(F.col("_prev_tool") == F.col(tool), F.lit(False))
    label = (
        F.when(F.col("_prev_any").isNull(), F.lit(None).cast("string"))
        .when(F.col(ts).isNull() | F.col("_prev").isNull(), "unclassified")
        .when(compacted, "post_compaction")
        .when((F.col(ts) - F.col("_prev") <= POLL_SECONDS) & (F.col(chars) < POLL_CHARS) & same_tool, "poll")
        .when(F.col("_known"), "no_compaction")
        .otherwise("unclassified")
    )
    return seen.withColumn("class", label).select(*rows.columns, "occurrence", "class")


def repeats(classed: DataFrame, content: Sequence[str], tokens: str = "tokens", tool: str = "tool") -> DataFrame:
    """Content met more than once: n, extra_tokens (all but the first) and tool, if it is one for all occurrences."""
    kinds = F.collect_set(F.coalesce(F.col(tool), F.lit("∅")))
    g = classed.groupBy(*content).agg(F.count("*").alias("n"), F.max_by(tokens, -F.col("occurrence")).alias("_tokens"), kinds.alias("_tools"))
    only = F.when((F.size("_tools") == 1) & (F.element_at("_tools", 1) != "∅"), F.element_at("_tools", 1))
    return g.where("n > 1").select(*content, "n", ((F.col("n") - 1) * F.col("_tokens")).alias("extra_tokens"), only.alias("tool"))


def sawtooth(series: DataFrame, keys: Sequence[str], order: Sequence[str], prompt: str = "prompt", cached: str = "cached") -> DataFrame:
    """Rows where the prompt falls below three quarters of the one before and nothing was cached, with prev_prompt."""
    w = Window.partitionBy(*keys).orderBy(*order)
    s = series.withColumn("prev_prompt", F.lag(prompt).over(w))
    return s.where((F.col("prev_prompt") > 0) & (F.col(prompt) < SAWTOOTH * F.col("prev_prompt")) & (F.col(cached) == 0))


def usage_totals(rows: DataFrame, keys: Sequence[str], other: Column, read: Column, creation: Column, output: Column) -> DataFrame:
    """Sums and the cache hit rate: cached reads in all input, null if there is none."""
    g = rows.groupBy(*keys).agg(F.sum(other).alias("input_other"), F.sum(read).alias("cache_read"), F.sum(creation).alias("cache_creation"), F.sum(output).alias("output"))
    every = F.col("input_other") + F.col("cache_read") + F.col("cache_creation")
    return g.withColumn("cache_hit_rate", F.bround(F.try_divide(F.col("cache_read"), every), 4))
