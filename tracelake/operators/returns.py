"""What children of a dispatch did, and what of it came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a return of so many tokens is bloated.
BLOAT_TOKENS = 2000


def subagent_returns(dispatches: DataFrame, results: DataFrame, work: DataFrame, key: str, tokens: str = "tokens", digest: str = "digest", order: str = "seq") -> DataFrame:
    """key, process_tokens, return_tokens, ratio (return over process, 4 places, null unless both are above 0), echo (the return's
    content also occurs in the child's work) and flags. Unknown stays null."""
    back = results.groupBy(key).agg(F.min_by(F.struct(F.col(tokens).alias("t"), F.col(digest).alias("d")), order).alias("_r"))
    done = work.groupBy(key).agg(F.sum(tokens).alias("process_tokens"))
    j = dispatches.select(key).distinct().join(back, key, "left").join(done, key, "left")
    seen = work.select(key, F.col(digest).alias("_d")).distinct().withColumn("_echo", F.lit(True))
    j = j.withColumns({"return_tokens": F.col("_r.t"), "_d": F.col("_r.d")}).join(seen, [key, "_d"], "left")
    some = (F.col("process_tokens") > 0) & (F.col("return_tokens") > 0)
    flags = F.array_compact(
        F.array(
            F.when(F.col("process_tokens").isNull(), "process_unavailable"),
            F.when(F.col("return_tokens") >= BLOAT_TOKENS, "bloated"),
            F.when(F.col("_echo"), "echo"),
        )
    )
    return j.select(key, "process_tokens", "return_tokens", F.when(some, F.bround(F.col("return_tokens") / F.col("process_tokens"), 4)).alias("ratio"),
                    F.coalesce("_echo", F.lit(False)).alias("echo"), F.array_join(flags, ",").alias("flags"))
