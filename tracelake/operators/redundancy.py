"""The same content more than once: groups by digest, first mentions, resends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(items: DataFrame, digest: str, item: str, bucket: str, tokens: str, order: str) -> DataFrame:
    """digest, n, n_buckets, cross_bucket, repeat_tokens: all but the first item's tokens."""
    g = items.groupBy(digest).agg(F.count("*").alias("n"), F.count_distinct(bucket).alias("n_buckets"), F.sum(tokens).alias("_sum"), F.min_by(tokens, order).alias("_first"), F.min(item).alias("first_item"))
    return g.where("n >= 2").select(digest, "n", "n_buckets", (F.col("n_buckets") > 1).alias("cross_bucket"), (F.col("_sum") - F.col("_first")).alias("repeat_tokens"), "first_item")


def new_and_repeated(refs: DataFrame, keys: Sequence[str], digest: str, order: Sequence[str]) -> DataFrame:
    """``refs`` with is_new: the first mention of a digest within keys, in order; each later one is injected again."""
    w = Window.partitionBy(*keys, digest).orderBy(*order)
    return refs.withColumn("is_new", F.row_number().over(w) == 1)


def resends(calls: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """keys, digest, n: requests that were sent twice or more."""
    return calls.where(F.col(digest).isNotNull()).groupBy(*keys, digest).agg(F.count("*").alias("n")).where("n >= 2")
