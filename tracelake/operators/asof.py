"""As-of joins by one sort of both sides, forward and backward, and the span that holds a place or comes next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, take: Sequence[str], direction: str = "backward", ties: Sequence[str] = ()) -> DataFrame:
    """``left`` with the columns ``take`` of the nearest row of ``right`` at or before (backward) or at or after (forward) it.

    Of right rows with equal ``on`` the backward join takes the last by ``ties``, the forward join the first. Both sides are
    sorted once; nothing is compared pairwise.
    """
    struct = F.struct(*take)
    r = right.select(*keys, F.col(on).alias("_on"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)], struct.alias("_take")).withColumn("_left", F.lit(None).cast("boolean"))
    packed = F.struct(*left.columns)
    x = left.select(*keys, F.col(on).alias("_on"), packed.alias("_row")).withColumn("_left", F.lit(True))
    both = r.unionByName(x, allowMissingColumns=True)
    order = ["_on", F.col("_left").isNotNull() if direction == "backward" else F.col("_left").isNull(), *[f"_t{i}" for i in range(len(ties))]]
    w = Window.partitionBy(*keys).orderBy(*order)
    if direction == "backward":
        found = F.last("_take", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("_take", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("_found", found).where("_left").select("_row.*", *[F.col(f"_found.{t}").alias(t) for t in take])


def holding_or_next(places: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, take: Sequence[str], last: str = "last_seq") -> DataFrame:
    """``places`` with ``take`` of the span that holds them, else of the next one: spans are disjoint, so it is the first that ends
    at or after the place."""
    ends = spans.select(*keys, F.col(last).alias(at), *take)
    return asof(places, ends, keys, at, take, "forward")
