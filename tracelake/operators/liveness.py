"""Which items are alive at which request: ends by boundaries, roll-ups by prefix sums, references by range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gone_after(items: DataFrame, boundaries: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """``items`` with gone_seq: the first boundary of its keys after the item, null if there is none. One sort, no range join."""
    marked = items.withColumn("_b", F.lit(None).cast("long"))
    ends = boundaries.select(*keys, F.col(seq).alias(seq)).withColumn("_b", F.col(seq).cast("long"))
    both = marked.unionByName(ends, allowMissingColumns=True).withColumn("_item", F.col("_b").isNull())
    after = Window.partitionBy(*keys).orderBy(seq).rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("gone_seq", F.min("_b").over(after)).where("_item").drop("_b", "_item")


def alive_sums(items: DataFrame, calls: DataFrame, keys: Sequence[str], buckets: Sequence[str], seq: str = "seq", bucket: str = "bucket", amount: str = "tokens", at: str = "first_seq") -> DataFrame:
    """``calls`` with one sum for each bucket and n_alive: items with seq < at that are not gone at ``at``.

    An item adds its amount after its place and takes it back at gone_seq; a call reads the running sums. So a session of n rows
    costs one sort, where a range join would cost items times calls.
    """
    cols = [*keys, "_at", "_rank", "_bucket", "_amount", "_one"]
    born = items.select(*keys, F.col(seq).alias("_at"), F.lit(2).alias("_rank"), F.col(bucket).alias("_bucket"), F.col(amount).alias("_amount"), F.lit(1).alias("_one"))
    dead = items.where("gone_seq is not null").select(*keys, F.col("gone_seq").alias("_at"), F.lit(0).alias("_rank"), F.col(bucket).alias("_bucket"), (-F.col(amount)).alias("_amount"), F.lit(-1).alias("_one"))
    asks = calls.withColumns({"_at": F.col(at), "_rank": F.lit(1)})
    every = born.select(cols).unionByName(dead.select(cols)).unionByName(asks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{b}_tokens": F.coalesce(F.sum(F.when(F.col("_bucket") == b, F.col("_amount"))).over(w), F.lit(0)) for b in buckets}
    sums["n_alive"] = F.coalesce(F.sum("_one").over(w), F.lit(0))
    return every.withColumns(sums).where("_rank = 1").select(*calls.columns, *sums)


def span_contexts(records: DataFrame, keys: Sequence[str], buckets: Sequence[str], seq: str = "seq", kind: str = "kind", positive: str = "positive", bucket: str = "bucket", amount: str = "tokens") -> DataFrame:
    """keys, span_no, first_seq, last_seq, n_records, anchor (the amount of the last record), <bucket>_tokens and n_alive: what spans()
    and alive_sums() give together where every record is an item and rows of kind ``meta`` are the boundaries.

    An item lives until the next boundary, so what is alive at a place is what came since the last one: a running sum less its value
    there. All of it is one exchange by ``keys`` and one sort by ``seq``.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    pos = F.coalesce((F.col(kind) == "assistant") & F.col(positive), F.lit(False))
    r = records.withColumns({"_used": F.col(kind) != "meta", "_pos": pos})
    after = F.coalesce(F.last(F.when(F.col("_used"), F.col("_pos")), ignorenulls=True).over(before), F.lit(False))
    sums = {f"_{b}": F.coalesce(F.sum(F.when(F.col("_used") & (F.col(bucket) == b), F.col(amount))).over(before), F.lit(0)) for b in buckets}
    sums["_n"] = F.coalesce(F.sum(F.col("_used").cast("long")).over(before), F.lit(0))
    r = r.withColumns({"_starts": F.col("_used") & ((F.col(kind) == "user") | after), **sums})
    lost = {f"{c}_gone": F.coalesce(F.last(F.when(~F.col("_used"), F.col(c)), ignorenulls=True).over(before), F.lit(0)) for c in sums}
    r = r.withColumns({"_grp": F.sum(F.col("_starts").cast("int")).over(so_far), **lost}).where(F.col(kind) == "assistant")
    alive = F.struct(*[(F.col(f"_{b}") - F.col(f"_{b}_gone")).alias(f"{b}_tokens") for b in buckets], (F.col("_n") - F.col("_n_gone")).alias("n_alive"))
    g = r.groupBy(*keys, "_grp").agg(
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("n_records"), F.max_by(amount, seq).alias("anchor"), F.min_by(alive, seq).alias("_alive"), F.bool_or("_pos").alias("_in")
    ).where("_in")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first_seq")).cast("long")
    return g.withColumn("span_no", number).select(*keys, "span_no", "first_seq", "last_seq", "n_records", "anchor", "_alive.*")


def alive_refs(items: DataFrame, calls: DataFrame, keys: Sequence[str], seq: str = "seq", at: str = "first_seq") -> DataFrame:
    """A row for each call and item alive at it; ``items`` as gone_after() gives them.

    An item ends at the first boundary after it, so an item that is alive at a call has the boundary that comes next after the call.
    Both sides are joined on their keys and that boundary, which leaves only the items of the call's own stretch to be tested for being
    before it: twice the rows of the result where calls and items take turns, however many boundaries there are."""
    ends = items.where("gone_seq is not null").select(*keys, F.col("gone_seq").alias(at)).distinct()
    ahead = gone_after(calls, ends, keys, at).withColumnRenamed("gone_seq", "_next")
    cond = F.col("i.gone_seq").eqNullSafe(F.col("c._next")) & (F.col(f"i.{seq}") < F.col(f"c.{at}"))
    for k in reversed(keys):
        cond = (F.col(f"i.{k}") == F.col(f"c.{k}")) & cond
    joined = ahead.alias("c").join(items.alias("i"), cond)
    return joined.select(*[F.col(f"c.{x}") for x in calls.columns], *[F.col(f"i.{x}").alias(f"item_{x}") for x in items.columns if x not in keys])


def first_after_boundary(items: DataFrame, boundaries: DataFrame, stops: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """keys, boundary_seq, n_restored: items between a boundary and the next stop."""
    nothing = F.lit(None).cast("long")
    b = boundaries.select(*keys, seq).withColumns({"_k": F.lit("b")})
    s = stops.select(*keys, seq).withColumns({"_k": F.lit("s")})
    i = items.select(*keys, seq).withColumns({"_k": F.lit("i")})
    w = Window.partitionBy(*keys).orderBy(seq)
    every = b.unionByName(s).unionByName(i)
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    every = every.withColumns(
        {
            "boundary_seq": F.max(F.when(F.col("_k") == "b", F.col(seq)).otherwise(nothing)).over(before),
            "_stop": F.max(F.when(F.col("_k") == "s", F.col(seq)).otherwise(nothing)).over(before),
        }
    )
    kept = every.where("_k = 'i' and boundary_seq is not null and (_stop is null or _stop < boundary_seq)")
    found = kept.groupBy(*keys, "boundary_seq").agg(F.count("*").alias("n_restored"))
    return b.select(*keys, F.col(seq).alias("boundary_seq")).join(found, [*keys, "boundary_seq"], "left").withColumn("n_restored", F.coalesce("n_restored", F.lit(0)))
