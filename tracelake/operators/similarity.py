"""Near-duplicate bodies and descriptions by shared shingles: an inverted index of rare shingles, then exact counts.

Equal sets are one class, represented by its least id; pairs are between representatives, so copies never multiply. A set
offers only its rarest shingles to the index, as many as a pair at the threshold must share at least one of; a shingle that a
third of all sets hold is thus offered only by sets that hold little else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import let
from tracelake.operators.graph import cut

#: Fixed values of the catalog audit: lines and words in a shingle, least containment and least Jaccard index.
LINES, WORDS, CONTAINMENT, JACCARD = 3, 3, 0.6, 0.8


def windows(parts: Column, k: int, glue: str) -> Column:
    """Distinct 64-bit codes of all k consecutive parts; fewer parts: each part by itself."""

    def of(p: Column) -> Column:
        wide = F.transform(F.sequence(F.lit(1), F.size(p) - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(p, i, k), glue)))
        return F.when(F.size(p) >= k, wide).otherwise(F.transform(p, lambda x: F.xxhash64(x)))

    return F.array_distinct(let(parts, of))


def body_lines(text: Column) -> Column:
    """Lines without markdown signs at their beginning, spaces joined to one, without empty ones."""
    line = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[ \t]*(?:[#>*+-]|\d+\.)+[ \t]*", ""), r"[ \t\r\f\x0B]+", " "))
    return F.filter(F.transform(F.split(text, "\n", -1), line), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+", -1), lambda s: s != "")


def classes(sets: DataFrame, node: str = "id", shingles: str = "shingles") -> DataFrame:
    """node, class_id: the least node with the same set; nodes without shingles have none and are left out."""
    keyed = sets.where(F.size(shingles) > 0).select(F.col(node).alias("node"), F.sha2(F.array_join(F.array_sort(F.col(shingles).cast("array<string>")), ","), 256).alias("_key"))
    least = keyed.groupBy("_key").agg(F.min("node").alias("class_id"))
    return keyed.join(least, "_key").select("node", "class_id")


def similar_pairs(sets: DataFrame, least: float, by: str, node: str = "id", shingles: str = "shingles") -> DataFrame:
    """a < b, shared, n_a, n_b, score of all pairs of classes with a score of ``least`` or more.

    by: containment (shared over the smaller set) or jaccard (shared over the union).
    """
    chosen = classes(sets, node, shingles).select(F.col("class_id").alias(node)).distinct()
    one = cut(sets.join(chosen, node, "left_semi").groupBy(F.col(node).alias("_n")).agg(F.first(shingles).alias("_set")))
    each = one.select("_n", F.size("_set").cast("long").alias("_size"), F.explode("_set").alias("_s"))
    often = each.groupBy("_s").agg(F.count("*").alias("_df")).where("_df > 1")  # what one set alone holds makes no pair
    ranked = each.join(often, "_s").groupBy("_n", "_size").agg(F.array_sort(F.collect_list(F.struct("_df", "_s"))).alias("_by"))
    # of the rarest shingles, those that are in no other set come first: they use up places of the offer
    offer = F.col("_size") - F.ceil(F.col("_size") * least - 1e-9) + 1 - (F.col("_size") - F.size("_by"))
    offered = ranked.where(offer > 0).select("_n", "_size", F.explode(F.slice("_by", F.lit(1), offer.cast("int"))["_s"]).alias("_s"))
    x = offered.select(F.col("_n").alias("_p"), F.col("_size").alias("_np"), "_s")
    smaller = (F.col("_np") < F.col("_nq")) | ((F.col("_np") == F.col("_nq")) & (F.col("_p") < F.col("_q")))
    y = (each if by == "containment" else offered).select(F.col("_n").alias("_q"), F.col("_size").alias("_nq"), "_s")
    found = x.join(y, "_s").where(smaller)
    if by == "jaccard":
        found = found.where(F.col("_np") >= F.col("_nq") * least - 1e-9)
    found = found.select("_p", "_q", "_np", "_nq").distinct()
    left = one.select(F.col("_n").alias("_p"), F.col("_set").alias("_sp"))
    right = one.select(F.col("_n").alias("_q"), F.col("_set").alias("_sq"))
    both = found.join(left, "_p").join(right, "_q").withColumn("shared", F.size(F.array_intersect("_sp", "_sq")).cast("long"))
    whole = F.col("_np") if by == "containment" else F.col("_np") + F.col("_nq") - F.col("shared")
    first = F.col("_p") < F.col("_q")
    return both.where(F.col("shared") / whole >= least).select(
        F.least("_p", "_q").alias("a"),
        F.greatest("_p", "_q").alias("b"),
        "shared",
        F.when(first, F.col("_np")).otherwise(F.col("_nq")).alias("n_a"),
        F.when(first, F.col("_nq")).otherwise(F.col("_np")).alias("n_b"),
        F.round(F.col("shared") / whole, 6).alias("score"),
    )
