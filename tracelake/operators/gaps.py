"""What was offered and never used: joins of observed skills with a catalog, candidates for a judge, and a report of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import casefold
from tracelake.operators.mentions import mentions


def counts(observations: DataFrame, keys: Sequence[str], skill: str = "skill_id", kind: str = "kind") -> DataFrame:
    """keys, skill, listed, bodies, stubs, executed and loaded (bodies and stubs): how often each skill was seen in each way."""
    n = lambda k, name: F.count_if(F.col(kind) == k).alias(name)
    g = observations.groupBy(*keys, skill).agg(n("listing", "listed"), n("body", "bodies"), n("stub", "stubs"), n("execution", "executed"))
    return g.withColumn("loaded", F.col("bodies") + F.col("stubs"))


def names_of(counted: DataFrame, keys: Sequence[str], aliases: DataFrame | None = None, skill: str = "skill_id") -> DataFrame:
    """keys, skill, key, place: the case-folded names that stand for a skill, its id first, then its aliases in order."""
    own = counted.select(*keys, skill, casefold(F.col(skill)).alias("key"), F.lit(0).alias("place"))
    if aliases is not None:
        w = Window.partitionBy(*keys, skill).orderBy("alias")
        own = own.unionByName(aliases.select(*keys, skill, casefold(F.col("alias")).alias("key"), F.row_number().over(w).alias("place")))
    return own.where("key <> ''")


def in_catalog(counted: DataFrame, names: DataFrame, catalog: DataFrame, keys: Sequence[str], skill: str = "skill_id", name: str = "name") -> DataFrame:
    """``counted`` with catalog_name: the entry that the first of its names meets, null if none does. Of entries whose names differ
    in case alone the least stands for all."""
    entries = catalog.groupBy(casefold(F.col(name)).alias("key")).agg(F.min(name).alias("catalog_name"))
    first = names.join(entries, "key").groupBy(*keys, skill).agg(F.min_by("catalog_name", "place").alias("catalog_name"))
    return counted.join(first, [*keys, skill], "left")


def candidates(matched: DataFrame, names: DataFrame, said: DataFrame, keys: Sequence[str], skill: str = "skill_id", text: str = "text") -> DataFrame:
    """keys, skill, catalog_name and candidate of skills that were listed, never loaded and never executed. A candidate is in the
    catalog, and one of its names occurs in what a person said; the others were filtered out before any judge. Names meet a session's
    texts by their first characters, and only what meets is looked for in the whole text."""
    open_ = matched.where("listed > 0 and loaded = 0 and executed = 0")
    asked = open_.where("catalog_name is not null").select(*keys, skill).join(names, [*keys, skill]).select(*keys, skill, "key")
    lines = said.select(*keys, casefold(F.col(text)).alias("_text")).where("_text <> ''").withColumn("_id", F.sha1("_text")).dropDuplicates([*keys, "_id"])
    met = mentions(lines, asked, "_id", "_text", "key", keys).select(*keys, "key").distinct()
    found = asked.join(met, [*keys, "key"]).select(*keys, skill, F.lit(True).alias("candidate")).distinct()
    return open_.join(found, [*keys, skill], "left").select(*keys, skill, "catalog_name", F.coalesce("candidate", F.lit(False)).alias("candidate"))


def missed_triggers(matched: DataFrame, judgments: DataFrame, keys: Sequence[str], skill: str = "skill_id") -> DataFrame:
    """``judgments`` (keys, skill_name, triggered, error) that say a skill should have been loaded, with the skill whose catalog name
    they give; the last by id if several match, null if none does."""
    known = matched.where("catalog_name is not null").groupBy(*keys, F.lower("catalog_name").alias("_name")).agg(F.max(skill).alias(skill))
    yes = judgments.where("error is null and triggered").withColumn("_name", F.lower("skill_name"))
    return yes.join(known, [*keys, "_name"], "left").drop("_name")


def report(matched: DataFrame, open_: DataFrame, catalog: DataFrame, judgments: DataFrame, keys: Sequence[str], skill: str = "skill_id", name: str = "name", judge_configured: bool = True) -> DataFrame:
    """A row for each of ``keys``: how the join went (matched, ir_only, catalog_only), sizes of the sets (listed, loaded, executed),
    listed_unloaded and loaded_unused (sorted ids), candidates, prefiltered, missed, judge_errors, over_limit (candidates that no
    judgment reached) and unjudged, their sum with the errors; without a judge all that is open."""
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(skill))))
    g = matched.groupBy(*keys).agg(
        F.count("catalog_name").alias("matched"),
        ids(F.col("catalog_name").isNull()).alias("ir_only"),
        F.count_distinct(casefold(F.col("catalog_name"))).alias("_names"),
        *[F.count_if(F.col(c) > 0).alias(c) for c in ("listed", "loaded", "executed")],
        ids(F.expr("listed > 0 and loaded = 0 and executed = 0")).alias("listed_unloaded"),
        ids(F.expr("bodies > 0 and executed = 0")).alias("loaded_unused"),
    )
    entries = catalog.agg(F.count_distinct(casefold(F.col(name))).alias("_entries"))
    g = g.crossJoin(F.broadcast(entries)).withColumn("catalog_only", F.col("_entries") - F.col("_names")).drop("_entries", "_names")  # one row
    o = open_.groupBy(*keys).agg(F.count_if("candidate").alias("candidates"), F.count_if(~F.col("candidate")).alias("prefiltered"))
    j = judgments.groupBy(*keys).agg(F.count("*").alias("_judged"), F.count("error").alias("judge_errors"), F.count_if(F.col("error").isNull() & F.col("triggered")).alias("missed"))
    g = g.join(o, list(keys), "left").join(j, list(keys), "left").fillna(0, ["candidates", "prefiltered", "_judged", "judge_errors", "missed"])
    g = g.withColumn("over_limit", F.greatest(F.lit(0).cast("long"), F.col("candidates") - F.col("_judged"))).drop("_judged")
    unjudged = F.col("prefiltered") + F.col("over_limit") + F.col("judge_errors") if judge_configured else F.size("listed_unloaded").cast("long")
    return g.withColumn("unjudged", unjudged)
