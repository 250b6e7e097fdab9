"""The audit of a catalog: sizes, descriptions, duplicates, what loading one entry pulls in, and what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import description_tier, estimate_tokens, local_references, size_tier
from tracelake.operators import graph, similarity


def sizes(catalog: DataFrame) -> DataFrame:
    """name, lines, chars, tokens and tier of each body; entries without a body have nulls, not zeros."""
    has = F.col("text").isNotNull()
    lines = F.when(has, F.size(F.split("text", "\n", -1)))
    return catalog.select("name", lines.alias("lines"), F.length("text").alias("chars"), F.when(has, estimate_tokens(F.col("text"))).alias("tokens"), F.when(has, size_tier(lines)).alias("tier"))


def descriptions(catalog: DataFrame) -> DataFrame:
    return catalog.select("name", F.length("description").alias("chars"), estimate_tokens(F.col("description")).alias("tokens"), description_tier(F.length("description")).alias("tier"))


def duplicates(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of bodies by containment and of descriptions by the Jaccard index, each between representatives of equal ones."""
    bodies = catalog.where("text is not null").select(F.col("name").alias("id"), similarity.windows(similarity.body_lines(F.col("body")), similarity.LINES, "\n").alias("shingles"))
    spoken = catalog.select(F.col("name").alias("id"), similarity.windows(similarity.words(F.col("description")), similarity.WORDS, " ").alias("shingles"))
    return similarity.similar_pairs(bodies, similarity.CONTAINMENT, "containment"), similarity.similar_pairs(spoken, similarity.JACCARD, "jaccard")


def wasted(catalog: DataFrame) -> DataFrame:
    """a, b, score, exact, waste: pairs of like bodies, with the tokens of the smaller one, which need not be there twice. Entries
    whose bodies are equal are exact pairs with the least of their class; pairs that are alike join the least of each class."""
    bodies = catalog.where("text is not null").select(F.col("name").alias("id"), similarity.windows(similarity.body_lines(F.col("body")), similarity.LINES, "\n").alias("shingles"))
    near = similarity.similar_pairs(bodies, similarity.CONTAINMENT, "containment").select("a", "b", "score", F.lit(False).alias("exact"))
    same = similarity.classes(bodies).where("node <> class_id").select(F.col("class_id").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    cost = lambda c: catalog.select(F.col("name").alias(c), estimate_tokens(F.col("text")).alias(f"_{c}"))
    j = near.unionByName(same).join(cost("a"), "a").join(cost("b"), "b")
    return j.select("a", "b", "score", "exact", F.least("_a", "_b").alias("waste"))


def closures(catalog: DataFrame, depth: int = 4, files: DataFrame | None = None) -> DataFrame:
    """root, members, tokens of all bodies reached by ``requires`` in at most ``depth`` steps, unresolved names, and truncated.

    files: name, target, text of the files that bodies refer to (references()); with them also n_files and file_tokens of those that
    members of the closure refer to, each once, and tokens counts them as well. Targets without a text count nothing.
    """
    edges = catalog.select(F.col("name").alias("src"), F.explode("requires").alias("dst"))
    reach = graph.closure(edges, catalog.where(F.size("requires") > 0), root="name", depth=depth)
    known = catalog.select(F.col("name").alias("node"), estimate_tokens(F.col("text")).alias("tokens"), F.size("requires").alias("n_requires"))
    j = reach.join(known, "node", "left")
    # cut short: something at the last step requires what was not reached
    beyond = reach.where(F.col("depth") == depth).join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).join(reach.select("root", "node"), ["root", "node"], "left_anti")
    g = j.groupBy("root").agg(F.count("n_requires").alias("members"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set(F.when(F.col("n_requires").isNull(), F.col("node")))).alias("unresolved"))
    cut_off = beyond.select("root").distinct().withColumn("truncated", F.lit(True))
    g = g.join(cut_off, "root", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    if files is None:
        return g
    found = references(catalog).distinct().join(files.select("name", "target", estimate_tokens(F.col("text")).alias("_t")), ["name", "target"])
    held = reach.join(found, F.col("node") == F.col("name")).groupBy("root").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("_t"), F.lit(0)).alias("file_tokens"))
    g = g.join(held, "root", "left").fillna(0, ["n_files", "file_tokens"])
    return g.withColumn("tokens", F.col("tokens") + F.col("file_tokens"))


def references(catalog: DataFrame) -> DataFrame:
    return catalog.select("name", F.explode(local_references(F.col("body"))).alias("target"))


def summary(catalog: DataFrame) -> DataFrame:
    """One row: skills, discovery and activation tokens, their ratio (null without discovery), failed descriptions, no bodies."""
    g = catalog.agg(
        F.count("*").alias("skills"),
        F.sum(estimate_tokens(F.col("description"))).alias("discovery"),
        F.sum(F.when(F.col("text").isNotNull(), estimate_tokens(F.col("text")))).alias("activation"),
        F.count_if("description_parse_failed").alias("parse_failures"),
        F.count_if(F.col("text").isNull()).alias("no_body"),
    )
    return g.withColumn("ratio", F.round(F.try_divide(F.col("activation"), F.nullif(F.col("discovery"), F.lit(0))), 1))
