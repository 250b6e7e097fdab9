"""A JSON document for each session, and plain-text reports of small tables. Documents are built and written by Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.9"


def json_documents(blocks: Mapping[str, tuple[DataFrame, list[str]]], key: str = "session") -> DataFrame:
    """session and document: for each block (a table, and the columns that order it) a list of its rows. A session that a block
    lacks has an empty list there. Rows of one session meet in one place: sessions are bounded, the corpus is not."""
    out = None
    for name, (df, order) in blocks.items():
        rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("j"))))
        one = df.groupBy(key).agg(F.transform(rows, lambda r: r["j"]).alias(name))
        out = one if out is None else out.join(one, key, "full")
    assert out is not None, "no blocks"
    each = [F.concat(F.lit(f'"{n}":['), F.array_join(F.coalesce(n, F.array().cast("array<string>")), ","), F.lit("]")) for n in blocks]
    # the session as a JSON string: what follows {"s": in its struct
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    return out.select(key, F.concat(F.lit(f'{{"version":"{VERSION}","session":'), name, F.lit(","), F.concat_ws(",", *each), F.lit("}")).alias("document"))


def text_table(df: DataFrame, order: list, top: int = 20) -> str:
    """The first rows in order as aligned text; top 0 shows all, for tables that are known to be small."""
    rows = df.orderBy(*order)
    rows = (rows.limit(top) if top else rows).collect()
    cells = [df.columns, *[["-" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells) + "\n"


# From how many on direct reads of skill files and repeated tokens are worth a word; below which share the cache is.
FILE_READS, REPEAT_TOKENS, CACHE_SHARE, STEPS = 3, 5000, 0.5, 3


def suggestions(facts: DataFrame) -> DataFrame:
    """session and steps, at most STEPS next steps as struct<step, detail>, in a fixed order of urgency.

    facts, of which any may be null: missing (names of expected skills that never loaded), failed_coverages (of playbooks that missed their
    gate), judge_errors, file_reads, loads, cache_hit_rate, hash_flips, repeat_extra and post_compaction (tokens), compaction_known,
    growth_verdict, judge_enabled. Repeats that compactions explain are called that; where nothing is found, that is the step."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    step = lambda name, detail: F.struct(F.lit(name).alias("step"), detail.cast("string").alias("detail"))
    tax = n("repeat_extra") - n("post_compaction")
    legal = (tax < REPEAT_TOKENS) & F.coalesce("compaction_known", F.lit(False))
    repeats = F.when(legal, step("repeats_after_compaction", tax)).otherwise(step("repeats", F.col("repeat_extra")))
    found = F.array_compact(
        F.array(
            F.when(F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0, step("missing_skills", F.array_join(F.slice("missing", 1, 3), ", "))),
            F.when(F.size(F.coalesce("failed_coverages", F.array().cast("array<double>"))) > 0, step("playbook_below_gate", F.array_join(F.transform("failed_coverages", lambda c: F.format_string("%.2f", c)), ", "))),
            F.when(n("judge_errors") > 0, step("judgments_dropped", F.col("judge_errors"))),
            F.when(n("file_reads") >= FILE_READS, step("skill_files_read", F.col("file_reads"))),
            F.when(F.col("cache_hit_rate") < CACHE_SHARE, step("cache_misses", F.format_string("%.0f%%", F.col("cache_hit_rate") * 100))),
            F.when(n("hash_flips") > 0, step("prompt_changed", F.col("hash_flips"))),
            F.when(n("repeat_extra") >= REPEAT_TOKENS, repeats),
            F.when(F.col("growth_verdict").startswith("accelerat"), step("growth_accelerates", F.col("growth_verdict"))),
            F.when((n("loads") == 0) & (n("file_reads") == 0), step("no_skill_used", F.lit(""))),
            F.when(~F.coalesce("judge_enabled", F.lit(False)), step("judge_not_configured", F.lit(""))),
        )
    )
    nothing = F.array(step("nothing_found", F.lit("")))
    return facts.select("session", F.slice(F.when(F.size(found) > 0, found).otherwise(nothing), 1, STEPS).alias("steps"))
