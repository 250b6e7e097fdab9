"""Verdicts of an outside judge, and their proof: the judge is any function from prompts to replies; without one nothing is asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What of a turn, and of a session, a judge gets to read; what stands for the rest; a session without turns.
TURN_CHARS, SESSION_CHARS, MORE, NO_TURNS = 600, 7000, " ...", "(no user turns found)"
WEIGHTS = {"covered": 1.0, "partial": 0.5, "missing": 0.0}


def ask(candidates: DataFrame, judge: Callable[[str], str] | None, id_col: str = "id", prompt: str = "prompt") -> DataFrame:
    """``candidates`` with reply: one call for each row, in the tasks. An error becomes a null reply with its reason in error."""
    plain = candidates.select(id_col, prompt)
    if judge is None:
        return plain.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit("no judge")})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ident, text in pdf.itertuples(index=False, name=None):
                try:
                    out.append((ident, text, judge(text), None))
                except Exception as e:  # a judge may fail in any way; the row says how
                    out.append((ident, text, None, str(e)))
            yield pd.DataFrame(out, columns=[id_col, prompt, "reply", "error"])

    kind = dict(plain.dtypes)[id_col]
    return plain.mapInPandas(each, f"{id_col} {kind}, {prompt} string, reply string, error string")


def proven(replies: DataFrame, text: str = "text") -> DataFrame:
    """Verdict and evidence of replies that hold a JSON object, and defect: unparsable, no_evidence or not_verbatim."""
    v = F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0))
    r = replies.withColumns({"verdict": F.try_variant_get(v, "$.verdict", "string"), "evidence": F.try_variant_get(v, "$.evidence", "string")})
    blank = F.coalesce(F.trim("evidence"), F.lit("")) == ""
    defect = F.when(F.col("verdict").isNull(), "unparsable").when(blank, "no_evidence").when(~F.contains(F.col(text), F.col("evidence")), "not_verbatim")
    return r.withColumn("defect", defect)


def coverage(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The mean weight of proven verdicts: a step without proof counts as missing."""
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("defect").isNull() & (F.col("verdict") == name), F.lit(w)).otherwise(weight)
    return steps.groupBy(*keys).agg(F.count("*").alias("steps"), F.round(F.avg(weight), 4).alias("coverage"))


def playbook_steps(playbooks: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """id, step, text: a step is a line that begins with a number, a full stop and white space, with the lines after it that are
    indented by three blanks or a tab; other lines don't belong to it, and a blank line ends it."""
    body = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    lines = playbooks.select(id_col, F.posexplode(F.split(body, r"\r?\n|\r", -1)).alias("at", "line"))
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begins, blank = F.col("line").rlike(r"^\d+\.\s+"), F.trim(F.regexp_replace("line", r"\s", "")) == ""
    lines = lines.withColumns({"step": F.sum(begins.cast("int")).over(w), "stop": F.sum(blank.cast("int")).over(w)})
    first = F.min(F.when(begins, F.col("stop"))).over(Window.partitionBy(id_col, "step"))
    kept = lines.withColumn("first", first).where((F.col("step") > 0) & (F.col("stop") == F.col("first")) & (begins | F.col("line").rlike(r"^(   |\t)")))
    bare = F.regexp_replace(F.regexp_replace("line", r"^(\d+\.)\s+", "$1 "), r"^\s+|\s+$", "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", bare.alias("t")))), lambda p: p["t"])
    return kept.groupBy(id_col, "step").agg(F.array_join(parts, " ").alias("text"))


def turns_block(sessions: DataFrame, turns: DataFrame, keys: list[str], order: str, text: str = "text", most: int = TURN_CHARS) -> DataFrame:
    """keys and block, for each of ``sessions``: its turns in order under their numbers, each cut at ``most`` characters."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    said = F.coalesce(F.col(text), F.lit(""))
    cut = F.when(F.length(said) > most, F.concat(F.substring(said, 1, most), F.lit(MORE))).otherwise(said)
    lines = turns.select(*keys, number.alias("_n"), cut.alias("_t")).withColumn("_t", F.concat(F.lit("Turn "), F.col("_n").cast("string"), F.lit(": "), F.col("_t")))
    block = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "\n\n").alias("block"))
    return sessions.select(*keys).distinct().join(block, keys, "left").withColumn("block", F.coalesce("block", F.lit(NO_TURNS)))


def trajectory(lines: DataFrame, keys: list[str], order: list[str], text: str = "text", budget: int = SESSION_CHARS) -> DataFrame:
    """keys and trajectory: a session's lines in order, joined, cut at ``budget`` characters. Lines that begin beyond it are left out
    by a running length before anything is put together, so a session of any length costs its budget."""
    w = Window.partitionBy(*keys).orderBy(*order)
    line = F.coalesce(F.col(text), F.lit(""))
    through = F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.select(*keys, line.alias("_t"), F.row_number().over(w).alias("_n"), (through - F.length(line) - 1).alias("_from"))
    # lines beyond the budget are null, which a list leaves out
    part = F.when(F.col("_from") <= budget, F.struct("_n", "_t"))
    g = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_t"]), "\n").alias("_all"), F.max(F.col("_from") + F.length("_t")).alias("_long"))
    return g.select(*keys, F.when(F.col("_long") > budget, F.concat(F.substring("_all", 1, budget), F.lit(MORE))).otherwise(F.col("_all")).alias("trajectory"))


def within_limit(candidates: DataFrame, keys: list[str], order: list[str], limit: int | None) -> DataFrame:
    """``candidates`` with asked: the first ``limit`` of each of ``keys`` in order, or all. The rest is what gaps.report() counts as over
    the limit, as no judgment reaches it."""
    if limit is None:
        return candidates.withColumn("asked", F.lit(True))
    return candidates.withColumn("asked", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= limit)


def prompts(candidates: DataFrame, blocks: DataFrame, keys: list[str], template: Callable[[Column, Column], Column], skill: str = "skill_id") -> DataFrame:
    """id and prompt for ask(): the candidates that are asked about, each with its session's turns. template: from name and turns."""
    j = candidates.where("asked").join(blocks, keys)
    return j.select(F.struct(*keys, skill).alias("id"), template(F.col(skill), F.col("block")).alias("prompt"))
