"""Evidence of several sources, folded into one exclusive verdict a row; keys are named only where the evidence agrees."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a pattern may point at.
REF_KINDS = ("skill_file", "phase_file", "dir", "unknown")
REF = "struct<ref:string,kind:string,source:string,offset:bigint,phase_id:string>"


@dataclass(frozen=True)
class Pattern:
    """A regular expression for texts of one target, and the kind of thing that it points at."""

    regex: str
    target: str = "brief"
    kind: str = "unknown"


@dataclass(frozen=True)
class Rule:
    phase_id: str
    name: str | None
    patterns: tuple[Pattern, ...]


def match_refs(text: Column, source: Column, rules: Sequence[Rule], target: str) -> Column:
    """An array with the first match of each pattern for ``target``, in the order of rules and patterns: the matched text, the
    pattern's kind, ``source``, the match's offset in code points, and the rule's phase. Patterns of other kinds don't count. Null text:
    no matches. Patterns are constants of the plan, so each is compiled once; one test of all goes before, as most texts match none."""
    mine = [(r.phase_id, p) for r in rules for p in r.patterns if p.target == target and p.kind in REF_KINDS]
    none = F.array().cast(f"array<{REF}>")
    if not mine:
        return none

    def found(phase: str, p: Pattern) -> Column:
        ref = F.regexp_substr(text, F.lit(p.regex))
        # what stands before the match; a match of nothing is found by its place alone
        before = F.when(ref == "", F.regexp_instr(text, F.lit(p.regex)) - 1).otherwise(F.length(F.element_at(F.split(text, p.regex, 2), 1)))
        hit = F.struct(ref.alias("ref"), F.lit(p.kind).alias("kind"), source.alias("source"), before.cast("long").alias("offset"), F.lit(phase).alias("phase_id"))
        return F.when(text.rlike(p.regex), hit.cast(REF))

    joins = not any(re.search(r"\(\?|\\[1-9k]", p.regex) for _, p in mine)  # flags and references back don't bear it
    any_ = text.rlike("|".join(f"(?:{p.regex})" for _, p in mine)) if joins else F.lit(True)
    return F.when(text.isNotNull() & any_, F.array_compact(F.array(*[found(*m) for m in mine]))).otherwise(none)


def resolved(rows: DataFrame, fact: str, is_fact: Column, refs: str = "refs") -> DataFrame:
    """``rows`` with phases, tier and phase_id. A: a fact names it (``fact``, which may be null). B: references name one phase or more;
    phase_id is set only if it is one. C: nothing names a phase. phases: the phases that the tier rests on, sorted."""
    named = F.filter(F.transform(refs, lambda r: r["phase_id"]), lambda p: p != "")
    phases = F.array_sort(F.array_distinct(F.coalesce(named, F.array().cast("array<string>"))))
    sure = F.coalesce(is_fact, F.lit(False))
    out = rows.withColumn("phases", F.when(sure, F.array(F.col(fact))).otherwise(phases))
    tier = F.when(sure, "A").when(F.size("phases") > 0, "B").otherwise("C")
    return out.withColumns({"tier": tier, "phase_id": F.when(F.size("phases") == 1, F.col("phases")[0])})


def observed(rows: DataFrame, cost: str, names: Sequence[Rule] = (), fact_name: str | None = None) -> DataFrame:
    """A row for each phase of each row of ``resolved``: observed_phase, its name (``fact_name`` in tier A, else the first rule's of that
    phase) and cost, which is withheld where the evidence names several, so that sums count nothing twice."""
    first: dict[str, str | None] = {}
    for r in names:
        first.setdefault(r.phase_id, r.name or None)
    each = rows.withColumn("observed_phase", F.explode("phases"))
    told = F.create_map(*[F.lit(x) for p, n in first.items() if n is not None for x in (p, n)]) if any(first.values()) else None
    name = F.try_element_at(told, F.col("observed_phase")) if told is not None else F.lit(None).cast("string")
    if fact_name is not None:
        name = F.when(F.col("tier") == "A", F.col(fact_name)).otherwise(name)
    return each.withColumns({"phase_name": name, cost: F.when(F.size("phases") == 1, F.col(cost))})
