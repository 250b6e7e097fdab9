"""Quality rules whose cutoffs come from the corpus: quantile sketches per language and source, then a joined filter.

Each document gets a few measures (symbols per word, share of repeated lines, share of words in repeated 3-word windows,
share of capitals, mean word length). A sketch of a measure is a table of logarithmic bins with counts (relative error
GAMMA - 1): sketches of parts merge by adding counts, in any order, so results are the same at each run. They count all documents
that pass the base rules. Sketches of (language, source) merge into those of the language and of the whole corpus.

Quantiles of a group are blended, at every size alike: a group of n documents counts n, its language PRIOR; and in the language's
own, the corpus counts PRIOR. Those of a measure's values above zero are kept as well. A document fails a measure above the greatest of

- ``q75 + FENCE * (q75 - q25)``, plus the upper tail q95 - q50 where the median isn't zero;
- q90: a measure that a tenth of the group and more share is usual there;
- BELOW times q05 of the values above zero: where hardly any document has the measure at all (symbols in prose), those that have it are
  told from the rest by where their own values begin;
- what EVENTS single occurrences are in a document of the group's median size, so that a trace of something rare fails nobody.

For mean word length it also fails below ``q25 - FENCE * (q75 - q25)`` less the lower tail q50 - q05. So each cutoff comes from the
group's sketches; only those of shares are at most MOST, so that each can fire.

Plan: one pass in Python reads each whole text and keeps numbers only; bins are counted with map-side combining; the join
with the thresholds is salted, so that a source with a third of all rows spreads out.

Defined cases. Null text: no words, base_failed. Null language or source: a group of its own. Repeated rows: judged each,
counted each. Groups without a document that passes the base rules: thresholds of the language, else of all; if there is none at
all, no measure fails. No rows: no result rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, small_batches

GAMMA = 1.02
FENCE = 3.0
#: Documents that a group's language counts as in the group's quantiles, and the corpus in the language's.
PRIOR = 50
EVENTS, BELOW = 5, 0.9
SALTS = 16
#: Measure: (what it is counted in, how much of that one occurrence takes, whether it is a share, whether low values fail as well).
MEASURES = {
    "symbol_rate": ("n_words", 1, False, False),
    "dup_line_share": ("n_lines", 1, True, False),
    "repeat_share": ("n_words", 10, True, False),
    "upper_share": ("word_chars", 1, True, False),
    "mean_word": (None, 0, False, True),
}
#: Sketched beside the measures, for their medians.
SIZES = ("n_words", "n_lines", "word_chars")
MOST = 0.9
QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}
_ZERO = -(2**20)
_ABOVE = "above 0: "
_WORDY = b"#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"


def repeated(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, where, count = np.unique(pairs[:-1] * np.int64(ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    # UTF-8: every code point has one byte that isn't a continuation
    points = int(codes[:128].sum() + codes[192:].sum())
    blank = int(codes[9:14].sum() + codes[32])
    return len(words), points - blank, int(codes[list(_WORDY)].sum()), len(lines) - len(set(lines)), repeated(ids), len(lines), int(codes[65:91].sum())


_NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column("text")]
        cols = np.array(rows, dtype=np.int64).reshape(-1, len(_NUMBERS))
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("id", "lang", "source")] + [pa.array(cols[:, k]) for k in range(len(_NUMBERS))], names=["id", "lang", "source", *_NUMBERS])


def _per(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each input row: id, the counts, base_failed, failed (array of measure names) and kept."""
    small_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, lang string, source string, " + ", ".join(f"{n} long" for n in _NUMBERS)
    m = picked.mapInArrow(_measured, schema)
    m = m.withColumns(
        {
            "symbol_rate": _per("n_symbols", "n_words"),
            "dup_line_share": _per("n_dup_lines", "n_lines"),
            "repeat_share": _per("n_repeat_words", "n_words"),
            "upper_share": _per("n_upper", "word_chars"),
            "mean_word": _per("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    m = cut(m)
    limits = thresholds(m)
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = m.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    j = m.join(salted, ["lang", "source", "salt"], "left")
    bad = []
    for x, (*_, low) in MEASURES.items():
        off = F.col(x) > F.col(f"{x}_hi")
        bad.append(F.when(off | (F.col(x) < F.col(f"{x}_lo")) if low else off, F.lit(x)))
    failed = F.array_compact(F.array(*bad))
    j = j.withColumn("failed", F.when(F.col("n_words") > 0, failed).otherwise(F.array().cast("array<string>")))
    return j.select(F.col("id").alias(id_col), *_NUMBERS[:5], "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def sketches(m: DataFrame) -> DataFrame:
    """lang, source, level, measure, bin, n: mergeable by adding n. Levels: 0 the group, 1 its language, 2 all."""
    names = [*MEASURES, *SIZES]
    values = [y for x in names for y in (F.lit(x), F.col(x).cast("double"))]
    long = m.where(~F.col("base_failed")).select("lang", "source", F.stack(F.lit(len(names)), *values).alias("measure", "value"))
    width = math.log(GAMMA)
    where = F.when(F.col("value") < 1e-9, F.lit(_ZERO)).otherwise(F.ceil(F.log(F.col("value")) / width).cast("int"))
    own = long.groupBy("lang", "source", "measure", where.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    lang = own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    every = lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    no = F.lit(None).cast("string")
    cols = ["level", "lang", "source", "measure", "bin", "n"]
    return (
        own.withColumn("level", F.lit(0)).select(cols)
        .unionByName(lang.withColumns({"level": F.lit(1), "source": no}).select(cols))
        .unionByName(every.withColumns({"level": F.lit(2), "lang": no, "source": no}).select(cols))
    )


def _quantiles(s: DataFrame) -> DataFrame:
    """level, lang, source, measure, total and QUANTILES of sketches; values above zero of each measure count as one more measure."""
    above = s.where((F.col("bin") > _ZERO) & F.col("measure").isin(*MEASURES)).withColumn("measure", F.concat(F.lit(_ABOVE), "measure"))
    group = ["level", "lang", "source", "measure"]
    w = Window.partitionBy(*group)
    upto = F.sum("n").over(w.orderBy("bin"))
    value = F.when(F.col("bin") <= _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bin")))
    c = s.unionByName(above).withColumns({"upto": upto, "total": F.sum("n").over(w), "value": value})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    return c.groupBy(*group).agg(F.max("total").alias("total"), *[at(q).alias(x) for x, q in QUANTILES.items()])


def thresholds(m: DataFrame) -> DataFrame:
    """A row for each (lang, source): the bounds of each measure, x_hi, and x_lo where low values fail."""
    q = _quantiles(cut(sketches(m)))
    of = lambda level, keys: q.where(F.col("level") == level).select(*keys, "measure", *[F.col(c).alias(f"{c}_{level}") for c in ("total", *QUANTILES)])
    names = [*MEASURES, *SIZES, *[_ABOVE + x for x in MEASURES]]
    groups = m.select("lang", "source").distinct().withColumn("measure", F.explode(F.array(*[F.lit(x) for x in names])))
    j = groups.join(of(0, ["lang", "source"]), ["lang", "source", "measure"], "left").join(of(1, ["lang"]), ["lang", "measure"], "left").join(of(2, []), "measure", "left")

    def blended(x: str) -> Column:
        def with_prior(level: int, prior: Column) -> Column:
            n, own = F.col(f"total_{level}"), F.col(f"{x}_{level}")
            return F.when(n.isNull(), prior).otherwise((n * own + PRIOR * prior) / (n + PRIOR))

        return with_prior(0, with_prior(1, F.col(f"{x}_2")))

    found = F.map_from_entries(F.collect_list(F.struct("measure", F.struct(*[blended(x).alias(x) for x in QUANTILES]))))
    j = j.groupBy("lang", "source").agg(found.alias("q"))  # a few numbers for each of the names
    out = []
    for x, (size, each, share, low) in MEASURES.items():
        at = F.col("q")[x]
        reach = FENCE * (at["q75"] - at["q25"])
        tail = F.when(at["q50"] > 0, at["q95"] - at["q50"]).otherwise(F.lit(0.0))
        tops = [at["q75"] + reach + tail, at["q90"], F.coalesce(BELOW * F.col("q")[_ABOVE + x]["q05"], F.lit(0.0))]
        if size:
            tops.append(F.lit(float(EVENTS * each)) / F.greatest(F.col("q")[size]["q50"], F.lit(1.0)))
        # null where the corpus has no document to measure: then nothing fails
        top = F.when(at["q50"].isNotNull(), F.greatest(*tops))
        out.append((F.least(top, F.lit(MOST)) if share else top).alias(f"{x}_hi"))
        if low:
            out.append((at["q25"] - reach - (at["q50"] - at["q05"])).alias(f"{x}_lo"))
    return j.select("lang", "source", *out)
