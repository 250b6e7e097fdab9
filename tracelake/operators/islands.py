"""Gaps and islands: spans of records, runs of equal values, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str], order: Sequence[str]):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(keys: Sequence[str], order: Sequence[str]):  # noqa: ANN202
    return _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def island_no(starts: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The number of islands begun so far; ``starts`` marks their first rows."""
    return F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(_so_far(keys, order))


def positional_spans(records: DataFrame, keys: Sequence[str], seq: str = "seq", kind: str = "kind", positive: str = "positive") -> DataFrame:
    """Request spans without identities: user records and records with usage end a span; a span counts if it holds usage.

    Rows of kind ``meta`` don't take part. Returns the assistant rows with ``grp`` and ``in_span``; spans() sums them up.
    """
    used = records.where(F.col(kind) != "meta")
    is_pos = (F.col(kind) == "assistant") & F.coalesce(F.col(positive), F.lit(False))
    used = used.withColumn("_pos", is_pos)
    after = F.coalesce(F.lag("_pos").over(_ordered(keys, [seq])), F.lit(False))
    used = used.withColumn("_starts", (F.col(kind) == "user") | after)
    used = used.withColumn("grp", island_no(F.col("_starts"), keys, [seq]))
    used = used.withColumn("in_span", F.max("_pos").over(Window.partitionBy(*keys, "grp")))
    return used.where(F.col(kind) == "assistant").drop("_pos", "_starts")


def spans(records: DataFrame, keys: Sequence[str], seq: str = "seq", kind: str = "kind", positive: str = "positive", anchor: str | None = None) -> DataFrame:
    """keys, span_no, first_seq, last_seq, n_records; with ``anchor`` also that column of the span's last record."""
    grouped = positional_spans(records, keys, seq, kind, positive).where("in_span").groupBy(*keys, "grp")
    more = [F.max_by(anchor, seq).alias("anchor")] if anchor else []
    out = grouped.agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("n_records"), *more)
    return out.withColumn("span_no", F.row_number().over(_ordered(keys, ["first_seq"])).cast("long")).drop("grp")


def anchor_runs(records: DataFrame, keys: Sequence[str], anchor: str, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Maximal runs of assistant records of one anchor; only user records and other anchors break a run."""
    used = records.where((F.col(kind) == "user") | ((F.col(kind) == "assistant") & F.col(anchor).isNotNull()))
    w = _ordered(keys, [seq])
    starts = (F.col(kind) == "user") | (F.coalesce(F.lag(kind).over(w), F.lit("user")) == "user") | (F.lag(anchor).over(w) != F.col(anchor))
    used = used.withColumn("_starts", starts).withColumn("run", island_no(F.col("_starts"), keys, [seq]))
    grouped = used.where(F.col(kind) != "user").groupBy(*keys, "run")
    return grouped.agg(
        F.first(anchor).alias("anchor"),
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.count("*").alias("n_records"),
        F.array_sort(F.collect_list(seq)).alias("seqs"),
    )


def verify_spans(records: DataFrame, keys: Sequence[str], anchor: str, seq: str = "seq") -> DataFrame:
    """keys, checked, mismatched: positional spans against the anchor runs that begin at the same record."""
    own = positional_spans(records, keys, seq).where("in_span").groupBy(*keys, "grp")
    own = own.agg(F.min(seq).alias("first_seq"), F.array_sort(F.collect_list(seq)).alias("span_seqs")).drop("grp")
    runs = anchor_runs(records, keys, anchor, seq).select(*keys, "first_seq", "seqs")
    both = own.join(runs, [*keys, "first_seq"])
    return both.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(F.col("seqs") != F.col("span_seqs")).alias("mismatched"))


def value_runs(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys, run_no, value, n, first and last of order[0]: runs of equal, non-null values."""
    kept = rows.where(F.col(value).isNotNull())
    changed = ~F.coalesce(F.lag(value).over(_ordered(keys, order)).eqNullSafe(F.col(value)), F.lit(False))
    kept = kept.withColumn("_starts", changed).withColumn("run_no", island_no(F.col("_starts"), keys, order))
    return kept.groupBy(*keys, "run_no").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def flips(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, flips: changes of value within each key's runs."""
    return runs.groupBy(*keys).agg((F.count("*") - 1).alias("flips"))
