"""Many sessions at once: from the folders that hold their logs to tables of how they went."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.model import analyses, session, timeline
from tracelake.operators import loads
from tracelake.sources import discovery, transcripts


def sessions(spark: SparkSession, roots: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each session that the roots hold: its figures (analyses.session_figures), workspace, path and time. Logs are parsed
    once; ``keep`` gets what several tables are built from, to write or checkpoint it. Files of subagents belong to their session."""
    found = discovery.discover(spark, roots)
    events = keep(timeline.in_order(transcripts.with_shared_children(transcripts.load(spark, roots, recursive=True))))
    figures = analyses.session_figures(session.audit(events, keep=keep), events)
    return found.join(figures, "session")


def report(every: DataFrame) -> dict[str, DataFrame]:
    """overall and by_style (loads.fleet_report), and shapes: how contexts grew."""
    return {"overall": loads.fleet_report(every, []), "by_style": loads.fleet_report(every.where(F.col("style").isNotNull()), ["style"]), "shapes": loads.shapes(every, [])}
