"""Audits of changed logs alone: a manifest of what was audited, an anti-join with what is there, and figures kept by session.

A session's fingerprint is made of the files that belong to it (newest change, bytes, how many), the caller's parameters and
VERSION, which changes with what figures mean. Sessions whose fingerprint the manifest holds are taken from the store; only files of
the others are read. A run writes its figures first and then its lines of the manifest, so that a run that breaks off leaves nothing
that is read later, and runs that overlap do no harm: both write the same figures under names of their own.

The store is two tables in a folder: ``figures``, partitioned by run, and ``manifest`` (session, fingerprint, run, at)."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.model import analyses, session, timeline
from tracelake.sources import discovery, transcripts

VERSION = "1"
#: Changed files that are read by name; beyond it the roots are read, and other sessions' lines left out.
MANY_FILES = 20_000
MANIFEST = "session string, fingerprint string, run string, at double"


def session_figures(events: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is kept of a session: analyses.session_figures of its audit."""
    e = keep(timeline.in_order(events))
    return analyses.session_figures(session.audit(e, keep=keep), e)


def files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """session, origin, source, modified, bytes of all transcripts below the roots, those of subagents with their session. Contents
    aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(roots)
    found = found.select(F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return transcripts.with_shared_children(transcripts.with_sessions(found))


def fingerprints(listed: DataFrame, parameters: dict | None = None) -> DataFrame:
    """session, fingerprint."""
    asked = hashlib.sha1(json.dumps([VERSION, parameters or {}], sort_keys=True).encode()).hexdigest()[:16]
    made = F.concat_ws(":", F.unix_micros(F.max("modified")).cast("string"), F.sum("bytes").cast("string"), F.count("*").cast("string"), F.lit(asked))
    return listed.groupBy("session").agg(made.alias("fingerprint"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or nothing if it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def audited(spark: SparkSession, store: str, now: DataFrame) -> DataFrame:
    """session, run of the sessions of ``now`` (fingerprints) that the store holds; of several runs the last."""
    manifest = _read(spark, f"{store}/manifest")
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST)
    return manifest.join(now, ["session", "fingerprint"]).groupBy("session").agg(F.max_by("run", F.struct("at", "run")).alias("run"))


def refresh(
    spark: SparkSession, roots: list[str], store: str, keep: Callable[[DataFrame], DataFrame], parameters: dict | None = None,
    figures: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame] = session_figures,
) -> DataFrame:
    """A row for each session that the roots hold, as fleet.sessions gives it, after an audit of those that have changed. Sessions whose
    logs are gone are left out. ``parameters``: whatever the figures depend on beside the logs."""
    listed = keep(files(spark, roots))
    now = keep(fingerprints(listed, parameters))
    changed = keep(now.join(audited(spark, store, now), "session", "left_anti"))
    stale = listed.join(changed.select("session"), "session", "left_semi").select("source").distinct()
    some = stale.limit(MANY_FILES + 1).collect()
    if some:
        paths = [r["source"] for r in some]
        if len(paths) > MANY_FILES:
            events = transcripts.with_shared_children(transcripts.load(spark, roots, recursive=True))
        else:  # folders whose subagents belong to several transcripts are told by the listing, as the other transcripts aren't read
            owners = listed.select("source", F.col("session").alias("_of"))
            read = transcripts.load(spark, paths).withColumn("_source", F.col("source"))
            events = read.join(F.broadcast(owners.join(changed.select(F.col("session").alias("_of")), "_of", "left_semi")).withColumnRenamed("source", "_source"), "_source")
            events = events.withColumn("session", F.col("_of")).drop("_of", "_source")
        run = uuid.uuid4().hex
        done = figures(events.join(changed.select("session"), "session", "left_semi"), keep)
        done.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{store}/figures")
        lines = changed.select("session", "fingerprint", F.lit(run).alias("run"), F.lit(time.time()).alias("at"))
        lines.write.mode("append").parquet(f"{store}/manifest")
    kept = _read(spark, f"{store}/figures")
    found = discovery.discover(spark, roots)
    if kept is None:
        return found.limit(0)
    return found.join(kept.join(audited(spark, store, now), ["session", "run"]).drop("run"), "session")
