"""Which sessions there are: a listing of files without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.transcripts import with_sessions

RECENT, FOUND = 10, 50


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """session, workspace, path, modified, bytes of the transcripts below the roots. Of several files of a session the newest
    counts; files of subagents are part of their session's. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(roots)
    files = files.select(F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    named = with_sessions(files).where("origin = 'main'")
    w = Window.partitionBy("session").orderBy(F.desc("modified"), "source")
    newest = named.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return newest.select("session", F.regexp_extract("source", r"([^/]+)/[^/]+$", 1).alias("workspace"), F.col("source").alias("path"), "modified", "bytes")


def latest(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.max_by(F.struct(*sessions.columns), F.struct("modified", "session")).alias("s")).select("s.*")


def search(sessions: DataFrame, query: str = "", done: DataFrame | None = None) -> DataFrame:
    """The newest sessions whose id or workspace holds the query, whatever its case, with cached (they are in ``done``)."""
    q = F.lit(query.lower())
    hits = sessions.where(F.contains(F.lower("session"), q) | F.contains(F.lower("workspace"), q)).orderBy(F.desc("modified"), "session").limit(FOUND if query else RECENT)
    if done is None:
        return hits.withColumn("cached", F.lit(False))
    known = done.select("session").distinct().withColumn("_c", F.lit(True))
    return hits.join(known, "session", "left").withColumn("cached", F.coalesce("_c", F.lit(False))).drop("_c")
