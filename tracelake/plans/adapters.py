"""Driver tables seen as the things the operators work on, in DataFrames and in SQL.

``events`` stands for transcripts: a session is a user, records are numbered by time. signup is a user record, view and click
are assistant records, purchase is an assistant record with usage, error is a boundary (a compaction). ``orders`` stands for a
billed series, ``documents`` for bodies of a catalog, ``conversations`` for what people wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.tables import table

S = ["session"]
BUCKETS = ["signup", "view", "click", "purchase"]


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp as it reads, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, us, event_type, kind, positive, tokens, k."""
    kind = F.when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "error", "meta").otherwise("assistant")
    # renamed first: then later steps by session find the rows of a session together already
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session")
    seq = F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id")).cast("long")
    return e.withColumn("seq", seq).select(
        "session",
        "seq",
        micros(F.col("ts")).alias("us"),
        "event_type",
        kind.alias("kind"),
        (F.col("event_type") == "purchase").alias("positive"),
        F.round(F.col("value") * 100).cast("long").alias("tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def items(r: DataFrame) -> DataFrame:
    return r.where("kind <> 'meta'")


def boundaries(r: DataFrame) -> DataFrame:
    return r.where("kind = 'meta'").select("session", "seq", "us")


RECORDS = """
WITH RECURSIVE e AS (
  SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) AS us, event_type,
         CASE event_type WHEN 'signup' THEN 'user' WHEN 'error' THEN 'meta' ELSE 'assistant' END AS kind,
         event_type = 'purchase' AS positive, CAST(round(value * 100) AS BIGINT) AS tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
it AS (SELECT * FROM e WHERE kind <> 'meta'),
bo AS (SELECT * FROM e WHERE kind = 'meta'),
gi AS (SELECT it.*, (SELECT min(bo.seq) FROM bo WHERE bo.session = it.session AND bo.seq > it.seq) AS gone_seq FROM it),
sp1 AS (SELECT *, kind = 'user' OR coalesce(lag(positive AND kind = 'assistant') OVER (PARTITION BY session ORDER BY seq), false) AS st FROM it),
sp2 AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY session ORDER BY seq) AS grp FROM sp1),
sp3 AS (SELECT *, bool_or(positive) OVER (PARTITION BY session, grp) AS in_span FROM sp2 WHERE kind = 'assistant'),
sp AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY min(seq)) AS span_no, min(seq) AS first_seq, max(seq) AS last_seq,
              count(*) AS n_records, arg_max(tokens, seq) AS anchor
       FROM sp3 WHERE in_span GROUP BY session, grp)
"""
