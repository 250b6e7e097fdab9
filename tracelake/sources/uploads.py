"""Files that users hand in, kept once by content: a write-once table keyed by SHA-1, and a list of what was turned away.

The store is a folder with tables ``files`` (sha1, name, original, bytes, lines) and ``rejected`` (sha1, original, reason), each
partitioned by batch. A batch writes its own partition, whole, so that a batch that is run again after a failure changes nothing; and
what is stored already, or comes twice in a batch, is kept once. A file that holds nothing that can be analysed is turned away."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracelake.operators.graph import cut
from tracelake.sources import transcripts

NAME_CHARS = 120


def _stem(original: str) -> str:
    """A plain name: the last part of a path, without signs that don't print and without its ending."""
    last = original.replace("\\", "/").rsplit("/", 1)[-1]
    return ("".join(c for c in last if c.isprintable()).rsplit(".", 1)[0].strip(" .") or "upload")[:NAME_CHARS]


def _stems(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in names:
        yield some.map(lambda x: _stem(x or ""))


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The table of files, or nothing if none was ever kept."""
    try:
        return spark.read.parquet(f"{store}/files")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _lines(files: DataFrame) -> DataFrame:
    """source, seq, line, format, v and is_json of files' contents. The line of least number that tells a format tells the file's."""
    each = files.select(F.col("sha1").alias("source"), F.posexplode("lines").alias("at", "line")).select("source", (F.col("at") + 1).cast("long").alias("seq"), "line")
    parsed = transcripts.parse_lines(each)
    said = F.min_by(F.col("_said"), F.when(F.col("_said").isNotNull(), F.col("seq"))).over(Window.partitionBy("source"))
    return parsed.withColumn("_said", transcripts.format_said(F.col("v"))).withColumn("format", said).drop("_said")


def ingest(new: DataFrame, store: str, batch: int) -> None:
    """``new``: original, content (binary). Appends what is new and can be analysed; the rest is listed with a reason."""
    spark = new.sparkSession
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\n\z", "")
    files = new.select(F.sha1("content").alias("sha1"), "original", F.octet_length("content").cast("long").alias("bytes"), F.split(text, "\n", -1).alias("lines"))
    first = F.row_number().over(Window.partitionBy("sha1").orderBy("original"))
    files = files.withColumn("_n", first).where("_n = 1").drop("_n")
    known = stored(spark, store)
    if known is not None:
        # what this batch wrote before it broke off counts as not there
        files = files.join(known.where(F.col("batch") != batch).select("sha1"), "sha1", "left_anti")
    files = cut(files)
    useful = transcripts.events_of(_lines(files)).groupBy(F.col("source").alias("sha1")).agg(F.bool_or(F.col("type") != "RecordDropped").alias("useful"))
    judged = cut(files.join(useful, "sha1", "left"))
    stem = F.pandas_udf(_stems, "string")(F.col("original"))
    good = judged.where("useful").select("sha1", stem.alias("name"), "original", "bytes", "lines")
    bad = judged.where("not coalesce(useful, false)").select("sha1", "original", F.when(F.col("useful").isNull(), "no events").otherwise("nothing but dropped records").alias("reason"))
    good.write.mode("overwrite").parquet(f"{store}/files/batch={batch}")
    bad.write.mode("overwrite").parquet(f"{store}/rejected/batch={batch}")


def ingest_stream(files: DataFrame, store: str) -> DataStreamWriter:
    """A writer for a stream of files (original, content). Each batch is kept exactly once."""
    return files.writeStream.foreachBatch(lambda df, batch: ingest(df, store, batch))


def events(spark: SparkSession, store: str) -> DataFrame:
    """Events of all files kept, with session (the name; names that meet are told apart by their content's digest), as load() gives them."""
    files = spark.read.parquet(f"{store}/files")
    twins = F.count("*").over(Window.partitionBy("name"))
    named = files.select("sha1", F.when(twins > 1, F.concat_ws("-", "name", F.substring("sha1", 1, 8))).otherwise(F.col("name")).alias("session"))
    found = transcripts.events_of(_lines(files)).join(named.withColumnRenamed("sha1", "source"), "source")
    return found.withColumn("origin", F.lit("main"))
