"""What the operators of this subpackage share: lineage cuts and text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower case for ASCII alone; lower() would also change other letters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, which is kept
    in the session's settings; a cluster must name one, as its machines can't read each other's temporary folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tracelake-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, its types stay. tidy: the shuffle files that
    writing it made go at once, not when the driver next collects garbage; for steps whose plan nothing runs again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tracelake/{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_TIDY)
        elif tidy:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing will read it again. Tables that a lazy result still reads stay in the shared folder,
    for its owner to clear. (PySpark has no call of its own that deletes files in any store, hence the gateway.)"""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch holds by bytes as well as by rows, unless the application was started with a bound of its own. The
    setting stays in the session: plans are lazy, so it must hold when they run. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(16 << 20))
