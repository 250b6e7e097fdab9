"""Billing and child chats kept in SQLite files: a data source that reads them on executors, and what is made of the rows."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:  # noqa: ANN001
        self.names = [f.name for f in schema.fields]
        self.table, self.paths = options["table"], options["paths"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Rows of one file, read-only. No file, or one without the table, has none; any other error fails the task."""
        if not os.path.exists(partition.value):
            return
        quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in self.names if n != "db")
        with closing(sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)) as con:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE lower(name) = lower(?)", (self.table,)).fetchone():
                return
            for row in con.execute(f'SELECT {quoted} FROM "{self.table}"'):  # noqa: S608
                yield (partition.value, *row)


class SqliteTables(DataSource):
    """spark.read.format("sqlite").schema("db string, ...").option("table", t).option("paths", "a.db,b.db").load()"""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, paths: list[str], table: str, columns: str) -> DataFrame:
    """Columns of a table of each file, with its path as db."""
    spark.dataSource.register(SqliteTables)
    return spark.read.format("sqlite").schema("db string, " + columns).option("table", table).option("paths", ",".join(paths)).load()


def seconds(value: Column) -> Column:
    """Milliseconds, or seconds if below 1e11; others are null."""
    n = value.cast("double")
    return F.when((n > 0) & (n < 1e11), n).when((n >= 1e11) & (n < float("inf")), n / 1000)


def session_uuid(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})[^/]*\.jsonl$", 1)), F.lit(""))


def _billed(rows: DataFrame) -> DataFrame:
    n = lambda k: F.expr(f"try_cast(get_json_object(token_info, '$.{k}') as bigint)")
    out = rows.withColumns({"prompt": n("prompt_tokens"), "completion": n("completion_tokens"), "cached": n("cached_tokens")})
    return out.withColumn("whole", F.col("prompt").isNotNull() & F.col("completion").isNotNull() & F.col("cached").isNotNull())


def billed_series(messages: DataFrame) -> DataFrame:
    """session_id, ts, prompt, completion, cached: rows that lack a field, or a time, are left out whole."""
    rows = _billed(messages).withColumn("ts", seconds(F.col("gmt_create"))).where("whole and ts is not null")
    return rows.select("session_id", "ts", "prompt", "completion", "cached")


def billed_usage(messages: DataFrame) -> DataFrame:
    """Sums by session, how many rows carried them, and status: billed or unparseable. A session without rows has none."""
    total = lambda c: F.sum(F.when(F.col("whole"), F.col(c))).alias(f"{c}_tokens")
    g = _billed(messages).groupBy("session_id").agg(F.count("*").alias("rows_total"), F.count_if(~F.col("whole")).alias("rows_without_token_info"), total("prompt"), total("completion"), total("cached"))
    requests = F.col("rows_total") - F.col("rows_without_token_info")
    return g.withColumns({"requests": requests, "status": F.when(requests > 0, "billed").otherwise("unparseable")})


def decrypted(content: Column, key: Column, iv: Column) -> Column:
    """Base64 of AES-CBC as text; null if it isn't. The key comes from the caller."""
    return F.try_aes_decrypt(F.concat(iv, F.try_to_binary(content, F.lit("base64"))), key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def child_chats(sessions: DataFrame, messages: DataFrame, claimed: DataFrame) -> DataFrame:
    """Messages of child chats (session_id, parent_session_id, parent_tool_call_id, session_type) that no transcript on disk has
    claimed by its parent tool id."""
    children = sessions.where((F.col("parent_tool_call_id") != "") & F.col("session_type").startswith("agent_sub"))
    children = children.join(claimed.select(F.col("tool_id").alias("parent_tool_call_id")).distinct(), "parent_tool_call_id", "left_anti")
    return messages.join(children.select("session_id", "parent_session_id", "parent_tool_call_id"), "session_id")


def hint(orphans: DataFrame, sessions: DataFrame, claimed: DataFrame) -> DataFrame:
    """n: orphaned dispatches that the child chats could resolve."""
    known = sessions.select(F.col("parent_tool_call_id").alias("tool_id")).join(claimed.select("tool_id"), "tool_id", "left_anti")
    return orphans.select("tool_id").distinct().join(known, "tool_id", "left_semi").agg(F.count("*").alias("n"))


def child_events(messages: DataFrame, key: Column, iv: Column) -> DataFrame:
    """Events of child chats from child_chats(): the transcripts' columns that a message can fill. Usage is kept even where the
    text can't be decrypted; such a message gives a RecordDropped beside it."""
    v = F.try_parse_json(decrypted(F.col("content"), key, iv))
    parts = F.filter(F.try_variant_get(v, "$.contents", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "text")
    text = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "\n")
    n = lambda k: F.expr(f"try_cast(get_json_object(token_info, '$.{k}') as bigint)")
    cached = F.coalesce(n("cached_tokens"), F.lit(0))
    usage = F.when(n("prompt_tokens").isNotNull() & n("completion_tokens").isNotNull(),
                   F.struct(F.greatest(F.lit(0), n("prompt_tokens") - cached).alias("input_other"), n("completion_tokens").alias("output"), cached.alias("cache_read")))
    none = F.lit(None).cast("struct<input_other:bigint,output:bigint,cache_read:bigint>")
    event = lambda kind, t, u: F.struct(kind.alias("type"), t.alias("text"), u.alias("usage"))
    kind = F.when(v.isNull(), "RecordDropped").when(F.col("role") == "user", "TurnBegin").when(F.col("role") == "assistant", "ContentPart").otherwise("ToolResult")
    both = F.array_compact(F.array(event(kind, F.when(v.isNotNull(), text), none), F.when((F.col("role") == "assistant") & usage.isNotNull(), event(F.lit("UsageRecord"), F.lit(None).cast("string"), usage.cast("struct<input_other:bigint,output:bigint,cache_read:bigint>")))))
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("gmt_create", "id")).cast("long")
    rows = messages.withColumns({"seq": seq, "ts": seconds(F.col("gmt_create"))})
    return rows.select(F.col("parent_session_id").alias("session"), F.concat(F.lit("subagent:child:"), "session_id").alias("origin"), "seq", "ts", F.col("parent_tool_call_id").alias("parent_tool_id"),
                       "request_id", F.posexplode(both).alias("part", "e")).select("*", "e.*").drop("e")
