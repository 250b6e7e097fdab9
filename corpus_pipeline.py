"""From raw documents to packed training sequences: five operators, one after another.

Each stage takes (spark, docs, sf_dir) and keeps the columns of documents, but for the last, which returns pieces of
sequences. A stage works on all rows that the one before kept; side tables are read from sf_dir.

Defined cases, for all stages: an empty table gives an empty one. Extra columns, whatever their names, are carried along unread (the
last stage leaves them out). Null ids are rows like others, never merged with each other. What else a null, an empty text, a
repeated row or a shared id means is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, minhash_dedup, packing, quality_classifier, secret_scan
from tracelake.llm.common import cut
from tracelake.llm.queries import QUALITY_CUT
from tracelake.tables import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as texts without words. Repeated rows, and all rows of one id and one text, go or stay together;
    other rows that share an id are judged each by their own text.
    """
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"), QUALITY_CUT)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id.

    Null and empty texts are near nothing, so each of their ids stays. Of repeated rows one stays, as of rows that share an id: that
    whose text, then whose other columns have the least hash. Rows without an id all stay.
    """
    return minhash_dedup.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none. Repeated rows go or stay together; rows that share an id are judged each by their own text. Items
    without words never occur.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows, where there is such a column. No row goes.

    Null texts stay null, with a null n_chars; empty ones stay empty. Repeated rows are masked alike. A null source is one unnamed owner.
    """
    masked = secret_scan.redact(docs)
    if "n_chars" not in masked.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens.

    Null and empty texts are an end id alone. Repeated rows, and rows that share an id, are packed each.
    """
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", mask_secrets),
    ("packing", pack),
]
#: SQL can't express the classifier, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last ends in a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
