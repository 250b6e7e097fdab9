"""Target-distribution importance resampling over hashed n-grams, whose CRCs are composed instead of computed from strings.

Features of a text are all runs of 1 to ``max_n`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. Each word's CRC is computed once. That of a longer run follows by algebra: appending n bytes to a text
maps its CRC linearly over GF(2), so CRC(ab) = shift(CRC(a), len(b)) xor CRC(b), where shifts by powers of two are 32 x 32 bit
matrices, applied by tables of their four bytes. No run of words is ever put together as a string.

A bucket's gain is the scaled log ratio of its smoothed shares in the target and in the documents; a document's weight is the
sum of its features' gains, its score the weight plus Gumbel noise that a seed and its id fix. The highest scores are drawn, which
is sampling without replacement in proportion to exp(weight / 1000).

Plan: one scan turns each whole text into its distinct buckets with counts, a table in the shared folder. Tasks add those up to at
most ``buckets`` rows each, which are summed by bucket; the sums of all tasks, 2 x ``buckets`` numbers at most, reach the driver and
the gains go out to score the table. Ranks over all rows are given without one task that sees all: rows are dealt by ranges of the
order, numbered within each range, and the counts of the ranges before (one number for each of the session's shuffle partitions)
are added. The documents and the target are counted alike, at every size; nothing is sampled but the draw itself.

Defined cases. Null or empty text: no words, no features, weight 0, never drawn. Null id: noise of the seed alone; after other ids
in ties. Repeated rows: counted, scored and ranked each. Ties in score and id: rows with fewer features first; what is then left
in a tie is equal. An empty target: all its counts are 0. No rows: no result rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, shuffle_width, small_batches
from tracelake.llm.wordcodes import _LOWER, spans

#: The reflected polynomial of CRC-32, and the bytes of words: digits, lower-case letters, all beyond ASCII.
POLYNOMIAL = 0xEDB88320
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_OF_UPPER = _WORD[_LOWER]
#: Words of more bytes than this are given to zlib one by one.
_LONG = 48
_ROW_BITS = 33  # of monotonically_increasing_id(): what is above is the partition
_FEATURES = "id long, n_words long, n_features long, bucket array<int>, times array<int>"


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix of ``tables`` (by byte of the argument) times each of x."""
    return tables[0, x & 255] ^ tables[1, (x >> 8) & 255] ^ tables[2, (x >> 16) & 255] ^ tables[3, x >> 24]


def _shifts() -> list[np.ndarray]:
    """Matrices that append 2^k zero bytes, as tables by byte."""
    unit = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [_TABLE[unit & 255] ^ (unit >> 8)]
    for _ in range(31):
        out.append(_applied(out[-1], out[-1]))
    return out


_SHIFTS = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved up by n bytes: the part of it in the CRC of a text that goes on for n bytes."""
    out, k = crc.copy(), 0
    while k < len(_SHIFTS) and (n >> k).any():
        some = np.flatnonzero(n >> k & 1)
        out[some] = _applied(_SHIFTS[k], out[some])
        k += 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes; all ranges go on by one byte together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, c, left = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32), size[order]
    long = int(np.searchsorted(-left, -_LONG, "left"))
    for k in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        c[long:n] = _TABLE[(c[long:n] ^ data[at[long:n] + k]) & 255] ^ (c[long:n] >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    c[:long] = [zlib.crc32(data[a : a + n]) for a, n in zip(at[:long].tolist(), left[:long].tolist(), strict=True)]
    out = np.empty_like(c)
    out[order] = c
    return out


def run_crcs(words: np.ndarray, size: np.ndarray, max_n: int) -> Iterator[np.ndarray]:
    """For n from 1: CRCs of each n consecutive words joined by one space, from the words' CRCs and sizes."""
    yield words
    spaced = shifted(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ words  # a space, then the word
    crc = words
    for n in range(2, max_n + 1):
        crc = shifted(crc[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
        yield crc


def _features(batches: Iterator[pa.RecordBatch], max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in spans(batch.column("text"), _OF_UPPER):
            n_docs, n_words = part.hi - part.lo, np.diff(part.first)
            owner = np.repeat(np.arange(n_docs), n_words)
            words = word_crcs(_LOWER[part.data], part.starts, part.ends)
            keys = []
            for n, crc in enumerate(run_crcs(words, part.ends - part.starts, max_n), 1):
                own = owner[: len(crc)]
                inside = own == owner[n - 1 :]
                keys.append(own[inside] * buckets + (crc[inside] % np.uint32(buckets)).astype(np.int64))
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(n_docs + 1) * buckets).astype(np.int32))
            n_features = sum(np.maximum(n_words - n, 0) for n in range(max_n))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % buckets, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(part.lo, n_docs), pa.array(n_words.astype(np.int64)), pa.array(n_features.astype(np.int64)), *lists],
                names=["id", "n_words", "n_features", "bucket", "times"],
            )


def features(docs: DataFrame, id_col: str, text_col: str, max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """id, n_words, n_features, bucket and times (distinct buckets and how often each occurs) of each row."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lambda it: _features(it, max_n, buckets), _FEATURES)


def _counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows; at most ``buckets`` numbers leave a task, and reach the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            which, times = (batch.column(c).flatten().to_numpy() for c in ("bucket", "times"))
            total += np.bincount(which, times, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    sums = rows.select("bucket", "times").mapInArrow(added, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in sums]] = [r["n"] for r in sums]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) by bucket, each count plus one."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(ident: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place (from 1) in the order of all rows: numbered within ranges, plus the counts of the ranges before."""
    width = shuffle_width(rows.sparkSession)
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn(rank, F.monotonically_increasing_id()))
    part = F.shiftright(rank, _ROW_BITS)
    counts = dealt.groupBy(part.alias("part")).count().collect()  # a number for each of the ranges
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["count"]
    firsts = rows.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    within = F.col(rank).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = dealt.join(F.broadcast(firsts), part == F.col("part"))
    return placed.withColumn(rank, F.col("before") + within + 1).drop("part", "before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, max_n: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text",
) -> DataFrame:
    """A row for each input row: id, n_words, n_features, weight, score and rank (from 1) among those drawn, else null. Drawn are
    ``percent`` of a hundred of the rows with at least ``least_words`` words, rounded down."""
    spark = docs.sparkSession
    small_batches(spark)
    mine = cut(features(docs, id_col, text_col, max_n, buckets))
    gain = spark.sparkContext.broadcast(gains(_counts(mine, buckets), _counts(features(target, target_id_col, target_text_col, max_n, buckets), buckets)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, times = batch.column("bucket"), batch.column("times")
            worth = gain.value[which.flatten().to_numpy()] * times.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(which.value_lengths().to_numpy())])
            weight = np.diff(np.concatenate([[0], np.cumsum(worth)])[ends])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weight.astype(np.int64))], names=["id", "n_words", "n_features", "weight"])

    done = mine.mapInArrow(weighed, "id long, n_words long, n_features long, weight long")
    done = done.withColumn("score", F.col("weight") + _noise(F.col("id"), seed))
    placed = ranked(done.where(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc()], "rank")
    draws = placed.count() * percent // 100
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = done.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is drawn; rows without an id are never. An id of several rows counts
    as drawn if one of them is."""
    ids = resample(docs, target, percent, id_col=id_col, text_col=text_col, **options).where("rank is not null").select(F.col(id_col).alias("drawn_id"))
    return docs.join(ids.distinct(), docs[id_col].cast("long") == ids["drawn_id"], "left_semi")
