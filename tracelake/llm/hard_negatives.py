"""Hard-negative mining by blocked dense GEMM: blocks of anchors, broadcast, against blocks of candidates.

Components become whole numbers, floor(scale * x), kept in float64, where inner products are exact below 2^53. Anchors are a stated
set of rows; they are searched against all rows. A first pass over the candidates keeps each anchor's best rows of its own label, its
positives: each task merges the best of its blocks, and the tasks' best are merged by anchor. With their scores, a second pass finds
for each positive the best rows of other labels whose score lies within a window below the positive's, merged in the same way.

Plan: anchors are written once and taken up in blocks of at most BLOCK_BYTES, so that what is broadcast (a block and, in the second
pass, its few positives) has a fixed bound; each block costs two scans of the candidates, which aren't shuffled or sorted. A task holds
TILE x TILE scores at a time. It hands on a few rows for each anchor of the block, which are merged in windows by anchor after a
limit on the map side. The work is anchors times rows, as stated by the query set, and its shuffles are a few rows for each anchor
and task.

Where a score could pass 2^53, it is computed in whole numbers of any size; beyond 9 x 10^16 either way it counts as that much.

Defined cases. Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different lengths:
missing components count as 0; so does all of an empty vector. Null id: never an anchor; as a candidate, after other ids in ties.
Repeated rows: each is a candidate, each is an anchor; a row is another row than the anchor if its id differs. Rows that share an id:
the same, each with its own vector and label. No anchors, no positives, no negatives within the window: no result rows. Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, small_batches

#: What a block's vectors may hold: 32,768 anchors of 64 components.
BLOCK_BYTES = 16 << 20
TILE = 2048
EXACT, MOST = 2.0**53, 9 * 10**16


@dataclass
class Rows:
    """Rows with usable vectors, by label. A row without an id is unnamed and has id 0."""

    ids: np.ndarray
    unnamed: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # whole numbers, as float64

    def sorted(self) -> Rows:
        return self.at(np.argsort(self.labels, kind="stable"))

    def at(self, some: np.ndarray | slice) -> Rows:
        return Rows(self.ids[some], self.unnamed[some], self.labels[some], self.vectors[some])

    def labelled(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _read(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Rows]:
    """Batches of id, label and vector (array of double) as rows, TILE at most at a time."""
    for batch in batches:
        for lo in range(0, len(batch), TILE):
            part = batch.slice(lo, TILE)
            vectors = part.column("vector")
            size = vectors.value_lengths().fill_null(0).to_numpy()
            flat = vectors.flatten()
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64)) if len(flat) else np.zeros(0)
            dense = np.zeros((len(part), int(size.max(initial=0))))
            dense[np.repeat(np.arange(len(part)), size), np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
            good = np.isfinite(dense).all(axis=1) & vectors.is_valid().to_numpy(zero_copy_only=False)
            ids = part.column("id")
            yield Rows(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("label").to_numpy(), dense).at(good).sorted()


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exactly: as float64 where no sum can pass 2^53, else as 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


class Best:
    """The k best rows of each group, by score, then id; rows without an id last."""

    def __init__(self, k: int, most: int) -> None:
        self.k, self.most, self.held, self.parts = k, most, 0, []

    def add(self, group: np.ndarray, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, score.astype(np.int64), unnamed, ids))
        self.held += len(group)
        if self.held > self.most:
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.held)

    def best(self) -> tuple[np.ndarray, ...]:
        group, score, unnamed, ids = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)), *self.parts, strict=True))
        order = np.lexsort((ids, unnamed, -score, group))
        first = np.searchsorted(group[order], group[order])
        order = order[np.arange(len(order)) - first < self.k]
        return group[order], score[order], unnamed[order], ids[order]


def _out(best: Best) -> pa.RecordBatch:
    group, score, unnamed, ids = best.best()
    return pa.RecordBatch.from_arrays([pa.array(group), pa.array(score), pa.array(ids, mask=unnamed)], names=["group", "score", "id"])


def _alike(batches: Iterator[pa.RecordBatch], block: Rows, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """The k best other rows of its label for each anchor of the block; group: the anchor's place in it."""
    best = Best(k, 1 << 20)
    for rows in _read(batches, scale):
        for label in np.unique(rows.labels):
            some, mine = rows.at(rows.labelled(label)), block.labelled(label)
            for lo in range(mine.start, mine.stop, TILE):
                anchors = block.at(slice(lo, min(lo + TILE, mine.stop)))
                s = scores(anchors.vectors, some.vectors)
                other = some.unnamed | (anchors.ids[:, None] != some.ids)
                if s.shape[1] > k:  # at most one row in k + 1 need go, but for repeated rows
                    least = np.where(other, s, -np.inf)
                    other &= s >= np.partition(least, -k, axis=1)[:, -k, None]
                a, c = np.nonzero(other)
                best.add(a + lo, s[a, c], some.unnamed[c], some.ids[c])
    yield _out(best)


def _unlike(batches: Iterator[pa.RecordBatch], block: Rows, goals: np.ndarray, k: int, scale: float, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """For each positive the k best rows of other labels with low * positive <= 100 * score <= high * positive. goals: anchors' places
    in the block and positives' scores, sorted by place; group: a place in goals."""
    best = Best(k, 1 << 20)
    first = np.searchsorted(goals[:, 0], np.arange(len(block.ids) + 1))
    begins, ends = -(-low * goals[:, 1] // 100), high * goals[:, 1] // 100  # the whole scores that fit
    least, most = np.full(len(block.ids), np.inf), np.full(len(block.ids), -np.inf)
    np.minimum.at(least, goals[:, 0], begins)
    np.maximum.at(most, goals[:, 0], ends)
    asked = np.flatnonzero(first[1:] > first[:-1])
    for rows in _read(batches, scale):
        for lo in range(0, len(asked), TILE):
            places = asked[lo : lo + TILE]
            s = scores(block.vectors[places], rows.vectors)
            a, c = np.nonzero((s >= least[places, None]) & (s <= most[places, None]) & (block.labels[places, None] != rows.labels))
            value = s[a, c].astype(np.int64)
            order = np.lexsort((rows.ids[c], rows.unnamed[c], -value, a))
            a, c, value = a[order], c[order], value[order]
            edges = np.searchsorted(a, np.arange(len(places) + 1))
            for n in np.flatnonzero(edges[1:] > edges[:-1]):
                x, y = edges[n], edges[n + 1]
                for g in range(first[places[n]], first[places[n] + 1]):
                    at = x + int(np.searchsorted(-value[x:y], -ends[g]))
                    to = min(at + k, x + int(np.searchsorted(-value[x:y], -begins[g], "right")))
                    if to > at:
                        best.add(np.full(to - at, g), value[at:to], rows.unnamed[c[at:to]], rows.ids[c[at:to]])
    yield _out(best)


def _merged(candidates: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], k: int) -> DataFrame:
    """group, place (from 1), score and id of the k best rows of each group over all tasks."""
    found = candidates.mapInArrow(task, "group long, score long, id long")
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _packed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for rows in _read(batches, scale):
        vectors = pa.array([x.astype("<f8").tobytes() for x in rows.vectors], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(rows.ids), pa.array(rows.labels), vectors], names=["id", "label", "vector"])


def _blocks(anchors: DataFrame, scale: float, most: int) -> Iterator[Rows]:
    """Anchors in blocks of at most ``most`` bytes; the driver holds one block, and one partition of the table, at a time."""
    packed = cut(anchors.mapInArrow(lambda it: _packed(it, scale), "id long, label long, vector binary"))
    width = max(1, packed.agg(F.max(F.octet_length("vector"))).first()[0] or 0)
    size, rows = max(1, most // width), packed.toLocalIterator()
    while some := list(islice(rows, size)):
        vectors = np.zeros((len(some), width // 8))
        for k, r in enumerate(some):
            vectors[k, : len(r["vector"]) // 8] = np.frombuffer(r["vector"], "<f8")
        yield Rows(np.array([r["id"] for r in some]), np.zeros(len(some), bool), np.array([r["label"] for r in some]), vectors).sorted()


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to ``negatives`` rows for each of an anchor's first
    ``positives`` rows of its label. ``anchors``: a condition on rows. Windows are in hundredths of the positive's score."""
    spark = rows.sparkSession
    small_batches(spark)
    named = {"id": F.col(id_col).cast("long"), "label": F.col(label_col).cast("long"), "vector": F.col(vector_col).cast("array<double>")}
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    pick = lambda df: df.where(usable).select(*[c.alias(n) for n, c in named.items()])
    candidates, done = pick(rows), []
    for block in _blocks(pick(rows.where(anchors & F.col(id_col).isNotNull())), scale, block_bytes):
        held = spark.sparkContext.broadcast(block)
        first = _merged(candidates, lambda it, held=held: _alike(it, held.value, positives, scale), positives).collect()
        first.sort(key=lambda r: (r["group"], r["place"]))
        goals = spark.sparkContext.broadcast(np.array([(r["group"], r["score"]) for r in first], np.int64).reshape(-1, 2))
        found = _merged(candidates, lambda it, held=held, goals=goals: _unlike(it, held.value, goals.value, negatives, scale, low, high), negatives)
        pairs = spark.createDataFrame(
            [(g, int(block.ids[r["group"]]), r["id"], r["score"]) for g, r in enumerate(first)], "group long, anchor_id long, positive_id long, positive_score long"
        )
        joined = found.join(F.broadcast(pairs), "group")  # a few numbers for each anchor of the block
        done.append(cut(joined.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        held.unpersist()
        goals.unpersist()
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
