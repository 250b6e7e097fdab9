"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is its share, by weight, of all words, but at most ``most`` times its own size; what is over is shared again by
weight among the others until none is above. Each document is then taken target / size times, on average: the whole part of that
always, and the fraction as an inclusion probability. The cube method turns probabilities into decisions that keep two totals of
each source, words and documents: probabilities move along a direction in the null space of these constraints, as far as one of them
allows, to either side with the odds that keep each expectation. Every move decides one document at least, until no direction is left.

Directions are chosen to decide the largest document first: its unit vector, projected on the null space, so that the many smaller
ones make up for it; one that is too large for that is drawn before the others, whose probabilities then shift. What remains of a
group, two documents at most, meets the remainders of other groups and moves on with them. The last LANDING documents of a source are
the landing: of all ways to decide them the one that comes nearest to their share of words is taken.

Plan: one scan counts words; a table of ids, sources and sizes is all that goes on. Sums by source are combined before the shuffle.
Sources, in the order of code points, are numbered by ranges, and the shares found in rounds of sums over the table of sources.
Documents of a source are dealt by the hash of their id to groups of about GROUP, whatever the source's size; a task reads its groups
as sorted streams and holds POOL documents at a time. Remainders meet FAN groups at a time, then by source: two rows for each group.
Documents, groups and draws depend on ids and sizes alone, so reruns agree on any number of machines.

Defined cases. Null or empty text: size 0, taken 0 times. Null source: one source, the last. Null ids: told apart by size alone.
Repeated rows: each is a document. Documents without words take no part in the sampling. Sources without words: target 0. No words at
all: all targets 0. No rows: no result rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, shuffle_width, small_batches
from tracelake.llm.importance import ranked
from tracelake.llm.wordcodes import _SPACE, spans

GROUP, POOL, FAN = 1024, 512, 256
#: Documents that are left to the landing; how many times the words that a document may need the others must have.
LANDING, LARGE = 12, 2
#: Probabilities this near to 0 or 1 are decided.
_EDGE = 1e-9
_STATE = "source string, part long, id long, size long, source_size long, target double, whole long, p double, chosen int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.zeros(0, np.int64), *(np.diff(part.first) for part in spans(batch.column("text"), ~_SPACE))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(np.concatenate(n).astype(np.int64))], names=["id", "source", "size"])


def shares(sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``sources`` (source, source_size, documents) with target. Rounds end when a round caps no further source."""
    order = [F.col("source").asc_nulls_last()]
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    placed = ranked(sources, order, "place").withColumn("weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int")))
    placed = placed.withColumn("cap", most * F.col("source_size"))
    goal = (placed.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    capped, level = 0, 0.0
    while True:
        over = F.col("cap") <= level * F.col("weight")
        n, full, weight = placed.agg(F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        left = goal - (full or 0)
        if level and n == capped or not weight:
            break
        capped, level = n, left / weight
    shared = F.lit(float(left)) * F.col("weight") / F.lit(float(weight or 1))
    return placed.withColumn("target", F.when(over, F.col("cap").cast("double")).otherwise(shared)).drop("place", "weight", "cap")


def _moved(p: np.ndarray, by: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """p after a move along a direction that keeps sum(by * p) for each row of by and moves the first document that can be moved."""
    w = p * (1 - p)
    fit = np.linalg.pinv((by * w) @ by.T, rcond=1e-12, hermitian=True)
    for k in range(min(len(p), 3)):
        u = -w * ((fit @ (by[:, k] * w[k])) @ by)
        u[k] += w[k]
        top = np.abs(u).max()
        if abs(u[k]) > 1e-6 * w[k] and top > 0:
            u /= top
            break
    else:
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf))
        down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf))
    a, b = up.min(), down.min()
    ahead = rng.random() < b / (a + b)
    p = p + a * u if ahead else p - b * u
    hit = int(up.argmin() if ahead else down.argmin())
    p[hit] = round(p[hit])  # exactly, whatever was rounded
    return p


def _released(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p (sorted by size, the largest first) after draws of documents too large for all that come after them: their words can't be made
    up for by small moves. Each is drawn with its probability if the others can make up for either outcome, else the nearer one is
    taken; the others' probabilities shift by what it adds to the words or takes from them."""
    p = p.copy()
    for k in range(len(p) - 1):
        rest, words = p[k + 1 :], size[k + 1 :].astype(np.float64)
        up, down = float((1 - rest) @ words), float(rest @ words)
        needs = (1 - p[k]) * size[k], p[k] * size[k]  # words that the rest gives up if it is taken, takes if not
        if needs[0] * LARGE <= down and needs[1] * LARGE <= up:
            break
        fits = needs[0] <= down, needs[1] <= up
        taken = rng.random() < p[k] if fits[0] == fits[1] == True else needs[0] - down < needs[1] - up  # noqa: E712
        left, p[k] = (-needs[0] if taken else needs[1]), float(taken)
        room = 1 - rest if left > 0 else rest
        share = min(1.0, abs(left) / max(float(room @ words), 1e-300))
        p[k + 1 :] = rest + np.sign(left) * share * room
    return p


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, left: int = 2) -> np.ndarray:
    """Probabilities after moves that keep the sums of p and of p * size; of those not 0 or 1, ``left`` remain, or fewer."""
    out, at = p.astype(np.float64), np.argsort(-size, kind="stable")
    out[at] = _released(out[at], size[at], rng)
    at = at[(out[at] > _EDGE) & (out[at] < 1 - _EDGE)]
    by = np.stack([size / max(1, size.max(initial=1)), np.ones(len(size))])
    while len(at) > max(2, left) or len(at) == 2 > left and size[at[0]] == size[at[1]]:
        moved = _moved(out[at], by[:, at], rng)
        if moved is None:
            break
        out[at] = moved
        at = at[(moved > _EDGE) & (moved < 1 - _EDGE)]
    return out


def landed(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decisions for all: a flight to LANDING documents or fewer, then of all ways to decide those the one nearest to the words that
    they stand for, of such the one nearest to their number."""
    p = flight(p, size, rng, LANDING)
    out, at = np.round(p), np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = np.abs(ways @ size[at] - (p @ size - out @ size + out[at] @ size[at]))
    out[at] = ways[np.lexsort((np.abs(ways.sum(axis=1) - p[at].sum()), np.round(off, 6)))[0]]
    return out


def _flown(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Groups (source, part), whose rows come together, by pools. Rows come back decided, but for the remainders of a group, which have
    p and no decision; the last level lands those too."""
    names = [c.split()[0] for c in _STATE.split(", ")]
    kinds = pa.schema(list(zip(names, [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.float64(), pa.int32()], strict=True)))
    now, held, rng = None, [], None

    def settled(rows: pa.Table, end: bool) -> tuple[pa.Table, pa.Table]:
        p, size = rows.column("p").to_numpy(), rows.column("size").to_numpy()
        p = landed(p, size, rng) if end and last else flight(p, size, rng)
        open_ = (p > _EDGE) & (p < 1 - _EDGE)
        chosen = pa.array(np.round(p).astype(np.int32), mask=open_)
        rows = pa.table([*(rows.column(c) for c in names[:-2]), pa.array(p), chosen], schema=kinds)
        return rows.filter(pa.array(~open_)), rows.filter(pa.array(open_))

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            for part in settled(pa.concat_tables(held), True):
                yield from part.to_batches()

    for batch in batches:
        table = pa.table(batch.columns, schema=kinds)
        source, part = batch.column("source"), batch.column("part").to_numpy()
        code = source.dictionary_encode().indices.fill_null(-1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            key = source[a].as_py(), int(part[a])
            if key != now:
                yield from close()
                now, held = key, []
                rng = np.random.Generator(np.random.PCG64([zlib.crc32((key[0] or "").encode()), key[0] is None, key[1], last]))
            for lo in range(a, b, POOL):
                held.append(table.slice(lo, min(POOL, b - lo)))
                if sum(map(len, held)) >= POOL:
                    done, rest = settled(pa.concat_tables(held), False)
                    yield from done.to_batches()
                    held = [rest]
    yield from close()


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """Rows dealt by (source, part), after their flights; a table in the shared folder."""
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "source", "part").sortWithinPartitions("source", "part", "id", "size", "p")
    return cut(dealt.mapInArrow(lambda it: _flown(it, last), _STATE))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), percent: int = 100, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each input row: id, source, size (words), source_size, target (of its source), times (how often it is taken) and taken
    (words: size times times). The sources' targets are ``percent`` of a hundred of all words, shared by ``weights``, which repeat."""
    spark = docs.sparkSession
    small_batches(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = cut(picked.mapInArrow(_counted, "id long, source string, size long"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("documents"))
    targets = cut(shares(sources, weights, percent, most)).withColumnRenamed("source", "of_source")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["of_source"])).drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + _EDGE)
    share = F.greatest(rate - whole, F.lit(0.0))
    groups = F.ceil(F.col("documents") / GROUP)
    rows = rows.withColumns({"whole": whole.cast("long"), "p": F.when(F.col("size") > 0, share).otherwise(F.lit(0.0)), "part": F.pmod(F.xxhash64("id", "size"), F.greatest(groups, F.lit(1))), "chosen": F.lit(0)})
    state = [c.split()[0] for c in _STATE.split(", ")]
    rows = rows.select(*[F.col(c).cast("string" if c == "source" else dict(x.split() for x in _STATE.split(", "))[c]).alias(c) for c in state])
    sampled = F.col("p") > _EDGE
    done, open_ = [rows.where(~sampled)], rows.where(sampled)
    for k, part in enumerate((F.col("part"), F.floor(F.col("part") / FAN), F.lit(0))):
        level = _level(open_.withColumn("part", part.cast("long")), last=k == 2)
        done.append(level.where("chosen is not null"))
        open_ = level.where("chosen is null")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = F.col("whole") + F.col("chosen")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))
