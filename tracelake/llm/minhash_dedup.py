"""MinHash near-dedup: universal hash minima, bands, verification, and components by alternating stars.

A document's set is its distinct 5-word shingles (64-bit codes). Documents with equal sets are one class and go on as one.
HASHES universal hashes give minima; BANDS bands of them propose candidates. At a similarity of 0.75 all bands miss with a
chance of 5e-6. Every proposed link is confirmed on the full sets.

No pairs within a bucket are listed at first: each member is compared to the bucket's least member. Confirmed links give
components. Only in buckets that then still hold several components can further links matter; there, members of different
components are compared on their signatures, and pairs whose estimate is ESTIMATE or more on all codes of their sets (32 bits of
each) at once, so that only what is near enough becomes a row; those rows are confirmed on the full sets as well. So large groups
of near copies, which the first step joins, stay linear, and no link between components is passed over for want of a comparison. A
bucket of more than BLOCK members is compared block by block, each pair of blocks in a group of its own: rows grow with the number
of blocks there, time with the square of the members that aren't linked. A pair at 0.75 falls below ESTIMATE with a chance of 1e-5.

Plan: the first scan keeps ids, set sizes, set digests and signatures, no text. Bucket minima are combined before the shuffle
and joined back, so that a hot bucket's rows are split by Spark. A second scan makes the sets of documents in buckets of two
or more. Each stage ends in a table in the shared folder.

Defined cases. Null text or no word: an empty set, linked with nothing. Fewer than five words: the whole sequence is one
shingle. Repeated rows, or rows that share an id: one node; each row gets its result; a pair of ids is linked if any of their texts
are. Null ids: linked with nothing. No rows: no result rows. Other columns, whatever their names, aren't read. Codes of 64 bits
stand for shingles; two that differ share one with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, drop_cut, shuffle_width, small_batches
from tracelake.llm.components import components
from tracelake.llm.wordcodes import PLACES, U, chunks, grams, mixed

SHINGLE = 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
THRESHOLD = 75
#: Four and a half standard errors below the threshold, for HASHES minima.
ESTIMATE = 0.58
#: Members of a bucket that are compared together.
BLOCK = 256
_rng = np.random.Generator(np.random.PCG64(20240301))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The sorted set of codes."""
    if 0 < len(words) < k:
        return mixed(grams(words, len(words)) + U(len(words)))
    return np.unique(grams(words, k))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_rows = len(batch)
        sizes = np.zeros(n_rows, np.int64)
        digest = np.zeros((2, n_rows), U)
        signature = np.zeros((n_rows, HASHES), "<u4")
        for chunk in chunks(batch.column("text"), lower=True):
            sets = [shingles(chunk.of(k)) for k in range(chunk.hi - chunk.lo)]
            n = np.array([len(x) for x in sets])
            sizes[chunk.lo : chunk.hi] = n
            full = np.flatnonzero(n) + chunk.lo
            if not len(full):
                continue
            every = np.concatenate(sets)
            first = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
            for half, seed in enumerate((U(1), U(2))):
                digest[half, full] = mixed(np.add.reduceat(mixed(every + seed), first))
            for p in range(HASHES):
                signature[full, p] = np.minimum.reduceat(every * _A[p] + _B[p], first) >> U(32)
        part = signature.reshape(n_rows, BANDS, ROWS).astype(U)
        bands = np.zeros((n_rows, BANDS), U)
        for r in range(ROWS):
            bands += mixed(part[:, :, r] + U(r + 1)) * PLACES[r]
        bands = mixed(bands + np.arange(BANDS, dtype=U))
        flat = pa.array(bands.astype(np.int64).ravel())
        offsets = pa.array(np.arange(n_rows + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes), pa.array(digest[0].astype(np.int64)), pa.array(digest[1].astype(np.int64)),
             pa.array([x.tobytes() for x in signature], pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
            names=["id", "n", "d1", "d2", "signature", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[np.ndarray] = []
        for chunk in chunks(batch.column("text"), lower=True):
            out += [shingles(chunk.of(k)) for k in range(chunk.hi - chunk.lo)]
        short = [(x >> U(32)).astype("<u4").tobytes() for x in out]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in out], pa.binary()), pa.array(short, pa.binary())], names=["id", "set", "short"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
            a, b = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
            if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
                keep.append(False)
                continue
            both = np.concatenate([a, b])
            both.sort(kind="stable")  # merges two sorted runs
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= THRESHOLD * (len(a) + len(b) - common))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(_confirmed, "u long, v long")


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are similar enough by 32 bits of each code; a little more than that, as codes may meet."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * (common + 2 + len(both) // 1000) >= THRESHOLD * (len(both) - common)


def _met(place: int, ids: np.ndarray, component: np.ndarray, n: np.ndarray, side: np.ndarray, s: np.ndarray, sets: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of members of two blocks (or of one) that lie in different components and may be similar enough: by size, then by
    signature, then by their sets. A pair counts in the first band that it shares alone, so once in all."""
    order = np.argsort(n, kind="stable")
    ids, component, n, side, s = ids[order], component[order], n[order], side[order], s[order]
    one, out, codes = bool((side == 2).all()), [], [np.frombuffer(sets[k], "<u4") for k in order]
    upto = np.searchsorted(n, n * 100 // THRESHOLD, "right")  # sizes of similar sets differ by a third at most
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, upto[i])
        j = j[(component[j] != component[i]) & (ids[j] != ids[i]) & (one | (side[j] != side[i]))]
        if not len(j):
            continue
        same = s[j] == s[i]
        near = same.sum(axis=1) >= ESTIMATE * HASHES
        for x, bands in zip(j[near], same[near].reshape(-1, BANDS, ROWS).all(axis=2), strict=True):
            if bands.argmax() == place and _near(codes[i], codes[x]):
                out.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each group (key, x, y), whose rows come together."""

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        place, ids, component, n, side, signature, sets = zip(*rows, strict=True)
        found = _met(place[0], np.array(ids), np.array(component), np.array(n), np.array(side), np.frombuffer(b"".join(signature), "<u4").reshape(-1, HASHES), sets)
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    now, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "x", "y", "place", "id", "component", "n", "side", "signature", "short")]
        for key, x, y, *row in zip(*columns, strict=True):
            if (key, x, y) != now and rows:
                yield from pairs(rows)
                rows = []
            now = key, x, y
            rows.append(tuple(row))
    if rows:
        yield from pairs(rows)


def _residual(buckets: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs across components. buckets: band, place, id. nodes: id, component, n, signature. sets: id, short."""
    rows = buckets.join(nodes.select("id", "component"), "id").select(F.col("band").alias("key"), F.col("place").cast("int").alias("place"), "id", "component")
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    compared = rows.join(several.select("key", "size"), "key")
    # A block is a share of a bucket by id hash; every block meets every block of its bucket, in a group of its own
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    compared = compared.withColumn("block", F.pmod(F.xxhash64("id", "key"), blocks).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("x"), F.greatest(x, F.col("block")).alias("y")))
    compared = compared.select("key", "place", "id", "component", "block", F.explode(meets).alias("at"))
    side = F.when(F.col("at.x") == F.col("at.y"), F.lit(2)).otherwise((F.col("block") != F.col("at.x")).cast("int"))
    compared = compared.select("key", "place", "id", "component", F.col("at.x").alias("x"), F.col("at.y").alias("y"), side.alias("side"))
    compared = compared.join(nodes.select("id", "n", "signature").join(sets.select("id", "short"), "id"), "id").repartition(shuffle_width(buckets.sparkSession), "key", "x", "y")
    return compared.sortWithinPartitions("key", "x", "y").mapInArrow(_across, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_shingles, component_id (the least id reachable) and kept (id = component_id)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_signed, "id long, n long, d1 long, d2 long, signature binary, bands array<long>"))
    filled = signed.where("n > 0 and id is not null")
    classes = filled.groupBy("n", "d1", "d2").agg(F.min("id").alias("class"))
    member = filled.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("id", "class").distinct()
    same_set = member.where("id <> class").select(F.col("id").alias("u"), F.col("class").alias("v"))

    heads = filled.join(classes.withColumnRenamed("class", "id"), ["n", "d1", "d2", "id"], "left_semi").dropDuplicates(["n", "d1", "d2", "id"])
    heads = heads.select("id", "n", "signature", "bands")
    rows = heads.select("id", F.posexplode("bands").alias("place", "band"))
    full = rows.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    buckets = cut(rows.join(full.select("band", "least"), "band"))
    used = buckets.select("id").distinct()
    sets = cut(texts.join(used, "id", "left_semi").mapInArrow(_sets, "id long, set binary, short binary"))
    star = buckets.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    links = cut(_confirm(star, sets))
    first = components(links)
    nodes = heads.drop("bands").join(used, "id", "left_semi").join(first.withColumnRenamed("node", "id"), "id", "left")
    nodes = cut(nodes.withColumn("component", F.coalesce("component", "id")))
    more = cut(_confirm(_residual(buckets.select("band", "place", "id"), nodes, sets), sets))
    found = components(links.unionByName(more).unionByName(same_set))
    for table in (buckets, sets, links, first, nodes, more):  # nothing below reads them
        drop_cut(table)
    done = signed.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    done = done.withColumn("component", F.coalesce("component", "id"))
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns: one row of each component, and all rows without an id. Of rows that share an
    id, the one whose text, then whose other columns have the least hash."""
    stays = near_duplicates(docs, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("stays_id")).distinct()
    rest = [f.name for f in docs.schema.fields if f.name != text_col and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.xxhash64(*rest)))
    inner = f"{'_'.join(docs.columns)}_first"
    named = docs.join(stays, docs[id_col] == stays["stays_id"], "left_semi").withColumn(inner, first).where(F.col(inner) == 1).drop(inner)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
