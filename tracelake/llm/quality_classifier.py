"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network with temperature.

Random indexing: each word has a sparse ternary index vector, drawn from its 56-bit code. Its context vector is the sum of the
index vectors of its neighbours (two on each side) over the whole corpus; as an integer sum, it is put together from parts in any
order. Every word has a vector of its own, at any size of the corpus. A word's vector is that sum at length one, in whole 127ths: a byte
an entry.

A document is pooled into the mean of its words' vectors, beside its length, its share of distinct words and of capitals, digits
and other signs among its bytes. The network sees these alone, never labels, language, source or ids. It is fitted on a bounded
sample of labelled rows, at most SAMPLE (one per hash class of the id), of which one in five only sets the temperature.

Plan: a scan cuts rows into pieces. The sums of a piece's distinct words are dealt by word and added up over all pieces, a table in
the shared folder, a row a bucket of words. Then the rows go through in SLICES parts, one after the other, each a scan of its own: a
piece asks each bucket for its words, and its bag of words (which words each row holds, how often) only passes through; by bucket,
requests meet the sums, and each piece is answered; by piece, bags and vectors meet and give features, a table in the shared folder.
The shuffle files of a step go when its table is written, so the disk holds the sums of pieces, or the answers to one part. No text
is shuffled. The sample's features (ids broadcast, at most SAMPLE) go to the driver, at most 5 MB; the network is fitted there in numpy
and sent out to score all rows. Beside them one number reaches the driver, that of pieces. Rows are read several times and must be the
same each time; a word without sums is an error.

Defined cases. Null or empty text: zero features, scored as any other. Repeated rows: scored each. Rows that share an id but not
the text: scored each by its text; if the id is in the sample, the least features in byte order count. A document with several
labels: the lowest. Null ids or labels: never in the sample. No usable label, or one class only: the score is the share of
label 1 in the sample, or 0.5. No rows: no result rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, drop_cut, shuffle_width, small_batches
from tracelake.llm.lm_scoring import _loose, _rows, _squeeze
from tracelake.llm.wordcodes import Chunk, U, chunks, mixed

DIM = 64
NONZERO = 6
#: Bytes of text gathered before a piece is dealt out.
PIECE = 32 << 20
BUCKETS_PER_PARTITION = 2
#: Parts of the rows that meet their words' vectors one after the other. Results don't depend on it.
SLICES = 3
SAMPLE = 1 << 14
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: Beside the pooled vector: length, share of distinct words, shares of capitals, digits and other signs.
PLAIN = 5
FEATURES = DIM + PLAIN
#: Tokens whose neighbours are looked up together.
_STEP = 50_000


def index_vectors(codes: np.ndarray) -> np.ndarray:
    """A sparse ternary vector for each code: NONZERO places, all different, and their signs."""
    out = np.zeros((len(codes), DIM), np.int8)
    h = mixed(codes + U(0x9E3779B97F4A7C15))
    row, step = np.arange(len(codes)), (h >> U(8)) | U(1)  # an odd step meets each place once
    for k in range(NONZERO):
        out[row, ((h + U(k) * step) & U(DIM - 1)).astype(np.int64)] = ((h >> U(40 + k)) & U(1)).astype(np.int8) * 2 - 1
    return out


def _packed(x: np.ndarray) -> bytes:
    """Rows of DIM integers: 2, 4, 8 or 64 bits an entry as each row needs, compressed."""
    z = ((x << 1) ^ (x >> 63)).astype("<u8")  # signs in the lowest bit
    kind = np.searchsorted([4, 16, 256], z.max(axis=1, initial=0), "right").astype("u1")
    parts = [_squeeze(kind)]
    for k, bits in enumerate((2, 4)):
        each = z[kind == k].astype("u1").reshape(-1, DIM * bits // 8, 8 // bits)
        parts.append(_squeeze(np.bitwise_or.reduce(each << (bits * np.arange(8 // bits, dtype="u1")), axis=2).ravel()))
    parts += [_squeeze(z[kind == 2].astype("u1").ravel()), _squeeze(z[kind == 3].ravel())]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpacked(raw: bytes) -> np.ndarray:
    parts, at = [], 0
    for _ in range(5):
        n = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    kind = _loose(parts[0], "u1")
    z = np.zeros((len(kind), DIM), np.int64)
    for k, bits in enumerate((2, 4)):
        each = _loose(parts[1 + k], "u1").reshape(-1, DIM * bits // 8, 1) >> (bits * np.arange(8 // bits, dtype="u1"))
        z[kind == k] = (each & ((1 << bits) - 1)).reshape(-1, DIM)
    z[kind == 2] = _loose(parts[3], "u1").reshape(-1, DIM)
    z[kind == 3] = _loose(parts[4], "<u8").astype(np.int64).reshape(-1, DIM)
    return (z >> 1) ^ -(z & 1)


def _planed(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as planes of bytes, the lowest first, without the planes that are all zero."""
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + _squeeze(np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4)[:, :planes].T).ravel())


def _unplaned(raw: bytes) -> np.ndarray:
    each = _loose(raw[1:], "u1").reshape(raw[0], -1)
    out = np.zeros(each.shape[1], np.int64)
    for k, plane in enumerate(each):
        out |= plane.astype(np.int64) << (8 * k)
    return out


def word_sums(at: np.ndarray, doc: np.ndarray, index: np.ndarray, order: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
    """For each range of words between edges, packed sums of the index vectors of the words' neighbours in the same document.
    at: the word of each token, a row of index; order: the tokens by word."""
    begin = np.searchsorted(at, np.arange(len(index) + 1), sorter=order)
    # two places without a word before, after and between documents, so that neighbours are found by place alone
    place = np.arange(2, len(at) + 2, dtype=np.int32)
    place[1:] += 2 * np.cumsum(np.diff(doc) != 0, dtype=np.int32)
    spread = np.full(place[-1] + 3 if len(at) else 0, len(index), np.int32)
    spread[place] = at
    index = np.concatenate([index, np.zeros((1, DIM), np.int8)])
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        total = np.zeros((y - x, DIM), np.int64)
        for lo in range(begin[x], begin[y], _STEP):
            some = order[lo : min(begin[y], lo + _STEP)]
            near = index[spread[place[some] - 2]]
            for o in (-1, 1, 2):
                near += index[spread[place[some] + o]]
            first = np.flatnonzero(np.diff(at[some], prepend=-1))
            total[at[some[first]] - x] += np.add.reduceat(near, first, axis=0, dtype=np.int64)
        yield _packed(total)


def _plain(chunk: Chunk) -> np.ndarray:
    """PLAIN numbers of each document; the share of distinct words is left open."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[48:58] = 1, 2
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
    out = np.zeros((chunk.hi - chunk.lo, PLAIN))
    size = np.maximum(np.diff(chunk.at), 1)
    of = kind[chunk.raw]
    for k in (1, 2, 3):
        out[:, 1 + k] = np.diff(np.concatenate([[0], np.cumsum(of == k)])[chunk.at]) / size
    return out


def _pieces(batches: Iterator[pa.RecordBatch], also: Callable[[pa.RecordBatch, Chunk], Any]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list]]:
    """Pieces of a task's rows: a number, the codes of the words, how many each row has, and what ``also`` gives for each chunk."""
    piece = TaskContext.get().partitionId() << 40
    words, sizes, rest, held = [], [], [], 0
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            words.append(chunk.words >> U(8))
            sizes.append(np.diff(chunk.first))
            rest.append(also(batch, chunk))
            held += len(chunk.raw) + 64 * (chunk.hi - chunk.lo)
            if held > PIECE:
                yield piece, words, np.concatenate(sizes), rest
                piece += 1
                words, sizes, rest, held = [], [], [], 0
    if sizes:
        yield piece, words, np.concatenate(sizes), rest
    pa.default_memory_pool().release_unused()


def _edges(unique: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted codes begin and end: a bucket of their highest bits is a range of them."""
    return np.searchsorted(((unique >> U(24)) * U(buckets) >> U(32)).astype(np.int64), np.arange(buckets + 1))


_SUMS = "key int, piece long, words binary, sums binary"
_SUMS_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each piece a row for each bucket, with its words and their sums."""
    for piece, words, n, _ in _pieces(batches, lambda *_: None):
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        unique, at, order = _numbered(words)
        edges, rows = _edges(unique, buckets), []
        for b, sums in enumerate(word_sums(at, doc, index_vectors(unique), order, edges)):
            if edges[b] < edges[b + 1]:
                rows.append((b, piece, _coded(unique[edges[b] : edges[b + 1]]), sums))
        if rows:
            yield _rows(rows, _SUMS_KINDS, "key piece words sums")


_TOTALS = "key int, words binary, sums binary, pieces int"
_TOTALS_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int32()]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket a row with its words, their sums over all pieces, and how many pieces hold some."""

    def totals(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        words = [_codes(w) for w, _ in rows]
        unique = np.unique(np.concatenate(words))
        total = np.zeros((len(unique), DIM), np.int64)
        for (_, sums), w in zip(rows, words, strict=True):
            total[np.searchsorted(unique, w)] += _unpacked(sums)
        return _rows([(bucket, _coded(unique), _packed(total), len(rows))], _TOTALS_KINDS, "key words sums pieces")

    now, rows = None, []
    for batch in batches:
        for i in range(len(batch)):
            key, words, sums = (batch.column(c)[i].as_py() for c in ("key", "words", "sums"))
            if key != now and rows:
                yield totals(now, rows)
                rows = []
            now = key
            rows.append((words, sums))
    if rows:
        yield totals(now, rows)


_ASKED = "key int, piece long, words binary, sums binary, docs array<struct<id:long,hash:long,n:int,kinds:int>>, plain binary, rarity binary, bag binary, times binary"
_DOCS = pa.list_(pa.struct([("id", pa.int64()), ("hash", pa.int64()), ("n", pa.int32()), ("kinds", pa.int32())]))
_ASKED_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), _DOCS, *[pa.binary()] * 4]
_ASKED_NAMES = "key piece words sums docs plain rarity bag times"


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each piece a row with its bags, and a row for each bucket with the words that it needs."""

    def also(batch: pa.RecordBatch, chunk: Chunk) -> tuple[list, list, np.ndarray]:
        return *(batch.column(c)[chunk.lo : chunk.hi].to_pylist() for c in ("id", "hash")), _plain(chunk)

    for piece, words, n, rest in _pieces(batches, also):
        unique, at, _ = _numbered(words)
        rarity = _rarity(np.bincount(at, minlength=len(unique)))
        place = np.empty(len(unique), np.int32)
        place[np.argsort(rarity, kind="stable")] = np.arange(len(unique))
        kinds, step, times = _bags(n, at, place)
        numbers = np.concatenate([plain for _, _, plain in rest])
        numbers[:, 1] = kinds / np.maximum(n, 1)
        ids, hashes = ([x for some in rest for x in some[k]] for k in range(2))
        docs = [{"id": i, "hash": h, "n": a, "kinds": b} for i, h, a, b in zip(ids, hashes, n.tolist(), kinds.tolist(), strict=True)]
        mine = (int(mixed(np.array([piece], U))[0] % U(buckets)), piece, None, None, docs, _squeeze(numbers.astype("<f2").ravel()), _squeeze(rarity), step, times)
        yield _rows([mine], _ASKED_KINDS, _ASKED_NAMES)
        edges = _edges(unique, buckets)
        rows = [(b, piece, _coded(unique[edges[b] : edges[b + 1]]), *[None] * 6) for b in range(buckets) if edges[b] < edges[b + 1]]
        if rows:
            yield _rows(rows, _ASKED_KINDS, _ASKED_NAMES)


def _numbered(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct codes, the place of each token's code in them, and the tokens by code. Empties the list as it goes on,
    so that a task holds each token's code once."""
    codes = np.concatenate(words)
    words.clear()
    order = np.argsort(codes).astype(np.int32)
    codes = codes[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
    at = np.empty(len(codes), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], at, order


def _bags(n: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """How many distinct words each document has; their places, as steps from the one before; and how often each occurs."""
    kinds, steps, times, ends = np.zeros(len(n), np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], np.cumsum(n)
    lo = 0
    while lo < len(n):  # documents of some 500,000 tokens at a time
        begin = ends[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + 500_000, "right")))
        pair = np.repeat(np.arange(hi - lo), n[lo:hi]) * len(place) + place[at[begin : ends[hi - 1]]]
        pair, often = np.unique(pair, return_counts=True)
        whose, which = pair // max(1, len(place)), pair % max(1, len(place))
        kinds[lo:hi] = np.bincount(whose, minlength=hi - lo)
        step, first = np.diff(which, prepend=0), np.flatnonzero(np.diff(whose, prepend=-1))
        step[first] = which[first]
        steps.append(step.astype(np.uint32))
        times.append(often.astype(np.uint32))
        lo = hi
    return kinds, _planed(np.concatenate(steps)), _planed(np.concatenate(times))


def _rarity(counts: np.ndarray) -> np.ndarray:
    """How rare a word is in a piece, in powers of two. Bags number words from the most frequent on, so their steps are short."""
    return (63 - np.floor(np.log2(np.maximum(counts, 1)))).astype("u1")


def _coded(codes: np.ndarray) -> bytes:
    """Sorted codes as differences, in planes of bytes."""
    return _squeeze(np.ascontiguousarray(np.diff(codes, prepend=U(0)).astype("<u8").view("u1").reshape(-1, 8)[:, :7].T).ravel())


def _codes(raw: bytes) -> np.ndarray:
    planes = _loose(raw, "u1").reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, :7] = planes.T
    return np.cumsum(out.view("<u8").ravel().astype(U))


_MET = "piece long, bucket int, vectors binary, docs array<struct<id:long,hash:long,n:int,kinds:int>>, plain binary, rarity binary, bag binary, times binary"
_MET_KINDS = [pa.int64(), pa.int32(), pa.binary(), _DOCS, *[pa.binary()] * 4]
_MET_NAMES = "piece bucket vectors docs plain rarity bag times"


#: Vectors are kept in whole parts of this size.
UNIT = 127


def scaled(total: np.ndarray) -> np.ndarray:
    """Sums at length one, in whole UNITths."""
    length = np.sqrt((total.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.rint(total * (UNIT / np.maximum(length, 1e-9))).astype(np.int64)


def _told(total: np.ndarray) -> bytes:
    """Sums on their way to a piece: those of length UNIT or less as they are, as they pack closer, the others as vectors."""
    small = (total.astype(np.float64) ** 2).sum(axis=1) <= UNIT**2
    return b"".join(len(p).to_bytes(8, "little") + p for p in (_squeeze(np.packbits(small)), _packed(np.where(small[:, None], total, scaled(total)))))


def _heard(raw: bytes) -> np.ndarray:
    """The vectors that _told() was given the sums of."""
    n = int.from_bytes(raw[:8], "little")
    out = _unpacked(raw[16 + n :])
    small = np.unpackbits(_loose(raw[8 : 8 + n], "u1"), count=len(out)).astype(bool)
    out[small] = scaled(out[small])
    return out.astype(np.int8)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket, whose sums come first: each piece is answered for its words. Bags pass through."""
    now, known, total = None, np.zeros(0, U), np.zeros((0, DIM), np.int64)
    for batch in batches:
        for i in range(len(batch)):
            key, piece, words, sums = (batch.column(c)[i].as_py() for c in ("key", "piece", "words", "sums"))
            if words is None:
                yield _rows([(piece, None, None, *(batch.column(c)[i].as_py() for c in ("docs", "plain", "rarity", "bag", "times")))], _MET_KINDS, _MET_NAMES)
            elif sums is not None:
                now, known, total = key, _codes(words), _unpacked(sums)
            else:
                own = _codes(words)
                at = np.searchsorted(known, own)
                if key != now or at[-1] == len(known) or (known[at] != own).any():
                    raise ValueError("the rows were not the same when they were read again")
                yield _rows([(piece, key, _told(total[at]), *[None] * 5)], _MET_KINDS, _MET_NAMES)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By piece: id, text hash and features of each row. A piece's rows come together: its bags, then its vectors by bucket."""

    def features(docs: list[dict], plain: bytes, rarity: bytes, bag: bytes, times: bytes, vectors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([np.zeros((0, DIM), np.int8), *vectors])[np.argsort(_loose(rarity, "u1"), kind="stable")]
        kinds, n = np.array([d["kinds"] for d in docs]), np.array([d["n"] for d in docs])
        step, times = _unplaned(bag), _unplaned(times).astype(np.int32)
        x = np.zeros((len(docs), FEATURES), "<f4")
        x[:, DIM:] = _loose(plain, "<f2").reshape(-1, PLAIN)
        x[:, DIM] = np.log1p(n) / 10
        ends = np.cumsum(kinds)
        lo = 0
        while lo < len(docs):  # in parts of some 50,000 words
            before = ends[lo] - kinds[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + _STEP, "right")))
            own, first = step[before : ends[hi - 1]], ends[lo:hi] - kinds[lo:hi] - before
            whole = np.cumsum(own)
            which = whole - np.repeat(np.concatenate([[0], whole])[first], kinds[lo:hi])
            some = np.flatnonzero(kinds[lo:hi])
            if len(some):
                sums = np.add.reduceat(table[which] * times[before : ends[hi - 1], None], first[some], axis=0, dtype=np.int64)
                x[lo + some, :DIM] = sums / (UNIT * n[lo + some, None])
            lo = hi
        for a in range(0, len(docs), 10_000):
            part = docs[a : a + 10_000]
            cols = [pa.array([d["id"] for d in part], pa.int64()), pa.array([d["hash"] for d in part], pa.int64()), pa.array([r.astype("<f2").tobytes() for r in x[a : a + 10_000]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "hash", "x"])

    now, bags, vectors = None, None, []
    for batch in batches:
        for i in range(len(batch)):
            piece, found = batch.column("piece")[i].as_py(), batch.column("vectors")[i].as_py()
            if piece != now and bags is not None:
                yield from features(*bags, vectors)
                bags, vectors = None, []
            now = piece
            if found is None:
                bags = tuple(batch.column(c)[i].as_py() for c in ("docs", "plain", "rarity", "bag", "times"))
            else:
                vectors.append(_heard(found))
    if bags is not None:
        yield from features(*bags, vectors)
    pa.default_memory_pool().release_unused()


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (xxhash64 of the text) and x, the features as 2-byte numbers, of each row; tables in the shared folder, one a slice."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_width(spark)
    buckets = parts * BUCKETS_PER_PARTITION
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    sums = texts.select("text").mapInArrow(lambda it: _dealt(it, buckets), _SUMS).repartition(parts, "key").sortWithinPartitions("key")
    totals = cut(sums.mapInArrow(_summed, _TOTALS), tidy=True)
    # a slice is read in fewer tasks, so that its pieces are as large as those of all rows and ask for few words twice
    pieces = totals.agg(F.max("pieces")).first()[0] or 1
    tasks = max(pieces // SLICES, min(pieces, spark.sparkContext.defaultParallelism))
    known = totals.select("key", F.lit(None).cast("long").alias("piece"), "words", "sums")
    done = []
    for k in range(SLICES):
        some = texts.where(F.pmod(F.xxhash64("id", "hash"), F.lit(SLICES)) == k).coalesce(tasks)
        asked = some.mapInArrow(lambda it: _asked(it, buckets), _ASKED).unionByName(known, allowMissingColumns=True)
        answers = asked.repartition(parts, "key").sortWithinPartitions("key", F.col("sums").isNull()).mapInArrow(_answered, _MET)
        met = answers.repartition(parts, "piece").sortWithinPartitions("piece", F.col("bucket").asc_nulls_first())
        done.append(cut(met.mapInArrow(_featured, "id long, hash long, x binary"), tidy=True))
    drop_cut(totals)
    return reduce(DataFrame.unionByName, done)


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f2").reshape(len(rows), FEATURES).astype(np.float64)


@dataclass
class Network:
    """Features to hidden rectified units to one logit, divided by a temperature. Without fitting: a constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss with four in five rows; the temperature with the rest."""
    if len(y) < 10 or y.min() == y.max():
        return Network(np.zeros(0), np.zeros(0), [], 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.Generator(np.random.PCG64(5))
    order = rng.permutation(len(y))
    rest, train = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[train].mean(0), x[train].std(0) + 1e-3, [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)], 1.0)
    z = (x - net.mean) / net.scale
    m, v, t = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            w1, b1, w2, b2 = net.weights
            hidden = np.maximum(z[part] @ w1 + b1, 0)
            off = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y[part]) / len(part)
            back = np.outer(off, w2) * (hidden > 0)
            grads = [z[part].T @ back + DECAY * w1, back.sum(0), hidden.T @ off + DECAY * w2, off.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit, truth = net.logits(x[rest]), y[rest]
    loss = lambda s: np.logaddexp(0, np.where(truth > 0, -logit, logit) / s).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss)) if len(rest) else 1.0
    return net


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(done: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Network:
    """The network, from the features of at most SAMPLE labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("quality")).dropna().where(~held_out(F.col("id")))
    code = F.xxhash64("id")
    sample = known.groupBy("id").agg(F.min("quality").alias("quality"))
    sample = sample.groupBy(code.bitwiseAND(F.lit(SAMPLE - 1)).alias("class")).agg(F.min(F.struct(code.alias("code"), "id", "quality")).alias("one"))
    sample = cut(sample.select("one.id", "one.quality"))
    rows = done.select("id", "x").join(F.broadcast(sample), "id").groupBy("id", "quality").agg(F.min("x").alias("x")).collect()
    drop_cut(sample)
    rows.sort(key=lambda r: r["id"])
    return fit(_matrix([r["x"] for r in rows]), np.array([r["quality"] > 0 for r in rows], np.float64))


def _scores(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, hash (of the text) and score of each row."""
    done = features(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(done, labels, id_col, label_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(_matrix(batch.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(found, pa.float64())], names=["id", "hash", "score"])

    return done.mapInArrow(scored, "id long, hash long, score double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row for each input row: id, held_out and score, the calibrated probability of label 1."""
    done = _scores(docs, labels, id_col, text_col, label_col)
    return done.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score")


def keep(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more. Rows of one id and one text go or stay together."""
    bad = _scores(docs, labels, id_col, text_col, label_col).where(F.col("score") < least)
    bad = bad.select(F.col("id").alias("bad_id"), F.col("hash").alias("bad_hash")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")
