"""LM scoring by context-tree weighting over bytes, beside an add-one-tenth word model.

Plan: 1. One scan cuts each task's texts into pieces, kept in a table in the shared folder: a piece's texts, packed; its words'
codes in key buckets; its distinct grams (DEPTH bytes and the next) as sorted 48-bit codes with training counts, 0 for grams of
held-out rows alone, dealt by the two nearest bytes, so that whole subtrees meet in one place. 2. By bucket, gram counts are
summed to a table in the shared folder. What the two top levels need (256 rows) comes to the driver and is sent out; all else
of the tree stays dealt. 3. By bucket, the costs of all grams are worked out from the whole tree and answered to each piece
that asks; words are looked up the same way. 4. By piece, texts, costs and word sums meet. Texts are shuffled once, packed.

Rows stand for themselves: results are told apart by piece and place, not by id. Words are 64-bit codes.

Defined cases. Null or empty text: only the end. Null id: not held out. No training rows: every count is 0, and the tree gives
each byte one in 256. Repeated rows: each is scored, and each counts if it trains. No rows: no result rows. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import context_tree as ct
from tracelake.llm.common import cut, shuffle_width, small_batches
from tracelake.llm.wordcodes import U, chunks

#: Bytes of text gathered before a piece is dealt out.
PIECE = 8 << 20
BUCKETS_PER_PARTITION = 2
_GRAMS = "bucket int, keys binary, counts binary"
_PARTS = "piece long, places binary, sums binary, known binary, n long, v long"


def _squeeze(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _loose(raw: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def _keyed(bucket: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    return bucket, _squeeze(np.diff(keys, prepend=U(0)).astype("<u8")), _squeeze(counts.astype("<u8"))


def _unkeyed(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_loose(keys, "<u8").astype(U)), _loose(counts, "<u8").astype(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U(32)) * U(2654435761) >> U(7)) % U(buckets)).astype(np.int64)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key, of batches sorted by key."""
    now, rows = None, []
    for batch in batches:
        for i in range(len(batch)):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's grams, summed."""
    for bucket, rows in _by_key(batches, "bucket"):
        both = [_unkeyed(r["keys"], r["counts"]) for r in rows]
        keys, counts = ct.merged([b[0] for b in both], [b[1] for b in both])
        yield _rows([_keyed(bucket, keys, counts)], [pa.int32(), pa.binary(), pa.binary()], "bucket keys counts")


_FLAT = 256 + 255  # counts, sums of ln weighted probabilities


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each context of one byte gets from its subtrees in a bucket."""
    for batch in batches:
        for i in range(len(batch)):
            keys, counts = _unkeyed(batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py())
            flat = np.concatenate(ct.top_sums(keys, counts), axis=1)
            rows = [(int(c), flat[c].astype("<f8").tobytes()) for c in np.unique(keys >> U(40)).astype(np.int64)]
            yield _rows(rows, [pa.int32(), pa.binary()], "nearest flat")


def _top_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nearest, rows in _by_key(batches, "nearest"):
        flat = sum(np.frombuffer(r["flat"], "<f8") for r in sorted(rows, key=lambda r: r["flat"]))
        yield _rows([(nearest, flat.tobytes())], [pa.int32(), pa.binary()], "nearest flat")


def _upper(grams: DataFrame) -> tuple[np.ndarray, ...]:
    """The two top levels of the tree."""
    parts = shuffle_width(grams.sparkSession)
    tops = grams.select("keys", "counts").mapInArrow(_tops, "nearest int, flat binary")
    tops = tops.repartition(parts, "nearest").sortWithinPartitions("nearest").mapInArrow(_top_sums, "nearest int, flat binary")
    flat = np.zeros((256, _FLAT))
    for r in tops.collect():  # at most 256
        flat[r["nearest"]] = np.frombuffer(r["flat"], "<f8")
    return ct.upper(flat[:, :256], flat[:, 256:])


def _answered(batches: Iterator[pa.RecordBatch], upper: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """By bucket, its grams first (piece -1), then what pieces ask for: costs of their grams."""
    known, cost = np.zeros(0, U), np.zeros(0)
    for batch in batches:
        rows = []
        for i in range(len(batch)):
            bucket, piece, keys, counts = (batch.column(c)[i].as_py() for c in ("bucket", "piece", "keys", "counts"))
            if piece < 0:
                known, counts = _unkeyed(keys, counts)
                cost = ct.gram_costs(known, counts, upper)
            else:
                asked = np.cumsum(_loose(keys, "<u8").astype(U))
                rows.append((piece, bucket, _squeeze(cost[np.searchsorted(known, asked)].astype("<f4"))))
        if rows:
            yield _rows(rows, [pa.int64(), pa.int32(), pa.binary()], "piece bucket costs")


def fit(texts: DataFrame) -> ct.Model:
    """The whole tree of the column ``text`` as one dense table on the driver, for small texts; score() doesn't use it."""
    keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for r in texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        at = np.array([0, len(raw)])
        data, begin = ct.stream(raw, at)
        keys.append(ct.gram_codes(data, ct.symbols(data, begin, np.diff(at))))
        counts.append(np.ones(len(keys[-1]), np.int64))
    found = ct.levels(*ct.merged(keys, counts), 0)
    costs = [ct.byte_costs(one) for one in ct.leaf_ones(found)]
    root = costs[0] if len(costs[0]) else ct.byte_costs(np.full((1, 255), 0.5))
    return ct.assemble([x.code for x in found[1:]], [x.split for x in found[1:]], costs[1:], root)


_DOCS = "array<struct<id:long,held:boolean,n:long,size:long>>"
_kinds = pa.list_(pa.struct([("id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64()), ("size", pa.int64())]))
_PIECES = f"bucket int, piece long, words binary, word_counts binary, word_of binary, doc_of binary, times binary, keys binary, counts binary, docs {_DOCS}, packed binary"


def _grams(raw: np.ndarray, at: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of documents and how often they occur in those that train."""
    data, begin = ct.stream(raw, at)
    n = np.diff(at)
    places, flag = ct.symbols(data, begin, n), np.repeat(train.astype(U), n + 1)
    keys, counts = [], []
    for a in range(0, len(places), 1 << 20):
        code = ct.gram_codes(data, places[a : a + (1 << 20)]) << U(1) | flag[a : a + (1 << 20)]
        both, count = np.unique(code, return_counts=True)
        keys.append(both >> U(1))
        counts.append(count * (both & U(1)).astype(np.int64))
    return ct.merged(keys, counts)


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents: a row with the texts, and a row for each bucket with its words, their training counts and (word,
    document, times), and its grams and their training counts."""
    piece = TaskContext.get().partitionId() << 40
    words, docs_of, docs, keys, counts, raw = [], [], [], [], [], []
    held = 0

    def deal() -> pa.RecordBatch:
        code, doc = np.concatenate(words), np.concatenate(docs_of)
        unique, at = np.unique(code, return_inverse=True)
        train = np.array([not d["held"] for d in docs])
        pair, times = np.unique(at.astype(np.int64) * len(docs) + doc, return_counts=True)
        word_of, doc_of = pair // len(docs), pair % len(docs)
        count = np.bincount(word_of, weights=times * train[doc_of], minlength=len(unique)).astype("<u4")
        # codes are sorted, so a bucket of their highest bits is a range of them
        bucket = ((unique >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        pair_edges = np.searchsorted(word_of, edges)
        gram, gram_count = ct.merged(keys, counts)
        gram_bucket = _bucket(gram, buckets)
        order = np.argsort(gram_bucket, kind="stable")
        gram, gram_count = gram[order], gram_count[order]
        gram_edges = np.searchsorted(gram_bucket[order], np.arange(buckets + 1))
        rows = [(-1, piece, *[None] * 7, docs, _squeeze(np.concatenate(raw)))]
        for b in range(buckets):
            x, y = edges[b], edges[b + 1]
            p, q = pair_edges[b], pair_edges[b + 1]
            g, h = gram_edges[b], gram_edges[b + 1]
            if x < y or g < h:
                mine = (unique[x:y].tobytes(), _squeeze(count[x:y]), _squeeze((word_of[p:q] - x).astype("<u4")), _squeeze(doc_of[p:q].astype("<u4")), _squeeze(times[p:q].astype("<u4")))
                rows.append((b, piece, *(mine if x < y else [None] * 5), *(_keyed(b, gram[g:h], gram_count[g:h])[1:] if g < h else [None] * 2), None, None))
        return _rows(rows, [pa.int32(), pa.int64(), *[pa.binary()] * 7, _kinds, pa.binary()], "bucket piece words word_counts word_of doc_of times keys counts docs packed")

    for batch in batches:
        ids, out = batch.column("id").to_pylist(), batch.column("held").to_pylist()
        for chunk in chunks(batch.column("text"), lower=True):
            n, size = np.diff(chunk.first), np.diff(chunk.at)
            words.append(chunk.words)
            docs_of.append(np.repeat(np.arange(len(n)), n) + len(docs))
            docs += [{"id": ids[chunk.lo + k], "held": out[chunk.lo + k], "n": int(n[k]) + 1, "size": int(size[k])} for k in range(len(n))]
            key, count = _grams(chunk.raw, chunk.at, ~np.array(out[chunk.lo : chunk.hi], bool))
            keys.append(key)
            counts.append(count)
            raw.append(chunk.raw)
            held += len(chunk.raw) + len(n)
            if held > PIECE:
                yield deal()
                piece += 1
                words, docs_of, docs, keys, counts, raw = [], [], [], [], [], []
                held = 0
    if docs:
        yield deal()


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket: training counts of its words, then each piece's sums by document; n and v are the bucket's tokens and words."""
    for _, rows in _by_key(batches, "bucket"):
        words = [np.frombuffer(r["words"], "<u8") for r in rows]
        counts = [_loose(r["word_counts"], "<u4") for r in rows]
        unique, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)) if len(unique) else np.zeros(0)
        cost, known = np.log10(total + 0.1), total > 0
        lo, out = 0, []
        for r, w in zip(rows, words, strict=True):
            mine = at[lo : lo + len(w)][_loose(r["word_of"], "<u4")] if len(w) else np.zeros(0, np.int64)
            doc, times = _loose(r["doc_of"], "<u4"), _loose(r["times"], "<u4").astype(np.float64)
            sums, seen = np.bincount(doc, weights=times * cost[mine]), np.bincount(doc, weights=times * known[mine])
            places = np.unique(doc)
            first = not out
            out.append((r["piece"], _squeeze(places.astype("<u4")), _squeeze(sums[places]), _squeeze(seen[places].astype("<u4")), int(total.sum()) if first else 0, int(known.sum()) if first else 0))
            lo += len(w)
        yield _rows(out, [pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64()], "piece places sums known n v")


def _text_costs(raw: np.ndarray, size: np.ndarray, costs: list[np.ndarray], buckets: int) -> np.ndarray:
    """Sums of the costs of each document's symbols; costs are those of the piece's distinct grams, by bucket and code."""
    data, begin = ct.stream(raw, np.concatenate([[0], np.cumsum(size)]))
    found, ends, lo = [], np.cumsum(size + 1), 0
    while lo < len(size):  # documents of about a million symbols at a time
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] - 1 + (1 << 20), "right")))
        key, at = np.unique(ct.gram_codes(data, ct.symbols(data, begin[lo:hi], size[lo:hi])), return_inverse=True)
        found.append((lo, hi, key, at.astype(np.int32)))
        lo = hi
    keys = np.unique(np.concatenate([key for _, _, key, _ in found]))
    cost = np.zeros(len(keys))
    cost[np.argsort(_bucket(keys, buckets), kind="stable")] = np.concatenate(costs)
    out = np.zeros(len(size))
    for lo, hi, key, at in found:
        n = size[lo:hi] + 1
        out[lo:hi] = np.add.reduceat(cost[np.searchsorted(keys, key)][at], np.cumsum(n) - n)
    return out


def _put_together(batches: Iterator[pa.RecordBatch], trained: int, n: int, v: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_key(batches, "piece"):
        docs, packed = next((r["docs"], r["packed"]) for r in rows if r["docs"] is not None)
        costs = [_loose(r["costs"], "<f4") for r in sorted((r for r in rows if r["costs"] is not None), key=lambda r: r["bucket"])]
        score = -_text_costs(_loose(packed, "u1"), np.array([d["size"] for d in docs]), costs, buckets)
        sums, known = np.full(len(docs), np.log10(trained + 0.1)), np.full(len(docs), int(trained > 0), np.int64)
        for r in sorted((r for r in rows if r["sums"] is not None), key=lambda r: r["sums"]):  # the same order at each run, so the same rounding
            places = _loose(r["places"], "<u4")
            sums[places] += _loose(r["sums"], "<f8")
            known[places] += _loose(r["known"], "<u4")
        tokens = np.array([d["n"] for d in docs])
        base = sums - tokens * np.log10(n + 0.1 * (v + 1))
        out = [(d["id"], d["held"], d["n"], int(k), n, float(b), float(s), d["size"]) for d, k, b, s in zip(docs, known, base, score, strict=True)]
        yield _rows(out, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64()], "id held_out n_tokens n_known train_tokens base_score score n_bytes")
    pa.default_memory_pool().release_unused()


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score (the word model's), score (the tree's
    log10 probability of the text and its end), n_bytes and bits_per_byte (code length, the end included)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_width(spark)
    buckets = parts * BUCKETS_PER_PARTITION
    texts = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(lambda it: _dealt(it, buckets), _PIECES))
    asked = pieces.where("keys is not null")
    grams = cut(asked.select("bucket", "keys", "counts").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_summed, _GRAMS))
    upper = _upper(grams)
    both = grams.select("bucket", F.lit(-1).cast("long").alias("piece"), "keys", "counts").unionByName(asked.select("bucket", "piece", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "piece").mapInArrow(lambda it: _answered(it, upper), "piece long, bucket int, costs binary")
    dealt = pieces.where("words is not null").select("bucket", "piece", "words", "word_counts", "word_of", "doc_of", "times")
    found = cut(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_looked_up, _PARTS))
    whole = pieces.where("docs is not null").select("piece", "docs", "packed")
    sums = found.agg(F.sum("n"), F.sum("v")).first()
    trained = whole.agg(F.sum(F.size(F.filter("docs", lambda d: ~d["held"])))).first()
    words, kinds, rows = (int(x or 0) for x in (*sums, *trained))
    n, v = words + rows, kinds + (rows > 0)
    met = whole.unionByName(answers, allowMissingColumns=True).unionByName(found.drop("n", "v"), allowMissingColumns=True)
    done = met.repartition(parts, "piece").sortWithinPartitions("piece")
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    out = done.mapInArrow(lambda it: _put_together(it, rows, n, v, buckets), schema)
    return out.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).withColumnRenamed("id", id_col)
