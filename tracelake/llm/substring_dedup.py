"""Substring dedup by fixed-block anchors: words that lie in a WINDOW-word passage that an earlier document holds are removed.

Any window of 50 words holds a whole block of 25 of its own document's non-overlapping blocks. So:

1. All blocks are an index; every rolling 25-word window of every document probes it. Both travel as 40-bit codes in key
   buckets, packed per Arrow batch and bucket. A code that is a block somewhere and occurs in two documents is an anchor.
2. Documents with anchors, and only those, are fetched again. Each anchor is extended to the 50-word windows around it. Their
   codes, 96 bits of two independent ones (among 10^12 windows two differ under one code with a chance below 10^-5), go to key
   buckets once a piece of documents, with the least document of the piece that has the window; buckets find the least of all.
3. Where that is smaller than the piece's own, it comes back. Windows that a smaller document holds overlap and merge into maximal
   exact repeats, the spans that are removed.

No pairs of documents are made: a passage in a third of all documents is one key, whose entries are read linearly (one a document
in step 1, one a piece in step 2), and other keys of its bucket are few. Anchors that meet by chance fall away in step 2.

Plan: texts are shuffled twice, to meet their anchors (after a bitmap of fixed size has sifted the others out) and their
spans. Buckets are handled one after another: a task holds one bucket at a time; more buckets than partitions
(BUCKETS_PER_PARTITION) keep them small. Each step ends in a table in the shared folder.

Defined cases. Null text or no words: nothing is removed. Fewer than 50 words: no window. Repeated rows and rows that share an
id: one document, nothing is removed for its own sake; each row gets its result, with the spans found in its own text.
Null ids: never smaller or larger, nothing is removed. No rows: no result rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, shuffle_width, small_batches
from tracelake.llm.quality_classifier import _planed, _unplaned
from tracelake.llm.wordcodes import U, chunks, rolling

WINDOW = 50
BLOCK = WINDOW // 2
BUCKETS_PER_PARTITION = 4
#: The bitmap has 2^23 bits: 1 MB at any size of the corpus. Where it fills up, more texts are fetched, none fewer.
BITMAP_BITS = 1 << 23
#: Windows that a task gathers before it deals them out.
HELD_WINDOWS = 500_000
_CODE = U((1 << 40) - 1)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (((codes >> U(40)) * U(buckets)) >> U(24)).astype(np.int64)


def _packed(codes: np.ndarray) -> bytes:
    """The low 40 bits of each code."""
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Slowly changing whole numbers, as differences, compressed."""
    return len(numbers).to_bytes(8, "little") + pa.compress(np.diff(numbers, prepend=0).astype("<i8").tobytes(), "zstd", asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), "<i8"))


def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket, and (bucket, from, to) in it."""
    order = np.argsort(buckets, kind="stable")
    at = buckets[order]
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    return order, [(int(at[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]


def _probes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1, map side: bucket, codes of rolling windows (once a document), their documents, codes of blocks."""
    codes, docs, blocks, held = [], [], [], 0
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column("text")):
            for k in range(chunk.hi - chunk.lo):
                own = rolling(chunk.of(k), BLOCK)
                if len(own) <= WINDOW - BLOCK:
                    continue
                blocks.append(own[::BLOCK])
                own = np.unique(own)
                codes.append(own)
                docs.append(np.full(len(own), ids[chunk.lo + k]))
                held += len(own)
            if held > HELD_WINDOWS:
                yield _dealt(codes, docs, blocks, buckets)
                codes, docs, blocks, held = [], [], [], 0
    if held:
        yield _dealt(codes, docs, blocks, buckets)


def _dealt(codes: list[np.ndarray], docs: list[np.ndarray], blocks: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Windows and blocks as a packed row for each bucket."""
    code, doc, block = np.concatenate(codes), np.concatenate(docs), np.unique(np.concatenate(blocks))
    order, runs = _by_bucket(_bucket(code, buckets))
    code, doc = code[order], doc[order]
    block_order, block_runs = _by_bucket(_bucket(block, buckets))
    block = block[block_order]
    of = {b: (x, y) for b, x, y in block_runs}
    rows = [(b, _packed(code[x:y]), _squeezed(doc[x:y]), _packed(block[slice(*of.get(b, (0, 0)))])) for b, x, y in runs]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "codes", "docs", "blocks"])


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each bucket, of batches sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(batch.column("bucket").to_pylist(), *(batch.column(n) for n in names), strict=True):
            if b != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = b
            rows.append(tuple(x.as_py() for x in row))
    if rows:
        yield bucket, rows


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, reduce side: id and key (bucket and code) of each anchor in each document."""
    for bucket, rows in _grouped(batches, ["codes", "docs", "blocks"]):
        blocks = np.unique(np.concatenate([_unpacked(r[2]) for r in rows]))
        codes, docs = [], []
        for raw, who, _ in rows:
            code = _unpacked(raw)
            at = np.searchsorted(blocks, code)
            hit = blocks[np.minimum(at, len(blocks) - 1)] == code if len(blocks) else np.zeros(len(code), bool)
            codes.append(code[hit])
            docs.append(_spread(who)[hit])
        code, doc = np.concatenate(codes), np.concatenate(docs)
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.diff(code, prepend=~code[:1]) != 0) if len(code) else np.zeros(0, np.int64)
        if not len(first):
            continue
        shared = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = np.repeat(shared, np.diff([*first, len(code)]))
        key = (code[keep] | (U(bucket) << U(40))).astype(np.int64)
        for lo in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep][lo : lo + 100_000]), pa.array(key[lo : lo + 100_000])], names=["id", "key"])


def _candidates(words: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Starts of the 50-word windows that hold an anchor."""
    own = rolling(words, BLOCK)
    if len(own) <= WINDOW - BLOCK:
        return np.zeros(0, np.int64)
    key = (own & _CODE) | (_bucket(own, buckets).astype(U) << U(40))
    at = np.flatnonzero(np.isin(key, keys))
    change = np.zeros(len(words) + 2, np.int64)
    np.add.at(change, np.maximum(at - (WINDOW - BLOCK), 0), 1)
    np.add.at(change, at + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: len(words) - WINDOW + 1] > 0)


_WINDOWS = "piece long, bucket int, codes binary, extras binary, least binary, sizes binary, docs binary, starts binary, ids binary, texts binary"


def _extended(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 2, map side: a row for each piece, of its documents in order (ids and text hashes), and a row for each piece and bucket:
    distinct windows (codes, the least document, how many there are), then documents, by their places in that order, and starts of all
    of them, window by window."""
    piece = TaskContext.get().partitionId() << 40
    names = [c.split()[0] for c in _WINDOWS.split(", ")]
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 8)
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("hash").to_numpy(zero_copy_only=False)
        keys = batch.column("keys")
        for chunk in chunks(batch.column("text")):
            codes, extras, starts, own_rows = [], [], [], []
            for k in range(chunk.hi - chunk.lo):
                row = chunk.lo + k
                at = _candidates(chunk.of(k), keys[row].values.to_numpy(zero_copy_only=False).astype(U), buckets)
                if len(at):
                    codes.append(rolling(chunk.of(k), WINDOW, 7)[at])
                    extras.append((rolling(chunk.of(k), WINDOW, 11)[at] >> U(32)).astype("<u4"))
                    starts.append(at)
                    own_rows.append(row)
            if not codes:
                continue
            ranked = np.lexsort((texts[own_rows], ids[own_rows]))
            who, which = ids[own_rows][ranked], texts[own_rows][ranked]
            doc = np.repeat(np.argsort(ranked), [len(at) for at in starts])  # a smaller place is no larger an id
            code, extra, start = (np.concatenate(x) for x in (codes, extras, starts))
            order = np.lexsort((start, doc, extra, code))  # buckets are ranges of codes
            code, extra, start, doc = code[order], extra[order], start[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (extra[1:] != extra[:-1])]))
            size = np.diff([*first, len(code)])
            _, runs = _by_bucket(_bucket(code[first], buckets))
            rows = [(piece, -1, *[None] * 6, _squeezed(who), which.astype("<i8").tobytes())]
            for b, x, y in runs:
                own = slice(first[x], first[y - 1] + size[y - 1])
                f = first[x:y]
                rows.append((piece, b, code[f].tobytes(), extra[f].tobytes(), _squeezed(who[doc[f]]), _planed(size[x:y]), _planed(doc[own]), _planed(start[own]), None, None))
            piece += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, reduce side: for each piece of a bucket the places of its windows that a document smaller than its own least holds,
    and that document."""
    for bucket, rows in _grouped(batches, ["piece", "codes", "extras", "least"]):
        code, extra = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((1, "<u8"), (2, "<u4")))
        own = [_spread(r[3]) for r in rows]
        at, least = np.cumsum([0, *map(len, own)]), np.concatenate(own)
        order = np.lexsort((extra, code))
        code, extra = code[order], extra[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (extra[1:] != extra[:-1])])
        found = np.empty_like(least)
        found[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out = []
        for r, a, b in zip(rows, at, at[1:], strict=False):
            if len(smaller := np.flatnonzero(found[a:b] < least[a:b])):
                out.append((r[0], bucket, _squeezed(smaller), _squeezed(found[a:b][smaller])))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["piece", "bucket", "places", "found"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: id, text hash and starts of repeated windows: a row for each document of a piece. A piece's rows come together: its
    documents, then by bucket its windows, then what was found for them, if anything."""
    piece, who, which, waiting, doc, start = None, None, None, None, [], []

    def settle(places: bytes | None = None, smaller: bytes | None = None) -> None:
        sizes, docs, starts = map(_unplaned, waiting)
        least = who[docs[np.cumsum(sizes) - sizes]]  # a window's documents are in order
        if places is not None:
            least[_spread(places)] = _spread(smaller)
        hit = who[docs] > np.repeat(least, sizes)
        doc.append(docs[hit])
        start.append(starts[hit])

    def emit() -> Iterator[pa.RecordBatch]:
        at, s = np.concatenate(doc), np.concatenate(start)
        if not len(at):
            return
        d, t = who[at], which[at]
        order = np.lexsort((s, t, d))
        d, t, s = d[order], t[order], s[order].astype("<i4")
        cuts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        out = [(int(d[a]), int(t[a]), s[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(d)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "hash", "starts"])

    for batch in batches:
        columns = [batch.column(n) for n in ("piece", "sizes", "docs", "starts", "ids", "texts", "places", "found")]
        for i in range(len(batch)):
            now, *windows, ids, texts, places, smaller = (c[i].as_py() for c in columns)
            if places is not None:
                settle(places, smaller)
                waiting = None
                continue
            if waiting:
                settle()
                waiting = None
            if now != piece:
                if doc:
                    yield from emit()
                piece, who, which, doc, start = now, _spread(ids), np.frombuffer(texts, "<i8"), [], []
            else:
                waiting = windows
    if waiting:
        settle()
    if doc:
        yield from emit()


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, len(whole), 500)):
        n_words, n_removed, kept, spans = [], [], [], []
        for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
            words = (text.as_py() or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            raw = starts.as_py()
            if raw:
                at = np.concatenate([np.frombuffer(x, "<i4") for x in raw])
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
                off = np.cumsum(gone) > 0
                edges = np.flatnonzero(np.diff(off, prepend=False)).tolist()
                pairs = list(zip(edges[::2], edges[1::2], strict=True))
                left = [w for w, x in zip(words, off, strict=False) if not x]
            else:
                pairs, left = [], words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
            spans.append([{"start": a, "end": b} for a, b in pairs])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], names=["id", "n_words", "n_removed", "kept", "spans"])


def _sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents that may have one of ids: none that has is lost. The bitmap's size is fixed."""
    place = F.xxhash64("id").bitwiseAND(F.lit(BITMAP_BITS - 1))
    parts = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((BITMAP_BITS // 32768 + 2, 4096), np.uint8)
    for r in parts.collect():  # at most 257 rows of 4 KB
        bits[r["b"]] = np.frombuffer(r["bits"], np.uint8)
    flat = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may(b, p):  # noqa: ANN001, ANN202
        import pandas as pd

        b, p = b.to_numpy(), p.to_numpy()
        return pd.Series((flat.value[b, p // 8] >> (p % 8).astype(np.uint8)) & 1 > 0)

    def bit(f) -> Column:  # noqa: ANN001
        return f(place).cast("int")

    return docs.where(may(bit(F.bitmap_bucket_number), bit(F.bitmap_bit_position)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_words, n_removed, kept (the words left, joined by one space) and spans (removed, in words,
    array of struct<start, end>)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_width(spark)
    buckets = min(parts * BUCKETS_PER_PARTITION, 1 << 20)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    known = texts.where("id is not null")
    probes = known.select("id", "text").mapInArrow(lambda it: _probes(it, buckets), "bucket int, codes binary, docs binary, blocks binary")
    anchors = probes.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_anchors, "id long, key long")
    keys = cut(anchors.groupBy("id").agg(F.collect_set("key").alias("keys")))
    some = _sifted(known, keys.select("id"))
    pieces = cut(some.join(keys, "id").select("id", "hash", "text", "keys").mapInArrow(lambda it: _extended(it, buckets), _WINDOWS))
    asked = pieces.where("bucket >= 0").select("bucket", "piece", "codes", "extras", "least").repartition(parts, "bucket").sortWithinPartitions("bucket")
    smaller = asked.mapInArrow(_repeats, "piece long, bucket int, places binary, found binary")
    both = pieces.select("piece", "bucket", "sizes", "docs", "starts", "ids", "texts").unionByName(smaller, allowMissingColumns=True)
    both = both.repartition(parts, "piece").sortWithinPartitions("piece", "bucket", F.col("places").isNotNull())
    found = both.mapInArrow(_found, "id long, hash long, starts binary")
    found = found.groupBy("id", "hash").agg(F.collect_list("starts").alias("starts"))
    schema = "id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
    return texts.join(found, ["id", "hash"], "left").select("id", "text", "starts").mapInArrow(_cleaned, schema).withColumnRenamed("id", id_col)
