"""Hierarchical multi-length packing of tokenized documents.

Documents become ids (a public tokenizer, then an end id). Full windows of the longest tier are cut off first; what remains
of a document is routed to the smallest tier (TIERS, powers of two) that holds it. Each tier packs its pieces best-fit, the
largest first; gaps in a window are filled with whole pieces of shorter tiers, and the last gap with the front of a piece
that is cut for it. So each window is exactly full and needs no padding. What a partition has left in the end, less than the
shortest window, is carried over: the rests of TAILS partitions are packed together in the same way, and only the last rest of
those, less than the shortest window again, is a window with padding.

Step groups: all windows are dealt to steps of about STEP_TOKENS tokens. The windows of each tier are numbered through over all
partitions and spread evenly over all steps, so any two steps differ by one window of each tier at most.

Plan: one pass without a shuffle writes windows and rests to a table in the shared folder. A partition's state is a pool of at
most POOL_TOKENS ids per tier and a bounded cache of words; nothing else is gathered. The rests (under 512 ids a partition) are
shuffled by group. To number windows through, windows are counted by partition and tier, and the running sums of those counts (a few
numbers for each task) joined back. Sequence ids are unique by partition number and counter.

The tokenizer drops white space and never joins what it parts, so words between ASCII white space are encoded once and
looked up later. Strings of special tokens count as the library reads them.

Defined cases. Null or empty text: the end id alone. Repeated rows: each is packed. Null ids: kept. Very long texts: cut into
full windows. No rows: no pieces. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, shuffle_width, small_batches

TIERS = (512, 1024, 2048, 4096)
POOL_TOKENS = 256 * 1024
STEP_TOKENS = 64 * 4096
#: Partitions whose rests are packed together.
TAILS = 64
#: Words whose ids a Python worker keeps, of those met in several groups of texts and of those met in one so far (some 80 MB
#: each); each kind is dropped at its bound, the second also when a partition ends.
CACHED_WORDS = 400_000
_SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, part long, rank long"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
#: Numbers of groups of rests begin here, beyond those of partitions.
_TAIL_PARTS = 1 << 22
_encoders: dict[str, Encoder] = {}


def _steady(word: str, stopped: bool) -> bool:
    """Whether a word is of letters that stay letters in lower case; if a stop follows, of the old alphabets' (Latin to Cyrillic)."""
    return word.isalpha() and word.lower().isalpha() and (not stopped or max(word) < "\u0530")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, with a bounded cache of words."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        self.often: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.marks_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stops = {ord(c): np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ".,"}

    def _learned(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. Words of letters alone, or of letters and a last full stop or comma, are encoded as one text: each run of
        letters then ends with the one id that marks an end, which is where the ids are parted again. A letter beyond ASCII may become
        something else in lower case (a letter and a mark, say), which joins what follows: words with such letters, or with a stop after
        letters of scripts that are still being added to, are encoded whole."""
        plain, ends, other, often = {}, [], [], self.often
        for w in new:
            head = w[:-1] if w[-1] in b".," else w
            if not head.isalpha() and not _steady(head.decode(), head is not w):  # bytes know the letters of ASCII alone
                other.append(w)
            elif head is w:
                plain[w] = None
            else:
                ends.append(w)
                if head not in often:
                    plain[head] = None
        some = list(plain)
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.marks_end[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        out = {}
        if len(last) == len(some):
            raw = ids.tobytes()
            at = [0, *(4 * last).tolist()]
            out = {w: raw[x:y] for w, x, y in zip(some, at, at[1:], strict=False)}
        else:  # a run of letters that the tokenizer parts
            other += some
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        for w in ends:
            out[w] = (often.get(w[:-1]) or out[w[:-1]]) + self.stops[w[-1]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [text.encode().split() for text in texts]
        get = self.often.get
        found = [list(map(get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        rare = {w: self.once.pop(w) for w in new & self.once.keys()}
        fresh = self._learned(new - rare.keys()) if len(new) > len(rare) else {}
        if len(self.often) + len(rare) > CACHED_WORDS:
            self.often = {}
        self.often |= rare
        if len(self.once) + len(fresh) > CACHED_WORDS:
            self.once = {}
        self.once |= fresh
        rare |= fresh
        return [b"".join([rare[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids) + self.end for words, ids in zip(split, found, strict=True)]


def _encoder(path: str, end_id: int) -> Encoder:
    key = f"{path}:{end_id}"
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


class Packer:
    """Pools by tier and windows made of them. A piece is (ids, number of its document here, start there)."""

    def __init__(self, tiers: tuple[int, ...], first_id: int) -> None:
        self.tiers = tiers
        self.pools: list[list[tuple[int, int, int, bytes]]] = [[] for _ in tiers]  # (length, document, start, ids), sorted
        self.sizes = [0] * len(tiers)
        self.next_id = first_id
        self.made = dict.fromkeys(tiers, 0)

    def add(self, doc: int, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        t = next(k for k, size in enumerate(self.tiers) if n <= size)
        bisect.insort(self.pools[t], (n, doc, start, ids))
        self.sizes[t] += n

    def _take(self, t: int, most: int) -> tuple[int, int, int, bytes] | None:
        """The longest piece of tier t that is no longer than most."""
        pool = self.pools[t]
        k = bisect.bisect_left(pool, (most + 1,)) - 1
        if k < 0:
            return None
        self.sizes[t] -= pool[k][0]
        return pool.pop(k)

    def window(self, size: int, top: int) -> list[tuple[int, int, int, bytes]]:
        """Pieces that fill size exactly, from tier top and shorter ones; the pools must hold that much."""
        out, gap = [], size
        for t in range(top, -1, -1):
            while gap and (piece := self._take(t, gap)):
                out.append(piece)
                gap -= piece[0]
        if gap:  # each piece left is longer than the gap: cut the shortest
            t = next(k for k in range(top + 1) if self.pools[k])
            n, doc, start, ids = self.pools[t].pop(0)
            self.sizes[t] -= n
            out.append((gap, doc, start, ids[: 4 * gap]))
            self.add(doc, start + gap, ids[4 * gap :])
        return out

    def numbered(self, tier: int) -> tuple[int, int]:
        """A sequence id and its number within the partition and tier."""
        self.made[tier] += 1
        self.next_id += 1
        return self.next_id - 1, self.made[tier] - 1

    def ready(self, bound: int) -> Iterator[tuple[int, list]]:
        for t, size in enumerate(self.tiers):
            while self.sizes[t] > bound and self.sizes[t] >= size:
                yield size, self.window(size, t)

    def rest(self) -> Iterator[tuple[int, list]]:
        """Full windows of what is left, until it is less than the shortest."""
        yield from self.ready(0)
        for size in reversed(self.tiers):
            while sum(self.sizes) >= size:
                yield size, self.window(size, len(self.tiers) - 1)

    def tail(self) -> list[tuple[int, int, int, bytes]]:
        return [piece for pool in self.pools for piece in pool]


class Laid:
    """Windows as rows. docs: id and ids in all of each document here, and how many of them aren't laid out yet."""

    def __init__(self, tiers: tuple[int, ...], part: int) -> None:
        self.packer, self.part = Packer(tiers, part << 40), part
        self.docs: dict[int, tuple] = {}
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, doc: int, ident: int | None, total: int, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs[doc] = (ident, total, self.docs[doc][2] + n if doc in self.docs else n)
        longest = self.packer.tiers[-1]
        while n >= longest:
            self.lay(longest, [(longest, doc, start, ids[: 4 * longest])])
            start, n, ids = start + longest, n - longest, ids[4 * longest :]
        if n:
            self.packer.add(doc, start, ids)

    def lay(self, tier: int, pieces: list, whole: bool = True) -> None:
        """A window; pieces of no window if not whole."""
        sequence, rank = self.packer.numbered(tier) if whole else (None, None)
        offset = 0
        for n, doc, start, ids in pieces:
            ident, total, left = self.docs[doc]
            self.rows.append((ident, start, n, ids, total, sequence, offset, tier if whole else None, self.part, rank))
            offset += n
            self.held += len(ids)
            if left == n:
                del self.docs[doc]
            else:
                self.docs[doc] = (ident, total, left - n)

    def flush(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), _KINDS, strict=True)], names=names)
        self.rows, self.held = [], 0
        return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Windows of a partition, and its rest as pieces of no window."""
    encoder, laid, number = _encoder(path, end_id), Laid(tiers, TaskContext.get().partitionId()), 0
    try:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for lo in range(0, len(texts), 512):
                some = [x or "" for x in texts.slice(lo, 512).to_pylist()]
                for ident, coded in zip(ids.slice(lo, 512).to_pylist(), encoder.encode(some), strict=True):
                    laid.add(number, ident, len(coded) // 4, 0, coded)
                    number += 1
                for size, pieces in laid.packer.ready(POOL_TOKENS):
                    laid.lay(size, pieces)
                if laid.held > 8 << 20:
                    yield laid.flush()
        for size, pieces in laid.packer.rest():
            laid.lay(size, pieces)
        laid.lay(0, laid.packer.tail(), whole=False)
        if laid.rows:
            yield laid.flush()
    finally:
        encoder.once = {}
        pa.default_memory_pool().release_unused()


def _pack_rests(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Windows of the rests of each group, sorted by group; the last may be shorter than its tier."""
    now, laid, number = None, None, 0

    def end() -> pa.RecordBatch:
        for size, pieces in laid.packer.rest():
            laid.lay(size, pieces)
        if last := laid.packer.tail():
            laid.lay(tiers[0], last)
        return laid.flush()

    for batch in batches:
        for row in batch.to_pylist():
            if row["group"] != now and laid:
                yield end()
            if row["group"] != now:
                now, laid, number = row["group"], Laid(tiers, _TAIL_PARTS + row["group"]), 0
            laid.add(number, row["id"], row["doc_tokens"], row["start"], row["ids"])
            number += 1
    if laid:
        yield end()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids (binary, unsigned little-endian 32 bit), doc_tokens, sequence_id, offset,
    tier (the sequence's length; the last of each group of rests may be shorter) and step."""
    spark = docs.sparkSession
    small_batches(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = cut(picked.mapInArrow(lambda it: _pack(it, tokenizer_path, end_id, tiers), _SCHEMA))
    rests = made.where("tier is null").withColumn("group", F.expr(f"part div {TAILS}"))
    rests = rests.repartition(shuffle_width(spark), "group").sortWithinPartitions("group", "part", "length", "id", "start")
    tails = cut(rests.select("group", "id", "start", "ids", "doc_tokens").mapInArrow(lambda it: _pack_rests(it, tiers), _SCHEMA))
    windows = made.where("tier is not null").unionByName(tails)
    counts = cut(windows.groupBy("part", "tier").agg((F.max("rank") + 1).alias("n"), F.sum("length").alias("tokens")))
    steps = max(1, round((counts.agg(F.sum("tokens")).first()[0] or 0) / STEP_TOKENS))
    of_tier = Window.partitionBy("tier").orderBy("part")
    before = F.coalesce(F.sum("n").over(of_tier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("part", "tier", before.alias("first"), F.sum("n").over(Window.partitionBy("tier")).alias("windows"))
    # Spark broadcasts the counts while they are small, by its own threshold
    done = windows.join(firsts, ["part", "tier"])
    cols = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier"]
    return done.select(F.col("id").alias(id_col), *cols, F.expr(f"(rank + first) * {steps} div windows").alias("step"))
