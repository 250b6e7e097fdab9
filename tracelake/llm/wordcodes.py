"""Words of Arrow text columns as 64-bit codes, by numpy over whole buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes looked at together; a longer text is one chunk of its own.
CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Odd factors for codes of word sequences, one for each place.
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_R = U(0x9E3779B97F4A7C15 | 5)
_R_INV = U(pow(int(_R), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of R and of its inverse, at least n of each; kept up to CHUNK."""
    size = max(CHUNK, n)
    if size not in _powers:
        pair = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size, r, U)])) for r in (_R, _R_INV))
        if size > CHUNK:
            return pair
        _powers[size] = pair
    return _powers[size]


@dataclass
class Chunk:
    """Words of the documents lo to hi - 1 of a batch: first[k] to first[k + 1] are the words of document lo + k."""

    lo: int
    hi: int
    words: np.ndarray  # codes
    first: np.ndarray
    starts: np.ndarray  # byte offsets in data
    ends: np.ndarray
    data: np.ndarray  # bytes of the documents, lower-cased if asked for
    raw: np.ndarray  # the same bytes as they are
    at: np.ndarray  # byte offsets of the documents in data

    def of(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """The column's documents in chunks of about CHUNK bytes; every document lies in one chunk, whole."""
    at, data = _buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        raw = data[at[lo] : at[hi]]
        yield _chunk(lo, hi, _LOWER[raw] if lower else raw, at[lo : hi + 1] - at[lo], raw)
        lo = hi


def _chunk(lo: int, hi: int, data: np.ndarray, at: np.ndarray, raw: np.ndarray) -> Chunk:
    n = len(data)
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < n)]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    words = np.empty(len(starts), U)
    i = 0
    while i < len(starts):  # a long text in slices between words, so that tables of powers stay small
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK // 2)))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, U)
        np.cumsum(_OF_BYTE[data[a:b]] * up[: b - a], out=total[1:])
        words[i:j] = mixed((total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a])
        i = j
    return Chunk(lo, hi, words, np.searchsorted(starts, at), starts, ends, data, raw, at)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Codes of all k consecutive words (k up to 64)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n] * PLACES[0]
    for j in range(1, k):
        out += words[j : j + n] * PLACES[j]
    return mixed(out)


def rolling(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Codes of all k consecutive words by running sums, for long k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(len(words))
    own = mixed(words + U(seed)) if seed else words
    total = np.zeros(len(words) + 1, U)
    np.cumsum(own * up[: len(words)], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[:n])


@dataclass
class Spans:
    """Words of the documents lo to hi - 1 of a batch as byte ranges of data; first[k] to first[k + 1] are those of document lo + k."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def spans(column: pa.Array, inside: np.ndarray) -> Iterator[Spans]:
    """Maximal runs of the bytes that ``inside`` (256 flags) marks, document by document, in chunks of about CHUNK bytes of whole
    documents."""
    at, data = _buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        part, edges = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        word = inside[part]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        cuts = edges[(edges > 0) & (edges < len(part))]
        begins[cuts] = word[cuts]
        stops[cuts - 1] = word[cuts - 1]
        starts = np.flatnonzero(begins)
        yield Spans(lo, hi, part, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, edges))
        lo = hi
