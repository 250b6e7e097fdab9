"""Context-tree weighting over bytes: the tree's counts, its mixture weights, and the costs of bytes in their contexts.

A context is up to DEPTH bytes, the nearest first. Each byte is eight binary decisions, so a context has 255 binary nodes
with counts (a, b) and the Krichevsky-Trofimov estimate. The weighted probability of a node is one half of its own estimate
plus one half of the product of its children's, from the deepest contexts up to the empty one; fitted on the training texts,
its parts give the share of each depth in a prediction. A text's probability is the product over its bytes and an end mark.

Size: every context of the training texts is told apart, however rare; none shares a leaf. gram_costs() keeps only nodes on
the paths of bytes that occur, so its work and memory follow the distinct grams. Model is a dense table for small texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
DEPTH = 5
END = 0xFF  # no byte of UTF-8
#: Steps of a table entry: minus log10 of a probability in units of 1 / SCALE.
SCALE = 2048
_LGAMMA_HALF = 0.5723649429247001  # ln gamma(1/2)


def stream(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents between DEPTH end marks each, and where each begins; the mark after a document is its last symbol."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.full(len(raw) + DEPTH * (len(n) + 1), END, np.uint8)
    out[np.arange(len(raw)) + DEPTH * (doc + 1)] = raw
    return out, at[:-1] + DEPTH * (np.arange(len(n)) + 1)


def symbols(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of all symbols of documents that begin there and have n bytes and an end."""
    total = int((n + 1).sum())
    first = np.cumsum(n + 1) - (n + 1)
    return np.arange(total) - np.repeat(first, n + 1) + np.repeat(begin, n + 1)


def gram_codes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before a place, the nearest in the highest byte, then the byte there."""
    code = np.zeros(len(places), U)
    for k in range(1, DEPTH + 1):
        code = (code << U(8)) | data[places - k].astype(U)
    return (code << U(8)) | data[places].astype(U)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, sorted."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count[order], first)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x of 1/2 or more, by Stirling's series after five steps of the recurrence."""
    y = x + 5
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4))


def splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 binary nodes, from counts of bytes (rows of 256)."""
    zero, one = [], []
    for level in range(8):
        part = counts.reshape(len(counts), 1 << level, 2, 1 << (7 - level)).sum(axis=3)
        zero.append(part[:, :, 0])
        one.append(part[:, :, 1])
    return np.concatenate(zero, 1), np.concatenate(one, 1)


def log_estimate(counts: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of all decisions at each node."""
    a, b = splits(counts)
    return kt(a, b)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the estimate's probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - 2 * _LGAMMA_HALF


def next_one(counts: np.ndarray) -> np.ndarray:
    """The estimate's next probability of a one at each node."""
    a, b = splits(counts)
    return (b + 0.5) / (a + b + 1)


def weigh(counts: np.ndarray, rest: np.ndarray, below: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln weighted probability and the own estimate's share at each node. rest: counts of the shared leaf; below: sums of the
    children's ln weighted probabilities; split: which contexts have children that are told apart."""
    own = log_estimate(counts)
    both = np.logaddexp(own, below + log_estimate(rest)) - np.log(2)
    weighted = np.where(split[:, None], both, own)
    return weighted, np.where(split[:, None], np.exp(np.minimum(own - np.log(2) - weighted, 0)), 1.0)


def byte_costs(one: np.ndarray) -> np.ndarray:
    """Entries of the table from the probabilities of a one at each node."""
    cost = np.zeros((len(one), 256))
    byte, first = np.arange(256), 0
    for level in range(8):
        p = one[:, first + (byte >> (8 - level))]
        bit = (byte >> (7 - level)) & 1
        cost -= np.log10(np.where(bit, p, 1 - p))
        first += 1 << level
    return np.minimum(np.round(cost * SCALE), 65535).astype(np.uint16)


@dataclass
class Level:
    """Contexts of one depth that are told apart: codes (sorted), byte counts and, from fold(), weights."""

    code: np.ndarray
    counts: np.ndarray
    parent: np.ndarray
    rest: np.ndarray | None = None
    split: np.ndarray | None = None
    weighted: np.ndarray | None = None
    share: np.ndarray | None = None


def context_totals(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a depth, their totals, and the context of each key; keys are sorted."""
    code = keys >> U(8 * (DEPTH - depth) + 8)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(counts, first) if len(first) else counts[:0], np.repeat(np.arange(len(first)), np.diff([*first, len(code)]))


def levels(keys: np.ndarray, counts: np.ndarray, top: int) -> list[Level]:
    """The levels top to DEPTH over sorted gram keys that hold whole contexts of depth top, weighed bottom-up."""
    out: list[Level] = []
    byte = (keys & U(255)).astype(np.int64)
    for depth in range(top, DEPTH + 1):
        code, _, of = context_totals(keys, counts, depth)
        dense = np.zeros((len(code), 256))
        np.add.at(dense, (of, byte), counts)
        parent = np.searchsorted(out[-1].code, code >> U(8)) if out else np.zeros(len(code), np.int64)
        out.append(Level(code, dense, parent))
    for depth in range(len(out) - 1, -1, -1):
        this = out[depth]
        under, below = np.zeros_like(this.counts), np.zeros((len(this.code), 255))
        this.split = np.zeros(len(this.code), bool)
        if depth + 1 < len(out):
            child = out[depth + 1]
            np.add.at(under, child.parent, child.counts)
            np.add.at(below, child.parent, child.weighted)
            this.split[child.parent] = True
        this.rest = this.counts - under
        this.weighted, this.share = weigh(this.counts, this.rest, below, this.split)
    return out


def leaf_ones(found: list[Level]) -> list[np.ndarray]:
    """For each level, the probability of a one at each node for places that end at its contexts, mixed up to the first level."""
    out = []
    for depth, level in enumerate(found):
        one = np.where(level.split[:, None], next_one(level.rest), next_one(level.counts))
        at = np.arange(len(level.code))
        for up in range(depth, -1, -1):
            own = found[up]
            one = own.share[at] * next_one(own.counts)[at] + (1 - own.share[at]) * one
            at = own.parent[at]
        out.append(one)
    return out


def decisions(keys: np.ndarray, counts: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of the eight decisions of a byte, over sorted distinct gram keys (counts may be 0): the node of each gram at
    DEPTH, each such node's first gram and its probability of a one mixed up to depth top; and of the nodes of depth top the
    first key (context, byte) and the ln weighted probability. Keys hold whole contexts of depth top."""
    grams, ups = [(keys, counts.astype(np.float64))], []
    for _ in range(top, DEPTH):
        k, c = grams[-1]
        shorter, up = np.unique((k >> U(16) << U(8)) | (k & U(255)), return_inverse=True)
        grams.append((shorter, np.bincount(up, weights=c, minlength=len(shorter))))
        ups.append(up)
    for bit in range(8):
        for j, (k, c) in enumerate(grams):
            new = np.concatenate([[True], (k[1:] >> U(8 - bit)) != (k[:-1] >> U(8 - bit))])
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            b = np.bincount(node, weights=c * ((k >> U(7 - bit)) & U(1)))
            n = np.bincount(node, weights=c)
            own, one = np.where(n > 0, kt(n - b, b), 0.0), (b + 0.5) / (n + 1)
            if j == 0:
                deepest, begin, weighted, mixed, at = node, first, own, one, np.arange(len(first))
            else:
                up = node[ups[j - 1][below_first]]
                weighted, share = mixture(own, np.bincount(up, weights=weighted, minlength=len(first)))
                at = up[at]
                mixed = share[at] * one[at] + (1 - share[at]) * mixed
            below_first = first
        yield deepest, begin, mixed, grams[-1][0][first], weighted


def mixture(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln weighted probability and the own estimate's share, where all that is below is told apart."""
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(np.minimum(own - np.log(2) - weighted, 0))


def node_number(keys: np.ndarray, bit: int) -> np.ndarray:
    """Which of the 255 binary nodes a key's byte passes at that decision."""
    return ((1 << bit) - 1 + ((keys & U(255)) >> U(8 - bit)).astype(np.int64)).astype(np.int64)


def top_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context of one byte: counts of bytes, and sums of its children's ln weighted probabilities by node."""
    own, below = np.zeros((256, 256)), np.zeros((256, 255))
    np.add.at(own, ((keys >> U(40)).astype(np.int64), (keys & U(255)).astype(np.int64)), counts)
    for bit, (_, _, _, top, weighted) in enumerate(decisions(keys, counts, 2)):
        np.add.at(below, ((top >> U(16)).astype(np.int64), node_number(top, bit)), weighted)
    return own, below


def upper(own1: np.ndarray, below1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shares and next probabilities of the contexts of one byte and of the empty one, from top_sums over all grams."""
    weighted1, share1 = mixture(log_estimate(own1), below1)
    own0 = own1.sum(axis=0, keepdims=True)
    _, share0 = mixture(log_estimate(own0), weighted1.sum(axis=0, keepdims=True))
    return share1, next_one(own1), share0, next_one(own0)


def gram_costs(keys: np.ndarray, counts: np.ndarray, above: tuple[np.ndarray, ...]) -> np.ndarray:
    """Minus log10 of the probability of each gram's byte after its context, in the whole weighted tree."""
    share1, next1, share0, next0 = above
    out = np.zeros(len(keys))
    for bit, (node, begin, one, _, _) in enumerate(decisions(keys, counts, 2)):
        x, near = node_number(keys[begin], bit), (keys[begin] >> U(40)).astype(np.int64)
        one = share1[near, x] * next1[near, x] + (1 - share1[near, x]) * one
        one = share0[0, x] * next0[0, x] + (1 - share0[0, x]) * one
        is_one = (keys >> U(7 - bit)) & U(1) == 1
        out -= np.log10(np.where(is_one, one[node], 1 - one[node]))
    return out


@dataclass
class Model:
    """child[node, byte]: the next node; nodes from len(child) on are leaves. costs[leaf - len(child)]: a row of the table."""

    child: np.ndarray
    costs: np.ndarray

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probabilities of documents."""
        data, begin = stream(raw, at)
        n = np.diff(at)
        inner, flat, table = len(self.child), self.child.ravel(), self.costs.ravel()
        out = np.zeros(len(n))
        ends = np.cumsum(n + 1)
        lo = 0
        while lo < len(n):  # in parts of about a million symbols
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
            total = np.zeros(hi - lo, np.int64)
            places = symbols(data, begin[lo:hi], n[lo:hi])
            doc = np.repeat(np.arange(hi - lo), n[lo:hi] + 1)
            for a in range(0, len(places), 1 << 18):
                p = places[a : a + (1 << 18)]
                node = np.zeros(len(p), np.int32)
                for k in range(1, DEPTH + 1):
                    deep = node < inner
                    nxt = flat[np.where(deep, node, 0) * np.int32(256) + data[p - k]]
                    node = np.where(deep, nxt, node)
                cost = table[(node - inner).astype(np.int64) * 256 + data[p]]
                total += np.bincount(doc[a : a + len(p)], weights=cost, minlength=hi - lo).astype(np.int64)
            out[lo:hi] = -total / SCALE
            lo = hi
        return out


def assemble(codes: list[np.ndarray], split: list[np.ndarray], costs: list[np.ndarray], root_cost: np.ndarray) -> Model:
    """The walkable tree from contexts of depths 1 to DEPTH (sorted codes), whether they have children, and their leaves' costs."""
    inner = [np.zeros(len(c), np.int64) for c in codes]
    n = 1  # node 0 is the empty context
    for k, s in enumerate(split):
        inner[k] = np.where(s, n + np.cumsum(s) - 1, -1)
        n += int(s.sum())
    leaf = []
    total = n + 1  # leaf n is the empty context's
    for c in codes:
        leaf.append(total + np.arange(len(c)))
        total += len(c)
    child = np.zeros((n, 256), np.int32)
    child[0] = n
    for k, s in enumerate(split):
        child[inner[k][s]] = leaf[k][s][:, None]
    for k, c in enumerate(codes):
        up = np.zeros(len(c), np.int64) if k == 0 else inner[k - 1][np.searchsorted(codes[k - 1], c >> U(8))]
        child[up, (c & U(255)).astype(np.int64)] = np.where(split[k], inner[k], leaf[k])
    return Model(child, np.concatenate([root_cost.reshape(1, 256), *costs]).astype(np.uint16))
