"""Approximate nearest neighbours by multi-index hashing.

A rotation learned from a bounded sample (iterative quantisation, some rotations side by side) turns
vectors into binary codes, cut into substrings, each with its own table: 16 bits for large blocks, 8 for small
ones, about the logarithm of the block's rows. If two codes differ
in at most r bits, some substring differs in at most r // m: probing every table with all patterns
of that many flipped bits therefore retrieves every code within radius r. The radius grows until
it covers the Hamming distance at which, by the sample, a neighbour as far as the k-th one found so far lies
with high probability; what was retrieved within it is ranked by the exact distance.

The index covers every row. What it saves depends on the vectors: on directions without structure the radius
comes out large and most rows are looked at; on vectors in groups a small share is. Both shares, and
recall against brute force, are in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.vectors import Found, Run, search, usable

#: Rows that the rotation and the radius are learned from (smallest hashes of id), bits of a code,
#: and standard deviations that the radius keeps in reserve; rows from which on a block's substrings have 16 bits.
SAMPLE, BITS, RESERVE, WIDE_FROM = 4_096, 128, 2.3, 2_048


def rotation(x: np.ndarray, bits: int, seed: int = 7, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): columns whose signs are the code's bits."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    centred, dim = x - mean, x.shape[1]
    if dim > bits and len(x) > 1:
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        base = axes[:bits].T if len(axes) >= bits else np.linalg.qr(rng.standard_normal((dim, bits)))[0]
    else:
        base = np.eye(dim)
    width, made = base.shape[1], []
    low = centred @ base
    while sum(m.shape[1] for m in made) < bits:
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds if len(x) > width else 0):
            u, _, vt = np.linalg.svd(low.T @ np.where(low @ turn >= 0, 1.0, -1.0), full_matrices=False)
            turn = u @ vt
        made.append(base @ turn)
    return mean, np.concatenate(made, 1)[:, :bits]


class Codes:
    """What is learned for vectors of one length."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, reserve: float = RESERVE):
        self.bits, self.reserve = bits, reserve
        self.mean, self.axes = rotation(sample, bits)
        # Hamming distance as a straight line over the distance among the sample's closer pairs
        some = sample[:512]
        d = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * some @ sample.T))
        c = self.of(some)
        h = np.bitwise_count(c[:, None, :] ^ self.of(sample)[None, :, :]).sum(2, dtype=np.int64)
        off = np.arange(len(sample)) != np.arange(len(some))[:, None]
        d, h = d[off], h[off]
        near = d <= np.quantile(d, 0.25) if len(d) else np.zeros(0, bool)
        if near.sum() >= 50 and np.ptp(d[near]) > 0:
            self.slope, self.base = np.polyfit(d[near], h[near], 1)
            self.spread = float((h[near] - self.slope * d[near] - self.base).std())
        else:  # too little to learn from: the radius covers everything
            self.slope, self.base, self.spread = 0.0, float(bits), 0.0

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((x - self.mean) @ self.axes >= 0, axis=1, bitorder="little")

    def radius(self, distance: float) -> float:
        return min(self.bits, max(0.0, self.base + self.slope * distance) + self.reserve * self.spread)


@cache
def _flips(part: int, n: int) -> np.ndarray:
    """All patterns of ``n`` bits among ``part``."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(part), n)], np.int64)


class Index:
    """Substring tables over the codes of a block."""

    def __init__(self, codes: np.ndarray):
        self.part = 16 if len(codes) >= WIDE_FROM else 8
        self.codes = self.cut(codes)
        self.parts = self.codes.shape[1]
        self.order = [np.argsort(self.codes[:, t], kind="stable") for t in range(self.parts)]
        edges = np.arange((1 << self.part) + 1)
        self.start = [np.searchsorted(self.codes[o, t], edges) for t, o in enumerate(self.order)]
        self.looked_at = 0  # rows that probes have retrieved so far

    def cut(self, codes: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings."""
        return np.ascontiguousarray(codes).view(f"<u{self.part // 8}")

    def probe(self, code: np.ndarray, flips: int, seen: np.ndarray) -> np.ndarray:
        """Rows not seen yet with a substring that differs from the query's in exactly ``flips`` bits."""
        new = []
        for t in range(self.parts):
            keys = _flips(self.part, flips) ^ int(code[t])
            a, b = self.start[t][keys], self.start[t][keys + 1]
            full = b > a
            a, n = a[full], (b - a)[full]
            if not len(a):
                continue
            at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            rows = self.order[t][at]
            rows = rows[~seen[rows]]
            seen[rows] = True
            new.append(rows)
        out = np.concatenate(new) if new else np.zeros(0, np.int64)
        self.looked_at += len(out)
        return out

    def nearest(self, model: Codes, k: int, code: np.ndarray, q: np.ndarray, own: np.ndarray, cid: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest, as far as the radius reaches; ``own`` marks rows left out."""
        seen = own.copy()
        waiting, apart = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best, far = np.zeros(0, np.int64), np.zeros(0)
        limit = float(model.bits)
        for flips in range(self.part + 1):
            new = self.probe(code, flips, seen)
            waiting = np.concatenate([waiting, new])
            apart = np.concatenate([apart, np.bitwise_count(self.codes[new] ^ code).sum(1, dtype=np.int64)])
            covered = self.parts * (flips + 1) - 1  # every code within this radius has been retrieved
            take = apart <= min(covered, limit)
            if take.any():
                rows = waiting[take]
                waiting, apart = waiting[~take], apart[~take]
                best = np.concatenate([best, rows])
                far = np.concatenate([far, np.sqrt(((c[rows] - q) ** 2).sum(1))])
                kept = np.lexsort((cid[best], far))[:k]
                best, far = best[kept], far[kept]
                if len(best) == k:
                    limit = model.radius(far[-1])
            if covered >= limit:
                break
        return best, far


def prepared(model: Codes, k: int, cid: np.ndarray, c: np.ndarray) -> tuple[Run, Index]:
    """The index of a block, built once, and the search of a batch of queries in it."""
    index = Index(model.of(c))

    def run(qid: np.ndarray, q: np.ndarray) -> Iterator[Found]:
        for own, one, code in zip(qid, q, index.cut(model.of(q)), strict=True):
            best, far = index.nearest(model, k, code, one, cid == own, cid, c)
            if len(best):
                yield int(own), cid[best], far

    return run, index


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, score the Euclidean distance.

    Vectors that are null, all zero, or hold null or non-finite components take no part. ``is_query``
    is a condition on ``id`` (the key). Ties go to the smaller id."""
    rows = usable(vectors, key, vector, zero_ok=False)
    fit: dict[int, list[list[float]]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toLocalIterator():
        fit.setdefault(len(r.v), []).append(r.v)
    models = {dim: Codes(np.array(v)) for dim, v in fit.items()}

    def block(cid: np.ndarray, c: np.ndarray) -> Run:
        # a length that the sample has no row of is rare: learn from the block itself
        return prepared(models.get(c.shape[1]) or Codes(c[:SAMPLE]), k, cid, c)[0]

    return search(rows, is_query, k, block, "double", ascending=True)
