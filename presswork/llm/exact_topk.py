"""Exact top-k inner products by columnar branch and bound.

A block of candidates lies dimension by dimension, those with the most mass first. Scores are accumulated a block of
dimensions at a time; what the remaining dimensions can add is at most the product
of the remaining norms. The k-th best among some scores known in full bounds the result from below;
candidates that can't reach it are dropped, for each query by itself, and the rest is compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.vectors import Found, Run, search, usable

DIM_BLOCK, QUERY_BATCH = 16, 16


def _largest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= kth)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def prepared(k: int, cid: np.ndarray, c: np.ndarray, kept: list[float] | None = None) -> Run:
    """The columns of a block, laid out once, and the search of a batch of queries in them. ``kept`` collects
    the share of (candidate, dimension) products that were computed, one figure a query."""
    dim, biggest = c.shape[1], max(np.abs(c).max(), 1.0)
    order = np.argsort(-(c**2).sum(0), kind="stable")
    rows_of, columns = c[:, order], np.ascontiguousarray(c[:, order].T)
    blocks = [slice(a, min(a + DIM_BLOCK, dim)) for a in range(0, dim, DIM_BLOCK)]
    rest = lambda x: [np.sqrt((x[..., b.stop :] ** 2).sum(-1)) * (1 + 1e-9) for b in blocks]
    crest = rest(rows_of)

    def one(own: int, q: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best; ``part``: the scores of the first block of dimensions."""
        floor = -np.inf
        n = min(4 * k + 1, len(c))
        lead = np.argpartition(part, len(c) - n)[len(c) - n :]  # some scores in full: those that lead so far
        lead = lead[cid[lead] != own]
        if len(lead) >= k:
            full = rows_of[lead] @ q
            floor = np.partition(full, len(full) - k)[len(full) - k]
        qrest, rows, done = rest(q), None, 0
        for b, block in enumerate(blocks):
            if b:
                part = part + q[block] @ (columns[block] if rows is None else columns[block][:, rows])
            done += len(part) * (block.stop - block.start)
            if block.stop < dim:
                reach = part + qrest[b] * (crest[b] if rows is None else crest[b][rows])
                alive = np.flatnonzero(reach + 0.5 >= floor)
                if len(alive) < 0.9 * len(part):
                    rows, part = alive if rows is None else rows[alive], part[alive]
        if kept is not None:
            kept.append(done / (len(c) * dim))
        ids = cid if rows is None else cid[rows]
        other = ids != own
        scores, ids = part[other], ids[other]
        best = _largest(scores, ids, k)
        return ids[best], np.rint(scores[best]).astype(np.int64)

    def run(qid: np.ndarray, q: np.ndarray) -> Iterator[Found]:
        if max(np.abs(q).max(), 1.0) * biggest * dim >= 2.0**53:  # sums of doubles would not be exact: whole numbers of any size
            yield from _wide(k, qid, q, cid, c)
            return
        q = q[:, order]
        for at in range(0, len(q), QUERY_BATCH):
            first = q[at : at + QUERY_BATCH, blocks[0]] @ columns[blocks[0]]
            for i, part in enumerate(first, at):
                ids, scores = one(int(qid[i]), q[i], part)
                if len(ids):
                    yield int(qid[i]), ids, scores

    return run


def _wide(k: int, qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray) -> Iterator[Found]:
    """Components too large for doubles' sums: Python's whole numbers; scores end at the limits of long."""
    whole = [[int(x) for x in row] for row in c]
    low, high = -(2**63), 2**63 - 1
    for i, row in enumerate(q):
        mine = [int(x) for x in row]
        scored = sorted((-sum(a * b for a, b in zip(mine, other, strict=True)), int(j)) for other, j in zip(whole, cid, strict=True) if j != qid[i])[:k]
        if scored:
            yield int(qid[i]), np.array([j for _, j in scored], np.int64), np.array([min(max(-s, low), high) for s, _ in scored], np.int64)


def largest_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x).

    Exact. Vectors that are null or empty or hold null or non-finite components take no part; zero
    vectors do. Ties go to the smaller id."""
    rows = usable(vectors, key, vector, zero_ok=True)

    def block(cid: np.ndarray, c: np.ndarray) -> Run:
        run = prepared(k, cid, np.floor(scale * c))
        return lambda qid, q: run(qid, np.floor(scale * q))

    return search(rows, is_query, k, block, "long", ascending=False)


def is_multiple(of: int) -> Column:
    return F.col("id") % of == 0
