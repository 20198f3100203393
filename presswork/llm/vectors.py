"""Nearest-neighbour and largest-inner-product search of a query set against all rows, in blocks.

Each candidate belongs to one block and moves once; a block is prepared once, by one task, and all queries
stream past it in batches, so that a task holds its block and one batch. Queries are the copies: one for each block,
and blocks grow with the table up to a bound of bytes. Each block hands back k rows a query; a window picks the k best.
Vectors meet only vectors of their own length. Rows with the query's id are its own and left out;
repeated ids of queries are answered once (for their smallest vector), repeated candidate rows are
candidates each. Null ids take part as candidates of no query (they have no id to report) and are
left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of doubles in a block, most rows, rows that a block has at least where they fit, and the number of blocks
#: that a table is cut into from there on. Each query is looked up in each block: small blocks cost more than they spread.
BLOCK_BYTES, MOST_ROWS, LEAST_ROWS, BLOCKS = 64 << 20, 65_536, 16_384, 64
#: Queries of a batch.
QUERY_BATCH = 1_024


def usable(vectors: DataFrame, key: str, vector: str, zero_ok: bool) -> DataFrame:
    """(id, v) of the rows whose vector has finite components only and, unless ``zero_ok``, not all 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, finite))
    return rows if zero_ok else rows.where(F.exists(v, lambda x: x != 0))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]
Run = Callable[[np.ndarray, np.ndarray], Iterator[Found]]


def block_rows(rows: int, dim: int) -> int:
    """Candidates of a block: few enough to fit, and for a large table to have ``BLOCKS`` blocks."""
    return max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * max(dim, 1)), max(LEAST_ROWS, rows // BLOCKS)))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, np.ndarray, np.ndarray]]:
    """(block, kind, ids, vectors) of the batch's rows that follow each other with equal block and kind."""
    part, kind, dim, ids = (batch.column(i).to_numpy() for i in range(4))
    values = batch.column(4).flatten().to_numpy()
    begin = np.concatenate([[0], np.cumsum(dim, dtype=np.int64)])
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0) | (np.diff(dim) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
        yield (int(dim[a]), int(part[a])), int(kind[a]), ids[a:b], values[begin[a] : begin[b]].reshape(b - a, -1)


def search(vectors: DataFrame, is_query: Column, k: int, prepare: Callable[[np.ndarray, np.ndarray], Run], score_type: str, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score). ``prepare`` takes a block's ids and vectors once and returns what searches it:
    a function of a batch of queries (ids, vectors) that yields (query id, ids, scores) of each query's best."""
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n / block_rows(n, longest or 1)))
    rows = vectors.withColumn("dim", F.size("v"))
    # repeated ids spread over the blocks: the row's place in its file takes part
    part = F.pmod(F.xxhash64("id", "seq"), F.lit(blocks)).cast("int")
    left = rows.withColumn("seq", F.monotonically_increasing_id()).select(part.alias("part"), F.lit(0).alias("kind"), "dim", "id", "v")
    asked = rows.where(is_query).groupBy("id", "dim").agg(F.min("v").alias("v"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(1).alias("kind"), "dim", "id", "v")
    dealt = left.unionByName(right).repartition(blocks, "dim", "part").sortWithinPartitions("dim", "part", "kind")
    score_kind = pa.float64() if score_type == "double" else pa.int64()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, held, run = None, [], [], None
        for batch in batches:
            for block, kind, names, x in _runs(batch) if batch.num_rows else ():
                if block != here:
                    here, ids, held, run = block, [], [], None
                if kind == 0:
                    ids.append(names)
                    held.append(x)
                    continue
                if run is None:
                    if not held:
                        continue
                    run = prepare(np.concatenate(ids), np.concatenate(held))
                    ids, held = [], []
                for at in range(0, len(names), QUERY_BATCH):
                    found = list(run(names[at : at + QUERY_BATCH], x[at : at + QUERY_BATCH]))
                    if found:
                        q = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), score_kind)], ["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(task, f"query_id long, vec_id long, score {score_type}")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
