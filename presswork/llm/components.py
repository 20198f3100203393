"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import discard, written

#: A node is a hub with more neighbours than this share of all edges, and than this many: there are
#: at most 2 * HUB_SHARE hubs, whatever the size of the graph.
HUB_SHARE, HUB_LEAST = 512, 10_000


def _with_least(edges: DataFrame, many: int) -> DataFrame:
    """``edges`` (a, b) with each node's least neighbour m. ``many``: how many edges there are.

    Least neighbours are aggregated before the shuffle. Hubs' ones are broadcast (their number is bounded), so
    that no task gets all edges of a hub; the others come by a join on the node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    limit = max(HUB_LEAST, many // HUB_SHARE)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))
    others = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= limit).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(others)


def _towards(edges: DataFrame, both_ways: bool, many: int) -> DataFrame:
    """One star step: each node's larger (or, one way, smaller) neighbours go to its least one."""
    joined = _with_least(edges, many).withColumn("m", F.least("a", "m"))
    if both_ways:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    up = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.unionByName(joined.select("a", F.col("m").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of ``edges`` (a, b) that is not the least of its component, and that least.

    Ends when a round changes nothing; rounds grow with the logarithm of the longest path. Nodes may
    have any number of edges. Null ends and loops are no edges; repeated edges count once; no edges give no rows.
    The result is a written table."""
    mark_of = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = mark_of(now)
    while mark[0]:
        round_trip = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards(round_trip, True, 2 * mark[0]).where("a != b").distinct()
        after = written(_towards(large, False, mark[0]).where("a != b").distinct(), "edges")
        new = mark_of(after)
        discard(now)
        now, done = after, new == mark
        if done:
            break
        mark = new
    return now
