"""Connected components by alternating large and small stars, as joins and minimum aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import maybe_broadcast, scratch, table

#: Edges from which on a node is a hub, at least; and the most hubs, as their number is at most twice the edges by that.
HUB, MOST_HUBS = 1000, 200_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Edges (u, v) with m of least (u, m, n): those of hubs, n >= hub, meet a broadcast table, so no task gets a hub's edges; the others are shuffled."""
    hubs = least.filter(F.col("n") >= hub).select("u", "m")
    count = hubs.count()
    if not count:
        return edges.join(least.select("u", "m"), "u")
    few = maybe_broadcast(hubs, count)
    rest = edges.join(few.select("u"), "u", "left_anti").join(least.filter(F.col("n") < hub).select("u", "m"), "u")
    return edges.join(few, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, most_rounds: int = 100, hub: int = HUB) -> DataFrame:
    """(id, root) for each node that has an edge (u, v): root is the smallest id of its component.

    Each round joins every edge with the minimum of its node's neighbours. A hub's edges stay where they are: hubs, at
    most MOST_HUBS, and their minima are broadcast; minima are combined before the shuffle. Rounds are logarithmic in
    the size of the largest component. Each is written to the shared folder, so a lost executor costs one round at
    most. Self-links and nulls are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = table(pairs, "edges")
    mark = _mark(pairs)
    for _ in range(most_rounds):
        most = max(hub, 2 * mark[0] // MOST_HUBS)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = mark[0] >= most and bool(least.filter(F.col("n") >= most).head(1))
        with scratch(spark):
            kept = table if hubs else lambda df, _: df  # without hubs all of a round is one job
            join = _with_least if hubs else lambda e, l, _: e.join(l, "u")
            least = kept(least, "minima")
            large = join(both, least, most).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            large = kept(large, "large-stars")
            least = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "minima")
            small = join(large, least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            pairs = table(small.filter("u <> v").distinct(), "edges", outlives=True)
        new = _mark(pairs)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
