"""Connected components of links, by alternating large and small stars. Never gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (long) -> v, root: every vertex with the smallest vertex of its component.

    Each round hooks neighbours to their smallest neighbour, first those above a vertex, then those below it; the
    number of rounds grows with the logarithm of the size. Minima are aggregated before they move, and the joins
    with them are plain equi-joins, which are split where a vertex is hot. Rounds are written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, e = e, stored(small, "stars")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
