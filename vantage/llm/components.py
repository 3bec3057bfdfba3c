"""Connected components of a link table by alternating stars, in joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Written


def components(links: DataFrame, kept: Written, key: str = "links", most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has a link in (a, b); component is the smallest node it reaches.

    Each round hangs every node's larger neighbours on its smallest neighbour, then every node on its smallest lower
    one, until each link leads to its component's smallest node. Rounds are written to the shared folder; no
    node's links meet in one task."""
    edges = kept.put(key, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        edges = kept.put(key, small.select("x.u", "x.v").filter("u <> v").distinct())
        # Settled when each node has one link and no node hangs on one that hangs itself.
        state = edges.groupBy("u").agg(F.count("*").alias("n"))
        loose = state.filter("n > 1").limit(1).count() or edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
