"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b long); component is the smallest node.

    Self-links and repeated links are fine; no links give no rows. Each round
    is a grouped minimum (combined before the shuffle) and an equi-join, and
    is written to the shared folder, so plans stay short and hubs may be
    split by skew-join handling. Rounds grow with the logarithm of a
    component's size.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = saved(links, "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(rest.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
