"""Connected components of links, by repeated joins (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.session import release, stage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node each linked node is connected with.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change. Each step is a
    group-by with a bounded number of edges, and its result is staged, so the plan stays short. Nodes in no link are not in the
    result; an empty table gives an empty result; loops and repeated links have no effect.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of u is linked to the smallest node around u
        both = edges.union(edges.select("v", "u")).toDF("u", "w")
        low = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, is linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        before, edges = edges, stage(small, "edges")
        release(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v").distinct())
