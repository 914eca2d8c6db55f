"""Connected components of an edge table, by alternating large-star and small-star.

Every round is written to the shared folder, so neither lineage nor memory grows, and
each of its steps is an aggregation with map-side combine and an equi-join; a node's
neighbours are never gathered in one place. Ends when a round changes nothing.
"""

from pyspark.sql import functions as F

from ..session import written


def components(edges, label, max_rounds=60):
    """(node, component) for edges (a, b) of longs; component is the smallest node reachable."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # Larger neighbours of u hang under the smallest of u and its neighbours.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Smaller neighbours of u and u itself hang under the smallest of them.
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), label)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    inner = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("u")).distinct().join(inner.select("u"), "u", "left_anti").withColumn("component", F.col("u"))
    return inner.unionByName(roots).withColumnRenamed("u", "node")
