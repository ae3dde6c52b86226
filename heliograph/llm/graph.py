"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import materialize


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """edges: columns a and b of one orderable type. Returns node, root: the least node that it reaches.

    Each step joins written tables only, so that AQE can split the rows of a node with many edges.
    Loops and repeated edges do no harm; no edges give no rows."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def is_forest_of_stars(df: DataFrame) -> bool:
        if not df.groupBy("u").count().filter("count > 1").isEmpty():
            return False
        return df.join(df.select(F.col("u").alias("other")), F.col("v") == F.col("other"), "left_semi").isEmpty()

    rounds = 0
    while not is_forest_of_stars(now):
        rounds += 1
        if rounds > most:
            raise RuntimeError(f"components did not settle in {most} rounds")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m")), "large_star")
        large = both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large_edges")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m"), "small_star")
        moved = large.join(least, F.col("u") == F.col("of")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
