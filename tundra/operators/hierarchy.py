"""Transitive closure over parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import checkpoint


def closure(links: DataFrame, child: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """(node, ancestor): every node with itself and all above it.

    A round joins only the pairs that the last one found with all pairs, which doubles the path length (the way to an ancestor
    begins with one of the longest ways known); all pairs then are a reliable checkpoint. Cycles end because known pairs are not added again. Null links are ignored.
    """
    e = links.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node IS NOT NULL AND ancestor IS NOT NULL").distinct()
    nodes = e.select("node").unionByName(e.select(F.col("ancestor").alias("node"))).distinct()
    reach = checkpoint(e.withColumn("fresh", F.lit(True)))
    for _ in range(max_rounds):
        new, known = reach.filter("fresh").alias("a"), reach.alias("b")
        longer = new.join(known, F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), F.lit(True).alias("fresh"))
        reach = checkpoint(longer.unionByName(reach.withColumn("fresh", F.lit(False))).groupBy("node", "ancestor").agg(F.min("fresh").alias("fresh")))
        if reach.filter("fresh").isEmpty():
            break
    else:
        raise RuntimeError("the hierarchy is deeper than expected")
    return reach.drop("fresh").unionByName(nodes.select("node", F.col("node").alias("ancestor"))).distinct()


def is_instance(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """(node, ancestor, is_instance) of asked pairs."""
    return pairs.join(closed.withColumn("_y", F.lit(True)), ["node", "ancestor"], "left").select("node", "ancestor", F.coalesce("_y", F.lit(False)).alias("is_instance"))
