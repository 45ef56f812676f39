"""Rectangle index: stab, overlap and existence queries as joins over a sampled quadtree.

An inequality join would compare everything with everything, so both sides go to the leaves of a quadtree that a bounded sample
shapes (``spatial.overlapping``): in each leaf an R-tree is probed, a crowded leaf is split over several tasks on both sides, and a
pair is kept only by the leaf that holds the low corner of the overlap, so none comes twice.

Defined results: borders count (closed boxes); removed boxes are left out; null or NaN corners match nothing; boxes or
queries given twice match each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial

BOX = ("x_min", "x_max", "y_min", "y_max")


def overlaps(q: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed rectangles (x_min, x_max, y_min, y_max) meet."""
    return (q[0] <= b[1]) & (q[1] >= b[0]) & (q[2] <= b[3]) & (q[3] >= b[2])


def alive(boxes: DataFrame, removed: str = "removed") -> DataFrame:
    return boxes.filter(~F.coalesce(F.col(removed), F.lit(False)))


def remove(boxes: DataFrame, ids: DataFrame, key: str, removed: str = "removed") -> DataFrame:
    """Soft delete: the boxes with these ids are marked."""
    return boxes.join(ids.select(key, F.lit(True).alias("_gone")).distinct(), key, "left").withColumn(removed, F.coalesce(removed, F.lit(False)) | F.coalesce("_gone", F.lit(False))).drop("_gone")


def find_node(boxes: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return boxes.join(ids.select(key).distinct(), key)


def overlap_join(queries: DataFrame, boxes: DataFrame, query_key: str, box_key: str) -> DataFrame:
    """(query_key, box_key) of every query box that meets a box."""
    good = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in BOX) + " AND x_min <= x_max AND y_min <= y_max"
    side = lambda df, key: df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX]).filter(good).select("id", F.col("x_min").alias("x0"), F.col("y_min").alias("y0"), F.col("x_max").alias("x1"), F.col("y_max").alias("y1"))
    return spatial.overlapping(side(queries, query_key), side(boxes, box_key)).select(F.col("q").alias(query_key), F.col("b").alias(box_key))


def stab_join(points: DataFrame, boxes: DataFrame, point_key: str, box_key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(point_key, box_key) of every box that holds a point, borders included."""
    q = points.select(point_key, F.col(x).alias("x_min"), F.col(x).alias("x_max"), F.col(y).alias("y_min"), F.col(y).alias("y_max"))
    return overlap_join(q, boxes, point_key, box_key)


def overlap_exists(queries: DataFrame, boxes: DataFrame, query_key: str, box_key: str) -> DataFrame:
    """(query_key, found): whether any box meets the query box."""
    hit = overlap_join(queries, boxes, query_key, box_key).select(query_key).distinct().withColumn("_f", F.lit(True))
    return queries.select(query_key).distinct().join(hit, query_key, "left").select(query_key, F.coalesce("_f", F.lit(False)).alias("found"))
