"""Planar geometry of rings as Column expressions: extents, areas, centroids, winding number, rectangles.

A ring is ARRAY<STRUCT<x, y>>. Nothing is exploded and no row leaves the JVM; Spark evaluates the higher-order functions over a ring by its
interpreter. Many points against many rings go through the numpy tests of ``operators.spatial``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(ring: Column) -> Column:
    """The ring with its first point at the end."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.when(F.size(ring) < 1, ring).when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))


def extent(ring: Column) -> Column:
    """(min_x, min_y, max_x, max_y)."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"))


def extend(a: Column, b: Column) -> Column:
    """The extent of two extents."""
    return F.struct(F.least(a["min_x"], b["min_x"]).alias("min_x"), F.least(a["min_y"], b["min_y"]).alias("min_y"), F.greatest(a["max_x"], b["max_x"]).alias("max_x"), F.greatest(a["max_y"], b["max_y"]).alias("max_y"))


def extent_of_group(e: Column) -> Column:
    """Aggregate: the extent of many extents."""
    return F.struct(F.min(e["min_x"]).alias("min_x"), F.min(e["min_y"]).alias("min_y"), F.max(e["max_x"]).alias("max_x"), F.max(e["max_y"]).alias("max_y"))


def edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring."""
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))).otherwise(
        F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    )


def oriented_edges(ring: Column, swap: bool = False) -> Column:
    """Edges with their lower end first and wn_inc +1 if they rise, else -1; ``swap`` exchanges x and y."""
    ring = F.transform(ring, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y"))) if swap else ring

    def turn(e: Column) -> Column:
        up = e["y1"] > e["y0"]
        pick = lambda a, b: F.when(up, e[a]).otherwise(e[b])
        return F.struct(pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"), F.when(up, 1).otherwise(-1).alias("wn_inc"))

    return F.transform(edges(ring), turn)


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["x0"] * e["y1"] - e["x1"] * e["y0"])) * 0.5


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid_area(ring: Column) -> Column:
    """(x, y, area): area-weighted centroid with a positive area; null coordinates where the area is 0."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        c = e["x0"] * e["y1"] - e["x1"] * e["y0"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (e["x0"] + e["x1"]) * c).alias("x"), (s["y"] + (e["y0"] + e["y1"]) * c).alias("y"))

    def finish(s: Column) -> Column:
        return F.struct(F.try_divide(s["x"], s["a"] * 3).alias("x"), F.try_divide(s["y"], s["a"] * 3).alias("y"), F.abs(s["a"] * 0.5).alias("area"))

    return F.aggregate(edges(ring), zero, add, finish)


def multi_centroid_area(x: Column, y: Column, a: Column) -> Column:
    """Aggregate: weighted merge of centroids; negative areas are holes; a total of 0 gives (0, 0, 0)."""
    t = F.sum(a)
    none = F.coalesce(t, F.lit(0.0)) == 0
    merged = lambda v: F.when(none, F.lit(0.0)).otherwise(F.try_divide(F.sum(v * a), t))
    return F.struct(merged(x).alias("x"), merged(y).alias("y"), F.when(none, F.lit(0.0)).otherwise(t).alias("area"))


def multi_centroid_array(parts: Column) -> Column:
    """The same over an array of (x, y, area)."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a"))
    add = lambda s, p: F.struct((s["x"] + p["x"] * p["area"]).alias("x"), (s["y"] + p["y"] * p["area"]).alias("y"), (s["a"] + p["area"]).alias("a"))
    end = lambda s: F.struct(F.coalesce(F.try_divide(s["x"], s["a"]), F.lit(0.0)).alias("x"), F.coalesce(F.try_divide(s["y"], s["a"]), F.lit(0.0)).alias("y"), s["a"].alias("area"))
    return F.aggregate(parts, zero, add, end)


def winding_number(ring: Column, x: Column, y: Column) -> Column:
    """Edges whose span holds y (low end in, high end out) with the point strictly to their left, signed by direction."""

    def add(n: Column, e: Column) -> Column:
        hit = (e["y0"] <= y) & (y < e["y1"]) & ((e["x1"] - e["x0"]) * (y - e["y0"]) - (x - e["x0"]) * (e["y1"] - e["y0"]) > 0)
        return n + F.when(hit, e["wn_inc"]).otherwise(0)

    return F.aggregate(oriented_edges(ring), F.lit(0), add)


def in_polygon(ring: Column, x: Column, y: Column) -> Column:
    return winding_number(ring, x, y) != 0


def hline_intersects(ring: Column, x: Column, x2: Column, y: Column, swap: bool = False) -> Column:
    """Whether the open horizontal segment (x, x2) at y crosses an edge; with ``swap`` a vertical one at x = y."""

    def cross(e: Column) -> Column:
        at = e["x1"] - (F.try_divide(e["y1"] - y, e["y1"] - e["y0"]) * (e["x1"] - e["x0"]))
        return F.coalesce((e["y0"] <= y) & (y < e["y1"]) & (x < at) & (at < x2), F.lit(False))

    return F.exists(oriented_edges(ring, swap), cross)


def rect_in_polygon(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """'S' where a side of the rectangle crosses the ring, 'I' where both corners are inside, else 'O' (also for a ring inside the rectangle)."""
    crossed = hline_intersects(ring, x0, x1, y0) | hline_intersects(ring, x0, x1, y1) | hline_intersects(ring, y0, y1, x0, True) | hline_intersects(ring, y0, y1, x1, True)
    return F.when(crossed, "S").when(in_polygon(ring, x0, y0) & in_polygon(ring, x1, y1), "I").otherwise("O")
