"""Regions made of polygons with holes: roll-up of rings to polygons to tracts, and point lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon as G
from ..functions.binding import let
from . import spatial

# State codes in use (1 to 56 without the reserved ones, and 72).
RESERVED = (3, 7, 14, 43, 52)


def state_codes() -> Column:
    return F.array_union(F.array_except(F.sequence(F.lit(1), F.lit(56)), F.array(*map(F.lit, RESERVED))), F.array(F.lit(72)))


def tract_id(vintage: int, attrs: Column) -> Column:
    """The tract's id from a shape's attributes, by vintage of the shapes."""
    a = lambda n: F.try_element_at(attrs, F.lit(n))
    if vintage == 1990:
        name = a("TRACT_NAME")
        return F.concat(a("ST"), a("CO"), a("TRACTBASE"), F.coalesce(F.format_string("%04.2f", name.try_cast("double")), name))
    if vintage in (2000, 2010):
        return F.concat(a("STATE"), a("COUNTY"), a("TRACT"))
    return a("GEOID")


def state_path(root: str, year: int, state: int) -> str:
    """Folder of one state's shapes of one vintage; a partitioned read prunes by both."""
    return f"{root.rstrip('/')}/year={year}/state={state:02d}"


def scan_states(shapes: DataFrame, states: list[int] | None = None) -> DataFrame:
    """The shapes of some states; prunes partitions where ``state`` is one."""
    return shapes if states is None else shapes.filter(F.col("state").isin(list(states)))


def polygons(shapes: DataFrame, sid: str = "sId", ring: str = "polygon", holes: str = "innerRings") -> DataFrame:
    """(sId, extent, ring, holes, centroid, area) of each polygon: outer ring minus holes.

    Water tracts whose hole is their outline fall back to the outer ring.
    """
    src = shapes.select(F.col(sid).alias("sId"), G.closed(F.col(ring)).alias("ring"), F.transform(F.coalesce(F.filter(F.col(holes), lambda h: h.isNotNull() & (F.size(h) > 2)), F.array()), G.closed).alias("holes")).filter(F.size("ring") >= 4)
    outer = G.centroid_area(F.col("ring"))
    minus = lambda h: let(G.centroid_area(h), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (-c["area"]).alias("area")))
    merged = G.multi_centroid_array(F.concat(F.array(outer), F.filter(F.transform("holes", minus), lambda c: c["x"].isNotNull())))
    both = src.withColumn("_o", outer).withColumn("_m", merged).withColumn("_c", F.when(F.col("_m.area") == 0, F.col("_o")).otherwise(F.col("_m")))
    return both.select("sId", G.extent(F.col("ring")).alias("extent"), "ring", "holes", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.col("_c.area").alias("area"))


def roll_up(polys: DataFrame) -> DataFrame:
    """(sId, n_polys, extent, centroid) of each tract from its polygons."""
    return polys.groupBy("sId").agg(F.count(F.lit(1)).alias("n_polys"), G.extent_of_group(F.col("extent")).alias("extent"), G.multi_centroid_area(F.col("x"), F.col("y"), F.col("area")).alias("centroid"))


def find_tracts(points: DataFrame, polys: DataFrame, key: str = "point_id", ignore_holes: bool = False, allow_in_holes: bool = False) -> DataFrame:
    """(key, sId) of the tracts that hold each point: candidates by quadtree and R-tree, then the exact ring and hole tests.

    ``ignore_holes``: anything inside the outer ring counts; ``allow_in_holes``: where nothing else is found, tracts in
    whose holes the point lies.
    """
    holes = "ignored" if ignore_holes else "fallback" if allow_in_holes else "excluded"
    regions = polys.select("sId", F.col("ring").alias("polygon"), F.col("holes").alias("innerRings"))
    got = spatial.points_in_regions(points, regions, key, "sId", holes)
    return got.select(F.col("key_a").cast(dict(points.dtypes)[key]).alias(key), F.col("key_b").alias("sId"))
