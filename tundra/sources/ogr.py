"""Shape listings: text of features with attributes and one POLYGON or MULTIPOLYGON each.

A feature starts where a line begins with OGRFeature; everything before the first is skipped. Splitting, attributes and
rings are JVM expressions over the whole listing of a file or over one row a feature.

Defined results: attribute lines have exactly one '='; a bracketed type after the name is cut off; a feature without exactly one
geometry is an error in strict mode, else left out; rings stay separate (holes are true rings).
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from . import files

RINGS = "array<array<array<struct<x:double,y:double>>>>"


def split_features(listings: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(carry..., feature_no, feature) of listings held as one text a row."""
    parts = F.split(F.col(text), r"(?m)^OGRFeature")
    return listings.select(*(carry or []), F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("feature_no", "feature"))


def attributes(feature: Column) -> Column:
    """MAP name -> value of the lines with exactly one '='."""
    lines = F.filter(F.split(feature, "\n"), lambda s: F.length(s) - F.length(F.replace(s, F.lit("="))) == 1)
    name = lambda s: F.trim(F.regexp_replace(F.trim(F.split_part(s, F.lit("="), F.lit(1))), r"^([^(]*)\([^(]*$", "$1"))
    pairs = F.transform(lines, lambda s: F.struct(name(s).alias("key"), F.trim(F.split_part(s, F.lit("="), F.lit(2))).alias("value")))
    # of a repeated name the last line counts
    both = F.struct(pairs.alias("pairs"), F.transform(pairs, lambda p: p["key"]).alias("names"))
    last = let(both, lambda s: F.filter(s["pairs"], lambda p, i: ~F.array_contains(F.slice(s["names"], i + 2, F.size(s["names"])), p["key"])))
    return F.map_from_entries(last)


def geometry_lines(feature: Column) -> Column:
    return F.filter(F.transform(F.split(feature, "\n"), lambda s: F.trim(s)), lambda s: s.startswith("POLYGON") | s.startswith("MULTIPOLYGON"))


def rings(wkt: Column) -> Column:
    """Polygons of rings of points."""
    points = lambda s: F.transform(F.split(s, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
    body = F.regexp_replace(wkt, r"^\s*(MULTI)?POLYGON\s*", "")
    inner = F.when(wkt.rlike(r"^\s*MULTI"), F.regexp_replace(F.regexp_replace(body, r"^\(\s*\(\s*\(", ""), r"\)\s*\)\s*\)\s*$", "")).otherwise(F.regexp_replace(F.regexp_replace(body, r"^\(\s*\(", ""), r"\)\s*\)\s*$", ""))
    polys = F.split(inner, r"\)\s*\)\s*,\s*\(\s*\(")
    return F.transform(polys, lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), points))


def parse_features(listings: DataFrame, text: str = "text", carry: list[str] | None = None, discard_inner: bool = True, strict: bool = True) -> DataFrame:
    """(carry..., feature_no, attrs, polygons)."""
    return _shaped(split_features(listings, text, carry), [*(carry or []), "feature_no"], discard_inner, strict)


def _shaped(features: DataFrame, carry: list[str], discard_inner: bool, strict: bool) -> DataFrame:
    f = features.withColumn("_g", geometry_lines(F.col("feature")))
    if strict:
        f = f.withColumn("_g", F.when(F.size("_g") == 1, F.col("_g")).otherwise(F.raise_error(F.lit("a feature needs exactly one geometry")).cast("array<string>")))
    else:
        f = f.filter(F.size("_g") == 1)
    polys = rings(F.element_at("_g", 1))
    if discard_inner:
        polys = F.transform(polys, lambda p: F.slice(p, 1, 1))
    return f.select(*carry, attributes(F.col("feature")).alias("attrs"), polys.alias("polygons"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, place, feature): the text of every feature; plain files are read in splits, one record a feature."""
    found = files._heads(spark, path, None)
    packed = [p for p, head in found if head[:2] == files.GZIP]
    plain = [p for p, head in found if head[:2] != files.GZIP]
    parts = []
    if plain:
        raw = spark.read.option("lineSep", "\nOGRFeature").text(plain)
        got = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^OGRFeature", "").alias("feature"), (F.col("_metadata.file_block_start") == 0).alias("top"))
        # what comes before the first feature of a file doesn't begin like one
        parts.append(got.filter(F.col("feature").startswith("(")).drop("top"))
    if packed:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, data in zip(pdf["path"], pdf["content"]):
                    pieces = ("\n" + files.decode(gzip.decompress(bytes(data)))).split("\nOGRFeature")[1:]
                    yield pd.DataFrame({"path": name, "block": 0, "place": range(len(pieces)), "feature": pieces})

        parts.append(spark.read.format("binaryFile").load(packed).select("path", "content").mapInPandas(run, "path string, block bigint, place bigint, feature string"))
    if not parts:
        return spark.createDataFrame([], "path string, block bigint, place bigint, feature string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_shapes(spark: SparkSession, path: str, discard_inner: bool = True) -> DataFrame:
    """(path, block, place, attrs, polygons) of all features of listing files, gzipped or plain by content."""
    return _shaped(read_features(spark, path), ["path", "block", "place"], discard_inner, True)
