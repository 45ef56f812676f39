"""Values with times: a point (t_end null) or an interval.

Defined results: nulls of the value don't count; times compare as (start, end), a point before any interval that starts
with it; one value has deviation 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .accum import sample_stdv


def timed_statistics(df: DataFrame, keys: list[str], value: str, t_start: str, t_end: str | None = None) -> DataFrame:
    """count, mean, stdv, min, max of the values; first and last time (min_t, max_t)."""
    end = F.col(t_end) if t_end else F.lit(None).cast(dict(df.dtypes)[t_start])
    src = df.select(*keys, F.col(value).alias("_v"), F.struct(F.col(t_start).alias("t_start"), end.alias("t_end")).alias("_t")).filter("_v IS NOT NULL")
    return src.groupBy(*keys).agg(
        F.count("_v").alias("count"), F.avg("_v").alias("mean"), sample_stdv(F.col("_v")).alias("stdv"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.min("_t")["t_start"].alias("min_t"), F.max("_t")["t_start"].alias("max_t"), F.max("_t")["t_end"].alias("max_t_end"),
    )


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge: the (value, time) rows of both."""
    return a.unionByName(b, allowMissingColumns=True)
