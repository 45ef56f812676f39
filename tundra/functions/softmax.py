"""Softmax over an array column, or over the rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let


def softmax_array(x: Column, theta: float = 1.0) -> Column:
    """Softmax of an array of numbers, in the JVM. Null or empty arrays stay as they are."""
    y = F.transform(x, lambda v: v.cast("double") * F.lit(float(theta)))
    top = F.struct(y.alias("y"), F.array_max(y).alias("m"))
    e = let(top, lambda s: F.transform(s["y"], lambda v: F.exp(v - s["m"])))
    p = let(e, lambda a: let(F.struct(a.alias("e"), F.aggregate(a, F.lit(0.0), lambda t, v: t + v).alias("t")), lambda s: F.transform(s["e"], lambda v: v / s["t"])))
    return F.when(F.size(x) > 0, p).otherwise(x.cast("array<double>"))


def softmax_matrix(x: Column, theta: float = 1.0, axis: int | None = None) -> Column:
    """Softmax of an array of equally long rows: down the columns (0), along the rows (1), or (None) the first axis longer than one."""
    turned = lambda m: F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda r: r[j])))
    along = lambda m: F.transform(m, lambda r: softmax_array(r, theta))
    by = {0: turned(along(turned(x))), 1: along(x)}
    return F.when(F.size(x) > 1, by[0]).otherwise(by[1]) if axis is None else by[axis]


def softmax_rows(df: DataFrame, keys: list[str], value: str, theta: float = 1.0, out: str = "p") -> DataFrame:
    """Softmax down the rows of each group (the first axis). Maximum and sum are pre-aggregated, so a group may be any size."""
    y = F.col(value).cast("double") * F.lit(float(theta))
    src = df.withColumn("_y", y)
    top = src.groupBy(*keys).agg(F.max("_y").alias("_m"))
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or F.lit(True)
    e = src.alias("s").join(top.alias("t"), on("s", "t")).select("s.*", F.exp(F.col("s._y") - F.col("t._m")).alias("_e"))
    total = e.groupBy(*keys).agg(F.sum("_e").alias("_t"))
    return e.alias("e").join(total.alias("u"), on("e", "u")).select("e.*", (F.col("e._e") / F.col("u._t")).alias(out)).drop("_y", "_e")
