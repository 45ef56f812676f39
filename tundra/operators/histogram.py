"""Fixed-width histograms: bins of ``quantum``, with exact zeros known apart.

A histogram is a table (keys..., bin, n, zeros): ``zeros`` is the weight of values equal to 0 (only in bin 0). Building is
one pre-aggregated group-by; the tables merge by union and sum, and every statistic comes from the few bins.

Defined results
    bins are floor(value * (1 / quantum)); -0.0 is a zero; bin 0 stands for two centres, 0.0 and quantum / 2, either of
    which may have count 0 and still is the smallest or largest centre; one value has deviation 0.0; nulls don't
    count; no values give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _check(quantum: float) -> float:
    if not quantum or quantum != quantum:
        raise ValueError("the quantum of a histogram can't be zero")
    return float(quantum)


def bin_of(value: Column, quantum: float) -> Column:
    return F.floor(value * F.lit(1.0 / _check(quantum))).cast("bigint")


def build(df: DataFrame, keys: list[str], value: str, quantum: float = 0.5, weight: str | None = None) -> DataFrame:
    x, w = F.col(value).cast("double"), F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    src = df.select(*keys, x.alias("_x"), w.alias("_w")).filter("_x IS NOT NULL AND _w IS NOT NULL")
    return src.groupBy(*keys, bin_of(F.col("_x"), quantum).alias("bin")).agg(F.sum("_w").alias("n"), F.sum(F.when(F.col("_x") == 0, F.col("_w")).otherwise(F.lit(0))).cast("bigint").alias("zeros"))


def centres(bins: DataFrame, keys: list[str], quantum: float) -> DataFrame:
    """(keys..., centre, n); bin 0 gives the exact zeros and the rest."""
    q = _check(quantum)
    two = F.array(F.struct(F.lit(0.0).alias("centre"), F.col("zeros").alias("n")), F.struct(F.lit(q * 0.5).alias("centre"), (F.col("n") - F.col("zeros")).alias("n")))
    one = F.array(F.struct((F.col("bin") * F.lit(q) + F.lit(q * 0.5)).alias("centre"), F.col("n").alias("n")))
    return bins.select(*keys, F.explode(F.when(F.col("bin") == 0, two).otherwise(one)).alias("_c")).select(*keys, "_c.centre", "_c.n")


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of the same quantum."""
    return a.unionByName(b).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("zeros").alias("zeros"))


def rebin(bins: DataFrame, keys: list[str], quantum: float, new_quantum: float) -> DataFrame:
    """The histogram of another quantum, from the centres."""
    return build(centres(bins, keys, quantum), keys, "centre", new_quantum, "n")


def statistics(bins: DataFrame, keys: list[str], quantum: float) -> DataFrame:
    """count, mean, stdv, min, max, q1, median, q3 of each group's centres."""
    c = centres(bins, keys, quantum)
    s = c.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.try_divide(F.sum(F.col("centre") * F.col("n")), F.sum("n")).alias("mean"), F.min("centre").alias("min"), F.max("centre").alias("max")
    )
    both = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] or F.lit(True)
    j = c.alias("c").join(s.alias("s"), both).select(*[F.col(f"c.{k}").alias(k) for k in keys], "c.centre", "c.n", "s.count", "s.mean", "s.min", "s.max")
    # a group has as many rows as bins here
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("centre").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_cum", F.sum("n").over(w))
    at = lambda k: F.min(F.when(F.col("_cum") >= F.floor(F.col("count") * k / 4), F.col("centre")))
    dev = F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("centre") - F.col("mean")) * (F.col("centre") - F.col("mean"))), F.max("count") - 1))
    return j.groupBy(*keys).agg(
        F.max("count").alias("count"), F.max("mean").alias("mean"), F.when(F.max("count") > 1, dev).otherwise(F.lit(0.0)).alias("stdv"),
        F.max("min").alias("min"), F.max("max").alias("max"), at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"),
    )


def raw(bins: DataFrame, keys: list[str], quantum: float) -> DataFrame:
    """Every centre as often as it counts."""
    return centres(bins, keys, quantum).filter("n > 0").select(*keys, F.explode(F.array_repeat("centre", F.col("n").cast("int"))).alias("value"))


def to_json(bins: DataFrame, keys: list[str], quantum: float) -> DataFrame:
    """The histogram of each group as a JSON object of its bins, quantum and strictly_zero."""
    g = bins.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string").alias("k"), F.col("n").cast("double").alias("v"))))).alias("m"), F.sum("zeros").alias("z"))
    meta = F.create_map(F.lit("quantum"), F.lit(float(quantum)), F.lit("strictly_zero"), F.col("z").cast("double"))
    return g.select(*keys, F.to_json(F.map_concat("m", meta)).alias("json"))


def from_json(df: DataFrame, keys: list[str], text: str = "json") -> DataFrame:
    """(keys..., quantum, bin, n, zeros) from such JSON."""
    m = df.select(*keys, F.from_json(text, "map<string,double>").alias("m"))
    e = m.select(*keys, F.element_at("m", "quantum").alias("quantum"), F.element_at("m", "strictly_zero").cast("bigint").alias("z"), F.explode(F.map_entries(F.map_filter("m", lambda k, _: ~k.isin("quantum", "strictly_zero")))).alias("e"))
    b = F.col("e.key").cast("bigint")
    return e.select(*keys, "quantum", b.alias("bin"), F.col("e.value").cast("bigint").alias("n"), F.when(b == 0, F.col("z")).otherwise(F.lit(0)).cast("bigint").alias("zeros"))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., equal): whether two histograms hold the same bins."""
    j = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "bin"]], "full_outer")
    ok = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.zeros").eqNullSafe(F.col("b.zeros"))
    return j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], ok.alias("_ok")).groupBy(*keys).agg(F.every("_ok").alias("equal"))


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., sign): -1, 0 or 1 as the first histogram comes before, with or after the second.

    The one with fewer bins comes first; of as many, the lowest bin that either lacks or counts differently decides: the lower bin
    first, at the same bin the smaller count; then the zeros.
    """
    both = [*keys, "bin"]
    j = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in both], "full_outer")
    differs = ~F.col("a.n").eqNullSafe(F.col("b.n"))
    g = j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *[F.when(F.col(f"{t}.bin").isNotNull() & differs, F.struct(f"{t}.bin", f"{t}.n")).alias(f"d{t}") for t in "ab"], F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.zeros").alias("za"), F.col("b.zeros").alias("zb"))
    g = g.groupBy(*keys).agg(F.count("na").alias("la"), F.count("nb").alias("lb"), F.min("da").alias("da"), F.min("db").alias("db"), F.sum("za").alias("za"), F.sum("zb").alias("zb"))
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return g.select(*keys, F.coalesce(sign(F.col("la"), F.col("lb")), sign(F.col("da.bin"), F.col("db.bin")), sign(F.col("da.n"), F.col("db.n")), sign(F.col("za"), F.col("zb")), F.lit(0)).alias("sign"))
