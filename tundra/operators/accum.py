"""Mergeable accumulators as native aggregates: sums, moments, extrema and exact order statistics.

Sums, moments and extrema are partial plus final aggregates. Order statistics (upper median, quartiles by integer
rank) are exact and never gather a group in one task: equal values are counted first, the values of each
group are cut into buckets by an approximate sketch, bucket totals tell which bucket holds a rank, and only that
bucket is kept; it is cut again until it is small, and then ordered. The sketch decides the cut, not the result.

Defined results
    nulls don't count; a group without values has count 0 and null statistics; one value has deviation 0.0; ties and
    repeated rows count each; NaN sorts last; an empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from ..functions.casts import float_value, int_value
from ..plans.runtime import checkpoint

#: buckets of a group, found in two steps of STEP each
STEP = 8
BUCKETS = STEP * STEP
#: distinct values of a bucket that are ordered in one task; a bucket with more is cut again
ORDER_ROWS, MAX_ROUNDS = 2_000_000, 16
#: integer ranks (k, d): the value at position k*n // d of the sorted values
RANKS = {"q1": (1, 4), "median": (1, 2), "q3": (3, 4)}


def stat_val(x: Column) -> Column:
    """(sum, count, min, max) in one aggregate buffer."""
    return F.struct(F.sum(x).alias("sum"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"))


def merge_stat_vals(s: Column) -> Column:
    """Merge of such structs; the same as accumulating all their values."""
    return F.struct(F.sum(s["sum"]).alias("sum"), F.sum(s["count"]).alias("count"), F.min(s["min"]).alias("min"), F.max(s["max"]).alias("max"))


def stat_mean(s: Column) -> Column:
    return F.try_divide(s["sum"], s["count"])


def sample_stdv(x: Column) -> Column:
    """n-1 deviation, 0.0 for a single value, null for none."""
    return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))


#: scalar views of an accumulator by name
VIEWS = {"ave": F.avg, "mean": F.avg, "stdv": sample_stdv, "min": F.min, "max": F.max, "count": F.count, "sum": F.sum}


def _bucket(cuts: Column, x: Column) -> Column:
    """How many of the sorted cuts are below x."""
    below = lambda a: F.size(F.filter(a, lambda c: c < x))
    coarse = below(F.array(*[F.element_at(cuts, STEP * i) for i in range(1, STEP)])) * STEP
    return let(coarse, lambda b: b + below(F.slice(cuts, b + 1, STEP - 1)))


def _same(a: str, b: str, cols: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]


def _cuts(x: str) -> Column:
    return F.percentile_approx(x, [i / BUCKETS for i in range(1, BUCKETS)], 1000)


def _ordered(src: DataFrame, ks: list[str], ranks: dict[str, tuple[int, int]], extras: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(groups with ``extras``, groups with the values at ranks) of ``_x`` by the columns ``ks``: two scans of ``src``.

    The first scan has the extras, counts and sketches; the second the value counts, of which each round keeps the buckets that
    hold a rank, until these are small enough to be ordered.
    """
    # read more than once, and an approximate sketch need not come out the same twice
    base = checkpoint(src.groupBy(*ks).agg(F.count("_x").alias("_n"), _cuts("_x").alias("_cuts"), *extras))
    held = src.filter("_x IS NOT NULL").groupBy(*ks, "_x").agg(F.count(F.lit(1)).alias("_c"))
    wanted = base.filter("_n > 0").select(*ks, F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.floor(F.col("_n") * k / d).alias("_rank")) for n, (k, d) in ranks.items()])).alias("_r")).select(*ks, "_r.*")
    sketch, by = base.filter("_n > 0").select(*ks, "_cuts"), list(ks)
    # where no group is large its buckets can't be, which saves looking
    few = (base.agg(F.max("_n")).head()[0] or 0) <= ORDER_ROWS * BUCKETS // 4
    for _ in range(MAX_ROUNDS):
        cut = held.alias("h").join(sketch.alias("s"), _same("h", "s", by)).select("h.*", _bucket(F.col("s._cuts"), F.col("h._x")).alias("_b"))
        totals = cut.groupBy(*by, "_b").agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_d"))
        w = Window.partitionBy(*by).orderBy("_b")  # at most BUCKETS rows a group
        totals = totals.withColumn("_hi", F.sum("_t").over(w)).withColumn("_lo", F.col("_hi") - F.col("_t"))
        where = wanted.alias("r").join(totals.alias("t"), [*_same("r", "t", by), F.col("r._rank") >= F.col("t._lo"), F.col("r._rank") < F.col("t._hi")]).select(*[f"r.{k}" for k in ks], "r._name", (F.col("r._rank") - F.col("t._lo")).alias("_rank"), "t._b", "t._d")
        where = where if few else checkpoint(where)
        run = cut.alias("c").join(where.alias("w"), _same("c", "w", [*by, "_b"])).select(*[f"c.{k}" for k in ks], "w._name", "c._x", "c._c", "w._rank")
        if few or (where.agg(F.max("_d")).head()[0] or 0) <= ORDER_ROWS:
            break
        by = [*ks, "_name"]
        held, wanted = checkpoint(run.select(*by, "_x", "_c")), where.select(*by, "_rank")
        sketch = checkpoint(held.groupBy(*by).agg(_cuts("_x").alias("_cuts")))
    else:
        raise RuntimeError(f"ranks are not found in {MAX_ROUNDS} rounds")
    run = run.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*ks, "_name").orderBy("_x")))
    return base, run.filter("_cum > _rank").groupBy(*ks).agg(*[F.min(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in ranks])


def _source(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, list[str]]:
    """(group columns _k0, _k1 ... and _x, their names)."""
    groups = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_k0")]
    return df.select(*groups, F.col(value).cast("double").alias("_x")), [f"_k{i}" for i in range(len(groups))]


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row a group with the values at integer ranks; see the module for the method."""
    ranks = ranks or RANKS
    src, ks = _source(df, keys, value)
    got = _ordered(src, ks, ranks, [])[1]
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *ranks)


def accumulate(df: DataFrame, keys: list[str], value: str, tags: dict[str, str] | None = None) -> DataFrame:
    """Groups with the tagged views of one accumulator: {output column: view}; moments come with the first scan."""
    tags = tags or {v: v for v in ("count", "mean", "stdv", "min", "max", "median", "q1", "q3")}
    moments = {out: v for out, v in tags.items() if v in VIEWS}
    if all(v in VIEWS for v in tags.values()):
        return df.groupBy(*keys).agg(*[VIEWS[v](F.col(value)).alias(out) for out, v in moments.items()])
    src, ks = _source(df, keys, value)
    wide = _views(src, ks, tags)
    return wide.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *tags)


def _views(src: DataFrame, ks: list[str], tags: dict[str, str]) -> DataFrame:
    """The groups ``ks`` of ``_x`` with their tagged views."""
    extras = [VIEWS[v](F.col("_x")).alias(out) for out, v in tags.items() if v in VIEWS]
    ordered = {f"_o_{out}": RANKS[v] for out, v in tags.items() if v in RANKS}
    base, got = _ordered(src, ks, ordered, extras)
    b, o = base.alias("b"), got.alias("o")
    return b.join(o, _same("b", "o", ks), "left").select(*[f"b.{k}" for k in ks], *[F.col(f"b.{out}") if v in VIEWS else F.col(f"o._o_{out}").alias(out) for out, v in tags.items()])


def tag_aware(df: DataFrame, keys: list[str], values: dict[str, str], suffixes: dict[str, str]) -> DataFrame:
    """An accumulator for each value column, fanned out into key+tag columns; all columns go through the same two scans.

    ``values``: {name: column}; ``suffixes``: {'_ave': 'mean', ...}.
    """
    groups = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_k0")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_of"), F.col(c).cast("double").alias("_x")) for n, c in values.items()])).alias("_e")
    ks = [f"_k{i}" for i in range(len(groups))]
    src = df.select(*groups, each).select(*ks, "_e._of", "_e._x")
    if all(v in VIEWS for v in suffixes.values()):
        long = src.groupBy(*ks, "_of").agg(*[VIEWS[v](F.col("_x")).alias(f"_v{s}") for s, v in suffixes.items()])
    else:
        long = _views(src, [*ks, "_of"], {f"_v{s}": v for s, v in suffixes.items()})
    pick = lambda n, s: F.max(F.when(F.col("_of") == n, F.col(f"_v{s}")))
    wide = long.groupBy(*ks).agg(*[pick(n, s).alias(n + s) for n in values for s in suffixes])  # one row for each group and name
    return wide.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"`{n}{s}`") for n in values for s in suffixes])


def tag_names(entries: list[str], accumulators: list[str], suffixes: list[str]) -> list[str]:
    """The column names of a tagged view: plain entries and every accumulator with every suffix."""
    return [*(e for e in entries if e not in accumulators), *(a + s for a in accumulators for s in suffixes)]


def resolve_tag(name: str, entries: list[str], accumulators: list[str], suffixes: list[str]) -> tuple[str, str | None] | None:
    """(entry, suffix) of a name of a tagged view. A bare accumulator's name resolves although it is never listed."""
    if name in entries:
        return name, None
    return next(((name[: -len(s)], s) for s in suffixes if s and name.endswith(s) and name[: -len(s)] in accumulators), None)


def set_entry(view: DataFrame, name: str, value: Column) -> DataFrame:
    """A tagged view with an entry set under exactly this name."""
    return view.withColumn(name, value)


def delete_entry(view: DataFrame, name: str, accumulators: list[str], suffixes: list[str]) -> DataFrame:
    """A tagged view without an entry: an accumulator goes with its bare name or its first tag; its other tags are ignored.

    What the view doesn't have is a KeyError.
    """
    plain = [c for c in view.columns if not any(c == a + s for a in accumulators for s in suffixes)]
    if name in plain:
        return view.drop(name)
    owner = name if name in accumulators else next((a for a in accumulators if name == a + suffixes[0]), None)
    if owner is not None:
        return view.drop(*[owner + s for s in suffixes])
    if any(name.endswith(s) for s in suffixes[1:]):
        return view
    raise KeyError(name)


def value_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact value counts: one row for each (group, value)."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def multi_val(df: DataFrame, keys: list[str], names: list[str], views: tuple[str, ...] = ("mean", "stdv", "min", "max", "count")) -> DataFrame:
    """Statistics of several columns in one pass; the mean of whole numbers is their true mean."""
    return df.groupBy(*keys).agg(*[VIEWS[v](F.col(n).cast("double") if v != "count" else F.col(n)).alias(f"{n}_{v}") for n in names for v in views])


def merge_multi_val(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; the name sets must be the same."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"names differ: {sorted(a.columns)} and {sorted(b.columns)}")
    return a.unionByName(b)


def position_list(rows: str, name: str) -> Column:
    """One field of every row of an array of structs."""
    return F.transform(F.col(rows), lambda r: r[name])


def entry(rows: str, index: int) -> Column:
    """Row ``index`` (0-based) of an array of structs; null beyond its end."""
    return F.try_element_at(F.col(rows), F.lit(index + 1))


def column_lists(df: DataFrame, keys: list[str], names: list[str], order: str) -> DataFrame:
    """Rows of each group as one ordered list for each column. Groups become one value, so they must be small."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[n for n in names if n != order])))
    return df.groupBy(*keys).agg(rows.alias("_r")).select(*keys, *[position_list("_r", n).alias(n) for n in names])


def render(mean: Column, stdv: Column, digits: int = 6) -> Column:
    """The text form mean+-stdv."""
    return F.format_string(f"%.{digits}f+-%.{digits}f", mean, stdv)


@dataclass(frozen=True)
class Shown:
    """How accumulators of ``stat_val`` show as a number and as text unless told otherwise; both can be exchanged."""

    number: Callable[[Column], Column] = lambda s: s["max"]
    text: Callable[[Column], Column] = lambda s: F.concat(F.lit("StatVal(mean="), F.format_string("%.6f", stat_mean(s)), F.lit(", n="), s["count"].cast("string"), F.lit(")"))

    def with_number(self, view: Callable[[Column], Column]) -> Shown:
        return replace(self, number=view)

    def with_text(self, view: Callable[[Column], Column]) -> Shown:
        return replace(self, text=view)


def _bad(v: Column, kind: str, strict: bool) -> Column:
    return F.raise_error(F.concat(F.lit("no number: "), v)).cast(kind) if strict else F.lit(None).cast(kind)


def high_water_float(v: Column, kind: str = "scalar", strict: bool = True) -> Column:
    """Null or 'NA' is 0, an array or accumulator (``kind`` 'array', 'accumulator') its largest value, else the number.

    What has no largest value (no elements, only nulls) is 0 too. Text that is no number is an error, or null if not ``strict``.
    """
    if kind == "array":
        return F.coalesce(F.array_max(F.transform(v, lambda x: float_value(x.cast("string")))), F.lit(0.0))
    if kind == "accumulator":
        return F.coalesce(v["max"].cast("double"), F.lit(0.0))
    if kind != "scalar":
        raise ValueError(f"no such kind: {kind}")
    t = v.cast("string")
    return F.when(t.isNull() | (t == "NA"), F.lit(0.0)).otherwise(F.coalesce(float_value(t), _bad(t, "double", strict)))


def high_water_int(v: Column, strict: bool = True) -> Column:
    """The same for whole numbers; arrays and accumulators are not accepted."""
    t = v.cast("string")
    return F.when(t.isNull() | (t == "NA"), F.lit(0).cast("bigint")).otherwise(F.coalesce(int_value(t), _bad(t, "bigint", strict)))


def high_water(df: DataFrame, column: str, strict: bool = True) -> Column:
    """``high_water_float`` of a column by its type: arrays, accumulator structs and scalars."""
    kind = dict(df.dtypes)[column]
    return high_water_float(F.col(column), "array" if kind.startswith("array") else "accumulator" if kind.startswith("struct") else "scalar", strict)
