"""A keyed store as immutable snapshots: (key, value ...) DataFrames with unique keys.

Mutations give a new snapshot; several writes of one key resolve to the last by an order column. Joins are left to
Catalyst and AQE (hash join where a side is small by its own statistics, else sort merge). Snapshots are written sorted
by key, so ranges prune row groups.

Defined results
    missing keys are ignored by deletes and give the default (null) on reads; null keys are not stored; duplicate keys in a
    debit or credit request are refused (``check_unique``); an empty store or request gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.runtime import checkpoint
from ..sources.files import run_suffix


def last_wins(writes: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the write with the greatest order; a partial aggregate, so hot keys combine early."""
    rest = [c for c in writes.columns if c not in (key, order)]
    return writes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def upsert(store: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """``writes`` (unique keys) replace or add."""
    return store.join(writes, key, "left_anti").unionByName(writes)


def put_all(store: DataFrame, keys: DataFrame, key: str, value: str, constant: object) -> DataFrame:
    """One constant for many keys."""
    kind = dict(store.dtypes)[value]
    return upsert(store, keys.select(key).distinct().withColumn(value, F.lit(constant).cast(kind)).select(*store.columns), key)


def get_all(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every requested key with its value or null."""
    return keys.select(key).join(store, key, "left")


def get(store: DataFrame, key: str, k: object, value: str, default: object = None) -> object:
    """One value or the default; without a default a missing key raises KeyError."""
    row = store.filter(F.col(key) == F.lit(k)).select(value).head()
    if row is None and default is None:
        raise KeyError(k)
    return default if row is None else row[0]


def delete_all(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def pop_all(store: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what was taken, the store without it)."""
    return store.join(keys.select(key).distinct(), key, "left_semi"), delete_all(store, keys, key)


def set_default(store: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Adds only keys that are absent."""
    return store.unionByName(defaults.join(store, key, "left_anti").select(*store.columns))


def get_and_set(store: DataFrame, value: str, setter, new: str = "new_value") -> DataFrame:
    """The old value beside the one a Column function makes of it."""
    return store.withColumn(new, setter(F.col(value)))


def contains(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.select(key).join(store.select(key, F.lit(True).alias("_in")), key, "left").select(key, F.coalesce("_in", F.lit(False)).alias("present"))


def key_range(store: DataFrame, key: str, low: object = None, high: object = None) -> DataFrame:
    """Inclusive, in (signed) key order."""
    out = store
    if low is not None:
        out = out.filter(F.col(key) >= F.lit(low))
    if high is not None:
        out = out.filter(F.col(key) <= F.lit(high))
    return out.orderBy(key)


def save(store: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """A snapshot sorted by key, so that later ranges skip row groups."""
    store.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def check_store(store: DataFrame, key: str) -> DataFrame:
    """The store, if its key can be one: whole numbers, text or bytes, and no nested or approximate type."""
    kind = dict(store.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint", "string", "binary"):
        raise TypeError(f"a key can't be {kind}")
    return store


@dataclass(frozen=True)
class Options:
    """How a store on disk keeps its rows: whole-number keys or keys by a codec, values by a codec; what a new one does to an old one."""

    integer_keys: bool = True
    key_codec: str | None = None
    value_codec: str | None = None
    overwrite: bool = False
    dated: bool = False

    def __post_init__(self) -> None:
        if self.key_codec not in CODECS or self.value_codec not in CODECS:
            raise ValueError(f"codecs are {sorted(c for c in CODECS if c)} or None")
        if self.integer_keys and self.key_codec:
            raise ValueError("whole-number keys have no codec")


#: codec -> (to bytes or text, back to a type); pickles are unsafe and not offered
CODECS: dict[str | None, tuple] = {
    None: (lambda c: c, lambda c, kind: c),
    "json": (lambda c: F.to_json(F.struct(c.alias("v"))), lambda c, kind: F.from_json(c, f"v {kind}")["v"]),
    "text": (lambda c: c.cast("string"), lambda c, kind: c.cast(kind)),
}


def packing_functions(options: Options) -> tuple:
    """(pack key, unpack key, pack value, unpack value) as Column functions; the unpacking ones also take the type."""
    key = (lambda c: c.cast("bigint"), lambda c, kind: c.cast(kind)) if options.integer_keys else CODECS[options.key_codec]
    return (*key, *CODECS[options.value_codec])


class Store:
    """A keyed store in a folder: immutable snapshots, the last of which counts; its options stay with it and its copies."""

    def __init__(self, spark: SparkSession, path: str, key: str, kinds: dict[str, str], options: Options | None = None) -> None:
        self.spark, self.key, self.kinds, self.options = spark, key, kinds, options or Options()
        self.path = path + run_suffix() if self.options.dated else path

    def write(self, rows: DataFrame) -> Store:
        """The rows as the store's new snapshot; an old one is an error unless the store overwrites."""
        pack_key, _, pack, _ = packing_functions(self.options)
        packed = check_store(rows, self.key).select(*[(pack_key if c == self.key else pack)(F.col(c)).alias(c) for c in rows.columns]) if not self.options.key_codec else rows.select(*[(pack_key if c == self.key else pack)(F.col(c)).alias(c) for c in rows.columns])
        save(packed, self.path, self.key, self.options.overwrite)
        return self

    def read(self) -> DataFrame:
        _, unpack_key, _, unpack = packing_functions(self.options)
        return open_store(self.spark, self.path).select(*[(unpack_key if c == self.key else unpack)(F.col(c), k).alias(c) for c, k in self.kinds.items()])

    def copy(self, path: str | None = None) -> Store:
        """A store with the same rows and options in a folder of its own."""
        other = Store(self.spark, path or f"{self.path}.copied.{run_suffix()}", self.key, self.kinds, replace(self.options, dated=False))
        return other.write(self.read())


def store_factory(spark: SparkSession, root: str, key: str = "key", kinds: dict[str, str] | None = None, options: Options | None = None):
    """A maker of named stores under one folder, with the same options."""
    return lambda name: Store(spark, f"{root.rstrip('/')}/{name}", key, kinds or {"key": "bigint", "value": "bigint"}, options)


def check_unique(requests: DataFrame, key: str) -> DataFrame:
    """The requests, with a runtime error where a key comes twice."""
    n = requests.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return requests.join(n, key).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key comes twice: "), F.col(key).cast("string"))).cast(dict(requests.dtypes)[key])).otherwise(F.col(key))).drop("_n")


def debit_value(value: Column, amount: Column, least: Column) -> tuple[Column, Column]:
    """(new value, what could not be taken). Below the floor nothing is taken."""
    return F.when(value < least, value).otherwise(F.greatest(value - amount, least)), F.when(value < least, amount).otherwise(F.greatest(least - (value - amount), F.lit(0)))


def credit_value(value: Column, amount: Column, most: Column) -> tuple[Column, Column]:
    """(new value, what could not be added). Above the ceiling nothing is added."""
    return F.when(value > most, value).otherwise(F.least(value + amount, most)), F.when(value > most, amount).otherwise(F.greatest((value + amount) - most, F.lit(0)))


def _apply(store: DataFrame, requests: DataFrame, key: str, value: str, rule, bound: str, checked: bool) -> DataFrame:
    r = check_unique(requests, key) if checked else requests
    new, unmet = rule(F.col(value), F.col("amount"), F.col(bound))
    return r.join(store.select(key, value), key).select(key, F.col(value).alias("old_value"), new.alias("new_value"), unmet.alias("unmet"))


def debit_all(store: DataFrame, requests: DataFrame, key: str, value: str = "value", checked: bool = True) -> DataFrame:
    """(key, old_value, new_value, unmet) of requests (key, amount, min_remaining)."""
    return _apply(store, requests, key, value, debit_value, "min_remaining", checked)


def credit_all(store: DataFrame, requests: DataFrame, key: str, value: str = "value", checked: bool = True) -> DataFrame:
    """(key, old_value, new_value, unmet) of requests (key, amount, max_remaining)."""
    return _apply(store, requests, key, value, credit_value, "max_remaining", checked)


#: slices of the order at least and at most, and rows aimed at in one
SLICES, MOST_SLICES, SLICE_ROWS = 256, 20_000, 100_000


def credit_from_pool(requests: DataFrame, order: str, value: str, most: str, pool: float, group: list[str] | None = None) -> DataFrame:
    """Water-fill a shared pool in order: adds (new_value, taken, leftover).

    Running needs without one task for all: requests are cut into slices of the order by a sketch, slice totals give
    what came before each slice, and the window runs inside a slice. ``order`` must be unique.
    """
    if pool < 0:
        raise ValueError("a pool can't be negative")
    g = group or []
    src = requests.withColumn("_need", F.greatest(F.col(most) - F.col(value), F.lit(0)))
    k = min(MOST_SLICES, max(SLICES, requests.count() // SLICE_ROWS))
    # read more than once, and an approximate sketch need not come out the same twice
    cuts = checkpoint(src.groupBy(*g).agg(F.percentile_approx(order, [i / k for i in range(1, k)], max(1000, 4 * k)).alias("_cuts"), F.sum("_need").alias("_all")))
    on = lambda a, b, ks: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ks] or F.lit(True)
    s = src.alias("a").join(cuts.alias("b"), on("a", "b", g)).select("a.*", "b._all", F.size(F.filter("b._cuts", lambda c: c < F.col(f"a.{order}"))).alias("_s"))
    totals = s.groupBy(*g, "_s").agg(F.sum("_need").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*(g or [F.lit(0)])).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    j = s.alias("a").join(before.alias("b"), on("a", "b", [*g, "_s"])).select("a.*", "b._before")
    prev = F.col("_before") + F.coalesce(F.sum("_need").over(Window.partitionBy(*g, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.least(F.col("_need"), F.lit(pool) - prev), F.lit(0))
    return j.withColumn("taken", taken).withColumn("new_value", F.col(value) + F.col("taken")).withColumn("leftover", F.greatest(F.lit(pool) - F.col("_all"), F.lit(0))).drop("_need", "_all", "_s", "_before")
