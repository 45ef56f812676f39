import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tundra.functions import softmax
from tundra.operators import accum as A
from tundra.operators import histogram as H
from tundra.operators import timed


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, None if v is None else float(v)) for v in values], "k string, v double")


@pytest.mark.parametrize("values,want", [
    ([9, 12, 13, 8, 8], dict(mean=10.0, stdv=2.3452078799117149, min=8, max=13, median=9, q1=8, q3=12, count=5)),
    ([1, 2, 3, 4], dict(mean=2.5, stdv=1.2909944487358056, median=3, q1=2, q3=4, count=4)),
    ([7], dict(mean=7, stdv=0.0, median=7, q1=7, q3=7, count=1)),
    ([5, None, 5, 5], dict(stdv=0.0, median=5, count=3)),
])
def test_fixtures(spark, values, want):
    got = A.accumulate(frame(spark, values), ["k"], "v").head().asDict()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_order_statistics_exact(spark):
    r = random.Random(1)
    data = [("hot", r.gauss(0, 1)) for _ in range(5000)] + [("ties", float(r.randint(0, 3))) for _ in range(999)] + [(None, float(i)) for i in range(10)] + [("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {x.k: x for x in A.order_statistics(df, ["k"], "v").collect()}
    for k in ("hot", "ties", None):
        s = sorted(v for kk, v in data if kk == k and v is not None)
        assert [got[k].q1, got[k].median, got[k].q3] == [s[len(s) // 4], s[len(s) // 2], s[3 * len(s) // 4]]
    assert "none" not in got and A.accumulate(df.filter("k = 'none'"), ["k"], "v").head()["count"] == 0
    assert A.order_statistics(df.limit(0), ["k"], "v").count() == 0
    s = sorted(v for _, v in data if v is not None)
    assert A.accumulate(df, [], "v").head().median == s[len(s) // 2]


def test_merge_is_accumulate(spark):
    df = spark.createDataFrame([(i % 5, float(i * i % 17)) for i in range(100)], "g int, v double")
    merged = df.groupBy("g").agg(A.stat_val(F.col("v")).alias("s")).agg(A.merge_stat_vals(F.col("s")).alias("s")).head().s
    assert merged == df.agg(A.stat_val(F.col("v")).alias("s")).head().s


def test_tags():
    tags = ["_ave", "_stdv", "_min", "_max", "_median", "_count"]
    names = A.tag_names(["bar", "foo", "baz"], ["bar"], tags)
    assert len(names) == 8
    assert A.resolve_tag("bar_max", ["bar", "foo"], ["bar"], tags) == ("bar", "_max")
    assert A.resolve_tag("foo_max", ["bar", "foo"], ["bar"], tags) is None and A.resolve_tag("bar", ["bar"], ["bar"], tags) == ("bar", None)


def test_multi_val_names(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "y int, x int")
    assert rows(A.merge_multi_val(a, b), "x", "y") == [(1, 2), (4, 3)]
    with pytest.raises(ValueError):
        A.merge_multi_val(a, b.drop("x"))
    c = A.column_lists(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, s int, v string"), ["k"], ["s", "v"], "s").head()
    assert c.s == [1, 2] and c.v == ["a", "b"]


def simulate(values, q):
    bins, zeros = {}, 0
    for v in values:
        zeros += v == 0
        k = math.floor(v * (1.0 / q))
        bins[k] = bins.get(k, 0) + 1
    cs = []
    for k, n in bins.items():
        cs += [(0.0, zeros), (q / 2, n - zeros)] if k == 0 else [(k * q + q / 2, n)]
    cs.sort()
    n = sum(c for _, c in cs)
    mean = sum(a * b for a, b in cs) / n
    stdv = math.sqrt(sum(b * (a - mean) ** 2 for a, b in cs) / (n - 1)) if n > 1 else 0.0

    def at(lim):
        off = 0
        for a, b in cs:
            if off + b >= lim:
                return a
            off += b

    return dict(count=n, mean=mean, stdv=stdv, min=cs[0][0], max=cs[-1][0], q1=at(n // 4), median=at(n // 2), q3=at(3 * n // 4))


@pytest.mark.parametrize("q", [0.5, 0.1, 7.0])
@pytest.mark.parametrize("values", [[0.0], [0.0, 0.01, 0.0], [-0.0, -3.2, 5.5, 5.6], [random.Random(3).uniform(-20, 20) for _ in range(300)] + [0.0] * 9])
def test_histogram(spark, q, values):
    bins = H.build(frame(spark, values), ["k"], "v", q)
    got, want = H.statistics(bins, ["k"], q).head().asDict(), simulate(values, q)
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    again = H.from_json(H.to_json(bins, ["k"], q), ["k"])
    assert rows(again, "bin", "n", "zeros") == rows(bins, "bin", "n", "zeros")
    assert rows(H.merge(bins, bins, ["k"]), "bin", "n") == [(b, 2 * n) for b, n in rows(bins, "bin", "n")]


def test_histogram_edges(spark):
    with pytest.raises(ValueError):
        H.build(frame(spark, [1]), ["k"], "v", 0.0)
    assert H.statistics(H.build(frame(spark, [None]), ["k"], "v"), ["k"], 0.5).count() == 0
    w = spark.createDataFrame([("a", 1.2, 5), ("a", 0.0, 2), ("a", None, 3)], "k string, v double, w int")
    assert rows(H.build(w, ["k"], "v", 0.5, "w")) == [("a", 0, 2, 2), ("a", 2, 5, 0)]
    assert rows(H.raw(H.build(w, ["k"], "v", 0.5, "w"), ["k"], 0.5), "value") == [(0.0,)] * 2 + [(1.25,)] * 5


def test_timed(spark):
    data = [("s", 0.0, 1.0, 4.0)] + [("s", float(i), float(i), i + 1.0) for i in range(4)] + [("s", 1.0, t, None) for t in (5.0, 6.0, 7.0, 8.0, 9.0)]
    got = timed.timed_statistics(spark.createDataFrame(data, "k string, v double, a double, b double"), ["k"], "v", "a", "b").head()
    assert (got["count"], got.min_t, got.max_t, got.max_t_end) == (10, 0.0, 9.0, None)


def test_softmax(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "id int, x array<double>")
    got = {r.id: r.p for r in df.select("id", softmax.softmax_array(F.col("x")).alias("p")).collect()}
    assert got[1] == pytest.approx([0.2689414214, 0.7310585786]) and got[2] == [] and got[3] is None
    p = rows(softmax.softmax_rows(frame(spark, [1, 2, 1000]), ["k"], "v", 1.0), "p")
    assert sum(x for (x,) in p) == pytest.approx(1.0)


def test_high_water_of_arrays_and_accumulators(spark):
    df = spark.createDataFrame([(1, [1.5, None, 7.0]), (2, [-3.0, -2.0]), (3, [None]), (4, []), (5, None)], "id int, v array<double>")
    high = {r[0]: r[1] for r in df.select("id", A.high_water_float(F.col("v"), "array")).collect()}
    assert high == {1: 7.0, 2: -2.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert [r[0] for r in df.select(A.high_water_float(F.transform("v", lambda x: x.cast("string")), "array")).collect()] == [7.0, -2.0, 0.0, 0.0, 0.0]
    held = df.select("id", F.explode_outer("v").alias("x")).groupBy("id").agg(A.stat_val(F.col("x")).alias("s"))
    assert {r[0]: r[1] for r in held.select("id", A.high_water_float(F.col("s"), "accumulator")).collect()} == high
    assert [r[0] for r in spark.createDataFrame([("NA",), ("2.5",), (None,)], "t string").select(A.high_water_float(F.col("t"))).collect()] == [0.0, 2.5, 0.0]
    for bad in ("x", "1.0d"):
        df = spark.createDataFrame([(bad,)], "t string")
        assert df.select(A.high_water_float(F.col("t"), strict=False)).head()[0] is None and df.select(A.high_water_int(F.col("t"), strict=False)).head()[0] is None
        with pytest.raises(Exception, match="no number"):
            df.select(A.high_water_float(F.col("t"))).collect()
        with pytest.raises(Exception, match="no number"):
            df.select(A.high_water_int(F.col("t"))).collect()


def test_order_statistics_in_rounds(spark, monkeypatch):
    """Buckets too large to be ordered are cut again; the result is the same."""
    r = random.Random(2)
    df = spark.createDataFrame([(k, r.gauss(0, 1)) for k in "ab" for _ in range(3000)] + [("c", 5.0)] * 50, "k string, v double")
    want = rows(A.order_statistics(df, ["k"], "v"))
    monkeypatch.setattr(A, "ORDER_ROWS", 3)  # more rows than 3 * BUCKETS / 4, too
    assert rows(A.order_statistics(df, ["k"], "v")) == want


def test_tag_edits(spark):
    v = spark.createDataFrame([(1, 2, 3, 4)], "k int, v_ave int, v_max int, other int")
    edit = lambda name: A.delete_entry(v, name, ["v"], ["_ave", "_max"]).columns
    assert edit("other") == ["k", "v_ave", "v_max"] and edit("v_ave") == edit("v") == ["k", "other"] and edit("v_max") == v.columns
    with pytest.raises(KeyError):
        edit("none")
    assert A.set_entry(v, "v_ave", F.lit(9)).head().v_ave == 9


def test_shown(spark):
    s = spark.createDataFrame([(1.0,), (3.0,)], "v double").agg(A.stat_val(F.col("v")).alias("s"))
    d = A.Shown()
    assert s.select(d.number(F.col("s")), d.text(F.col("s"))).head()[:] == (3.0, "StatVal(mean=2.000000, n=2)")
    assert s.select(d.with_number(A.stat_mean).number(F.col("s"))).head()[0] == 2.0


def test_histogram_order(spark):
    bins = lambda *x: spark.createDataFrame([("k", b, n, 0) for b, n in x], "k string, bin bigint, n bigint, zeros bigint")
    sign = lambda a, b: H.compare(a, b, ["k"]).head().sign
    a = bins((0, 2), (3, 5))
    assert [sign(a, a), sign(a, bins((0, 2))), sign(bins((9, 9)), a), sign(a, bins((0, 2), (4, 5))), sign(a, bins((0, 1), (3, 5))), sign(bins((-1, 9), (3, 5)), a)] == [0, 1, -1, -1, 1, -1]


def test_softmax_axes(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [1.0, 4.0]]), (2, [[1.0, 2.0]]), (3, [])], "id int, x array<array<double>>")
    get = lambda axis: {r.id: r.p for r in df.select("id", softmax.softmax_matrix(F.col("x"), 1.0, axis).alias("p")).collect()}
    a, b, c = 0.2689414214, 0.1192029220, 0.0474258732
    assert get(0)[1] == [pytest.approx([0.5, b]), pytest.approx([0.5, 1 - b])] and get(1)[1] == [pytest.approx([a, 1 - a]), pytest.approx([c, 1 - c])]
    assert get(None)[1] == get(0)[1] and get(None)[2] == [pytest.approx([a, 1 - a])] and get(None)[3] == []
