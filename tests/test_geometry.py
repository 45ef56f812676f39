import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tundra.functions import bitset, mercator, polygon, records
from tundra.operators import boxes, hierarchy, spatial, tracts

BOXES = [(1, 5, 7, 9), (6, 9, 3, 6), (3, 6, 4, 7), (8, 9, 5, 6), (4, 7, 3, 8), (2, 8, 5, 7), (1, 3, 2, 4), (3, 7, 2, 4), (6, 8, 1, 5), (4, 8, 8, 9), (1, 9, 1, 9)]


def box_frame(spark, data):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(data)], "id int, x_min double, x_max double, y_min double, y_max double")


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


@pytest.mark.parametrize("task_rows", [2, 40_000])
def test_box_queries(spark, monkeypatch, task_rows):
    monkeypatch.setattr(spatial, "TASK_ROWS", task_rows)
    b = box_frame(spark, BOXES)
    p = spark.createDataFrame([(1, 2.0, 4.0), (2, 1.0, 3.0), (3, 4.0, 7.0), (4, None, 1.0), (5, 50.0, 50.0)], "pid int, x double, y double")
    got = boxes.stab_join(p, b, "pid", "id")
    by = {k: {BOXES[i] for q, i in rows(got) if q == k} for k in (1, 2, 3, 4, 5)}
    assert by[1] == by[2] == {(1, 3, 2, 4), (1, 9, 1, 9)} and by[4] == by[5] == set()
    assert by[3] == {(1, 5, 7, 9), (3, 6, 4, 7), (4, 7, 3, 8), (2, 8, 5, 7), (1, 9, 1, 9)}
    q = spark.createDataFrame([(1, 2.0, 4.0, 5.0, 8.0), (2, 20.0, 21.0, 1.0, 2.0)], "q int, x_min double, x_max double, y_min double, y_max double")
    assert {BOXES[i] for _, i in rows(boxes.overlap_join(q, b, "q", "id"))} == {(1, 5, 7, 9), (3, 6, 4, 7), (4, 7, 3, 8), (2, 8, 5, 7), (4, 8, 8, 9), (1, 9, 1, 9)}
    assert rows(boxes.overlap_exists(q, b, "q", "id")) == [(1, True), (2, False)]


def test_grid_join_is_the_nested_loop(spark):
    r = random.Random(6)

    def some(n, big):
        return [(x := r.uniform(-20, 20), x + r.choice([0, r.random(), big * r.random()]), y := r.uniform(-20, 20), y + r.choice([0, r.random(), big * r.random()])) for _ in range(n)]

    a, b = some(200, 3), some(150, 60)
    got = boxes.overlap_join(box_frame(spark, a).withColumnRenamed("id", "q"), box_frame(spark, b), "q", "id").collect()
    want = {(i, j) for i, p in enumerate(a) for j, o in enumerate(b) if p[0] <= o[1] and p[1] >= o[0] and p[2] <= o[3] and p[3] >= o[2]}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_rings(spark):
    sq = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    one = spark.range(1)
    c = one.select(polygon.centroid_area(sq).alias("c"), polygon.signed_area(sq).alias("s"), polygon.area(F.reverse(sq)).alias("a"), polygon.extent(sq).alias("e")).head()
    assert tuple(c.c) == (0.5, 0.5, 1.0) and c.s == 1.0 and c.a == 1.0 and tuple(c.e) == (0.0, 0.0, 1.0, 1.0)
    for (x, y), want in {(0.2, 0.5): True, (0, 0.5): True, (0.5, 0): True, (1, 0.5): False, (0.5, 1): False}.items():
        assert one.select(polygon.in_polygon(sq, F.lit(float(x)), F.lit(float(y))).alias("i")).head().i is want
    big = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    for r, want in {(2, 2, 3, 3): "I", (-1, -1, 5, 5): "S", (20, 20, 21, 21): "O", (-1, -1, 11, 11): "O"}.items():
        assert one.select(polygon.rect_in_polygon(big, *[F.lit(float(v)) for v in r]).alias("p")).head().p == want
    m = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, 2.0, -4.0)], "x double, y double, a double").agg(polygon.multi_centroid_area(F.col("x"), F.col("y"), F.col("a")).alias("m")).head().m
    assert tuple(m) == (0.0, 0.0, 0.0)
    z = one.select(polygon.centroid_area(ring((0, 0), (1, 1), (0, 0))).alias("c")).head().c
    assert z.x is None and z.area == 0.0
    assert one.select(F.size(polygon.closed(ring((0, 0), (1, 0), (1, 1)))).alias("n")).head().n == 4


def test_tracts_with_holes(spark):
    sq = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    data = [("a", sq(0.0, 0.0, 4.0), [sq(1.0, 1.0, 2.0)]), ("b", sq(10.0, 0.0, 2.0), [sq(10.0, 0.0, 2.0)]), ("a", sq(6.0, 0.0, 1.0), None)]
    polys = tracts.polygons(spark.createDataFrame(data, "sId string, polygon array<struct<x:double,y:double>>, innerRings array<array<struct<x:double,y:double>>>"))
    got = {r.sId: r for r in tracts.roll_up(polys).collect()}
    assert got["a"].centroid.area == pytest.approx(13.0) and got["a"].centroid.x == pytest.approx((12 * 2 + 6.5) / 13) and tuple(got["a"].extent) == (0.0, 0.0, 7.0, 4.0)
    assert got["b"].centroid.area == pytest.approx(4.0)  # all water: the outer ring
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 50.0, 50.0), (4, None, 1.0)], "point_id int, lon double, lat double")
    assert rows(tracts.find_tracts(pts, polys)) == [(1, "a")]
    assert rows(tracts.find_tracts(pts, polys, ignore_holes=True)) == [(1, "a"), (2, "a")]
    assert rows(tracts.find_tracts(pts, polys, allow_in_holes=True)) == [(1, "a"), (2, "a")]
    assert spark.range(1).select(F.size(tracts.state_codes()).alias("n")).head().n == 52


def test_mercator(spark):
    g = mercator.Grid.over((0.0, -60.0, 10.0, 60.0), (10.2, 9.8))
    assert (g.res_x, g.res_y) == (10, 10)
    px = lambda lon: spark.range(1).select(g.which_pixel(F.lit(lon), F.lit(0.0)).alias("p")).head().p.px
    assert [px(-1.0), px(-0.5), px(0.0), px(2.9)] == [-2, -1, 0, 2]
    r = spark.range(1).select(g.pixel_to_deg(F.lit(3), F.lit(4)).alias("a"), g.pixel_to_deg_table(F.lit(3), F.lit(4)).alias("b"), mercator.y_to_rad(mercator.rad_to_y(F.lit(0.3))).alias("c")).head()
    assert tuple(r.a) == pytest.approx(tuple(r.b)) and r.c == pytest.approx(0.3) and math.isclose(r.a.lon, 3.0)


def test_bits(spark):
    n = 130
    df = spark.createDataFrame([([0, 2, 64, 129], [1, 2, 129])], "a array<int>, b array<int>").select(bitset.from_positions(F.col("a"), n).alias("a"), bitset.from_positions(F.col("b"), n).alias("b"))
    text = lambda c: df.select(bitset.to_bits(c, n).alias("t")).head().t
    on = lambda t: [i for i, c in enumerate(t) if c == "1"]
    a, b = F.col("a"), F.col("b")
    assert on(text(a)) == [0, 2, 64, 129]
    assert [on(text(bitset.bitwise(a, b, o))) for o in ("and", "or", "xor")] == [[2, 129], [0, 1, 2, 64, 129], [0, 1, 64]]
    assert on(text(bitset.put(a, F.lit(63), F.lit(1), n))) == [0, 2, 63, 64, 129] and on(text(bitset.put_bits(a, 64, "0b01", n))) == [0, 2, 65, 129]
    assert spark.range(1).select(bitset.insert(F.lit("1010"), 1, F.lit("11")).alias("t")).head().t == "111010"
    for i in (-1, n):
        with pytest.raises(Exception, match="range"):
            df.select(bitset.test(a, F.lit(i), n)).collect()
    with pytest.raises(Exception, match="size"):
        df.select(bitset.bitwise(a, bitset.empty(10), "and")).collect()
    with pytest.raises(IndexError):
        bitset.put_bits(a, n - 1, "11", n)


def test_records_and_closure(spark):
    e = records.Enum("HOME", "HOSP")
    rec = records.record(careTier=F.lit(1), thing=F.lit("first"), age=F.lit(7))
    assert spark.range(1).select(records.record_text("PatientStatus", rec, {"careTier": e, "thing": "string", "age": "int"}).alias("t")).head().t == "PatientStatus(careTier=HOSP, thing='first', age=7)"
    links = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (None, 1), (7, 8), (8, 7)], "c int, p int")
    got = rows(hierarchy.closure(links, "c", "p"))
    assert {a for n, a in got if n == 4} == {4, 2, 1} and (3, 2) not in got and {a for n, a in got if n == 7} == {7, 8}
    assert hierarchy.closure(links.limit(0), "c", "p").count() == 0
