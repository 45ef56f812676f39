import random

import numpy as np
from conftest import rows

from tundra.operators import spatial as S

RING = "poly_id bigint, sId string, polygon array<struct<x:double,y:double>>, innerRings array<array<struct<x:double,y:double>>>, leaf bigint, id string"


def square(x, y, s):
    x, y = float(x), float(y)
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def inside(x, y, ring):
    w = 0
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        inc = 1
        if ay > by:
            ax, ay, bx, by, inc = bx, by, ax, ay, -1
        if ay <= y < by and (bx - ax) * (y - ay) - (x - ax) * (by - ay) > 0:
            w += inc
    return w != 0


def test_points_in_regions(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 50)  # many leaves and salts on few rows
    r = random.Random(4)
    polys = []
    for i in range(60):
        x, y, s = r.uniform(-3, 3), r.uniform(-3, 3), r.uniform(0.1, 1.5)
        ring = square(x, y, s)
        holes = [square(x + s / 4, y + s / 4, s / 3)] if i % 3 == 0 else ([] if i % 3 == 1 else None)
        polys.append((i, f"t{i % 40}", ring[: -1 if i % 2 else None][:: -1 if i % 5 == 0 else 1], holes, 1, "z"))
    pts = [(i, r.uniform(-3, 4), r.uniform(-3, 4)) for i in range(500)] + [(500 + i, 0.25, 0.25) for i in range(300)]
    pts += [(900, None, 1.0), (901, 181.0, 0.0), (902, float("nan"), 0.0), (903, 0.0, -91.0), (None, 0.0, 0.0)]
    want = {
        (str(i), sid) for i, x, y in pts if i is not None and x is not None and x == x and abs(x) <= 180 and abs(y) <= 90
        for _, sid, ring, holes, *_ in polys if inside(x, y, ring) and not any(inside(x, y, h) for h in holes or [])
    }
    junk = [(98, "bad", None, None, 1, "z"), (99, "bad", [(0.0, 0.0), (1.0, 1.0)], [], 1, "z"), (97, None, square(0, 0, 1), [], 1, "z"), (96, "t0", [(None, 1.0), (2.0, None), (0.0, 0.0)], None, 1, "z")]
    p = spark.createDataFrame(pts, "point_id bigint, lon double, lat double")
    q = spark.createDataFrame(polys + polys[:9] + junk, RING)
    got = [tuple(x) for x in S.points_in_regions(p, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert S.points_in_regions(p.limit(0), q).count() == 0 and S.points_in_regions(p, q.limit(0)).count() == 0


def test_borders(spark):
    p = spark.createDataFrame([("a", 0.2, 0.5), ("b", 0.0, 0.5), ("c", 0.5, 0.0), ("d", 1.0, 0.5), ("e", 0.5, 1.0)], "point_id string, lon double, lat double")
    q = spark.createDataFrame([(1, "s", square(0.0, 0.0, 1.0), None, 1, "")], RING)
    assert rows(S.points_in_regions(p, q)) == [("a", "s"), ("b", "s"), ("c", "s")]


def test_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 40)
    r = random.Random(8)
    pts = [(f"k{i}", r.uniform(-0.2, 0.2) + 10, r.uniform(-0.2, 0.2) + 50) for i in range(250)]
    pts += [(f"w{i}", r.choice([179.99, -179.99]) + r.uniform(-0.005, 0.005), r.uniform(60, 60.05)) for i in range(40)]
    pts += [(f"p{i}", r.uniform(-180, 180), 89.995) for i in range(15)] + [(f"s{i}", 3.0, 3.0) for i in range(60)]
    pts += [("k1", None, 3.0), (None, 1.0, 1.0), ("k2", 200.0, 1.0)]
    ok = [(k, x, y) for k, x, y in pts if k and x is not None and abs(x) <= 180]
    x, y = np.array([p[1] for p in ok]), np.array([p[2] for p in ok])
    want = {(ok[i][0], ok[j][0]) for i in range(len(ok)) for j in np.flatnonzero(S.haversine_km(x[i], y[i], x, y) <= 2.0) if ok[i][0] < ok[j][0]}
    df = spark.createDataFrame(pts + pts[:30], "key string, lon double, lat double")
    got = [tuple(v) for v in S.near_pairs(df, "key", "lon", "lat", 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert S.near_pairs(df.limit(0), "key", "lon", "lat", 2.0).count() == 0
