"""Points near other points or regions, for sets far larger than one machine.

Method: a bounded random sample of the objects shapes a quadtree whose leaves hold about equally much; objects go to
the leaves they touch (regions and search circles are replicated over leaf borders); in each leaf an R-tree is bulk
loaded (sort-tile-recursive) and probed, then the exact geometric test decides. A pair that meets in several leaves is
reported only by the leaf that holds its reference point. Leaves that can't be split further, as when a third of
all objects share one place, become a square of tasks: one side is dealt to its rows and the other to its columns, so
that each task holds a bounded part of either side and each pair meets in one task.

Only the leaf list reaches the driver and is broadcast; its size is bounded by ``MAX_LEAVES``.

Defined results
    points with a null or NaN coordinate, |lon| > 180 or |lat| > 90 are skipped; regions without a ring of 3 corners hold
    nothing; null corners are dropped; stated extents are not used (they may be wrong), boxes come from the rings;
    rings close on their first point; repeated rows give each pair once; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.runtime import shuffle_partitions

#: Bounds of the plan, not of the result: objects sampled to shape the tree, leaves at most, depth, rows aimed at in a task.
SAMPLE_ROWS = 200_000
MAX_LEAVES = 65_536
MAX_DEPTH = 24
TASK_ROWS = 40_000
EARTH_KM = 6371.0088


WORLD = (-180.0, -90.0, 360.0, 180.0)
_HALF, _QUARTER = 1 << 32, 1 << 16


class QuadTree:
    """Leaves of a quadtree over a box, as ranges of Morton codes at ``MAX_DEPTH``, with the parts that each side is dealt to.

    ``side`` tells which of the sampled objects are of the second side; ``total`` counts the objects of both.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, total: int, side: np.ndarray | None = None, box: tuple[float, float, float, float] = WORLD) -> None:
        self.box = box
        code = self.codes(x, y)
        second = np.sort(code[side]) if side is not None else None
        first = np.sort(code[~side]) if side is not None else np.sort(code)
        code = np.sort(code)
        want = max(1, min(MAX_LEAVES // 4, math.ceil(total / TASK_ROWS) * 4))
        limit = max(1.0, len(code) / want)
        starts: list[tuple[int, int]] = []  # start, depth
        todo = [(0, 0)]
        while todo:
            start, depth = todo.pop()
            end = start + (1 << 2 * (MAX_DEPTH - depth))
            held = int(np.searchsorted(code, end) - np.searchsorted(code, start))
            if held <= limit or depth == MAX_DEPTH or len(starts) + len(todo) + 4 > MAX_LEAVES:
                starts.append((start, depth))
            else:
                step = 1 << 2 * (MAX_DEPTH - depth - 1)
                todo += [(start + k * step, depth + 1) for k in range(4)]
        starts.sort()
        self.start = np.array([s[0] for s in starts], dtype=np.int64)
        depth = np.array([s[1] for s in starts], dtype=np.int64)
        end = self.start + (1 << 2 * (MAX_DEPTH - depth))

        def parts(codes: np.ndarray) -> np.ndarray:
            share = (np.searchsorted(codes, end) - np.searchsorted(codes, self.start)) / max(1, len(code))
            return np.clip(np.ceil(share * total / TASK_ROWS), 1, _QUARTER - 1).astype(np.int64)

        #: in how many parts the objects of each side are dealt, for each leaf
        self.rows = parts(first)
        self.columns = self.rows if second is None else parts(second)
        cx, cy = _unspread(self.start), _unspread(self.start >> 1)
        cell = 2.0 ** (MAX_DEPTH - depth)
        n = 2.0**MAX_DEPTH
        bx, by, w, h = self.box
        self.x0, self.y0 = bx + cx / n * w, by + cy / n * h
        self.x1, self.y1 = bx + (cx + cell) / n * w, by + (cy + cell) / n * h

    def deal(self, leaf: np.ndarray, salt: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray]:
        """(object, task) of objects in leaves: an object of the first side goes to its row of tasks, of the second to its column."""
        mine, other = (self.columns, self.rows) if second else (self.rows, self.columns)
        own, copies = salt % mine[leaf], other[leaf]
        o = np.repeat(np.arange(len(leaf)), copies)
        k = _within(copies)
        i, j = (k, own[o]) if second else (own[o], k)
        return o, leaf[o] * _HALF + i * _QUARTER + j

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bx, by, w, h = self.box
        n = 1 << MAX_DEPTH
        cx = np.clip(np.floor((np.clip(x, bx, bx + w) - bx) / w * n), 0, n - 1).astype(np.int64)
        cy = np.clip(np.floor((np.clip(y, by, by + h) - by) / h * n), 0, n - 1).astype(np.int64)
        return _spread(cx) | (_spread(cy) << 1)

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, self.codes(x, y), side="right") - 1

    def touched(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(object, leaf) of every leaf that an object's box touches."""
        first, last = self.leaf(x0, y0), self.leaf(x1, y1)
        same = np.flatnonzero(first == last)
        objects, leaves = [same], [first[same]]
        for i in np.flatnonzero(first != last):
            # leaves between the corners' codes that meet the box
            k = np.arange(first[i], last[i] + 1)
            k = k[(self.x0[k] <= x1[i]) & (self.x1[k] >= x0[i]) & (self.y0[k] <= y1[i]) & (self.y1[k] >= y0[i])]
            objects.append(np.full(len(k), i))
            leaves.append(k)
        return np.concatenate(objects), np.concatenate(leaves)


def _spread(v: np.ndarray) -> np.ndarray:
    v = v & 0xFFFFFF
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << shift)) & mask
    return v


def _unspread(v: np.ndarray) -> np.ndarray:
    v = v & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & mask
    return v.astype(np.float64)


class RTree:
    """Boxes packed by sort-tile-recursive; probed for many points at once."""

    FAN = 16

    def __init__(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> None:
        n = len(x0)
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        slices = max(1, math.ceil(math.sqrt(math.ceil(n / self.FAN))))
        by_x = np.argsort(cx, kind="stable")
        strip = np.empty(n, dtype=np.int64)
        strip[by_x] = np.arange(n) // max(1, math.ceil(n / slices))
        self.order = np.lexsort((cy, strip))
        level = [a[self.order] for a in (x0, y0, x1, y1)]
        self.levels = [level]
        while len(level[0]) > self.FAN:
            cut = np.arange(0, len(level[0]), self.FAN)
            level = [np.minimum.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut)]
            self.levels.append(level)

    def probe(self, qx0: np.ndarray, qy0: np.ndarray, qx1: np.ndarray, qy1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, box) pairs whose boxes overlap, in blocks of queries."""
        for at in range(0, len(qx0), 8192):
            q = np.arange(at, min(at + 8192, len(qx0)))
            node = np.arange(len(self.levels[-1][0]))
            q, node = np.repeat(q, len(node)), np.tile(node, len(q))
            for k in range(len(self.levels) - 1, -1, -1):
                x0, y0, x1, y1 = self.levels[k]
                hit = (x0[node] <= qx1[q]) & (x1[node] >= qx0[q]) & (y0[node] <= qy1[q]) & (y1[node] >= qy0[q])
                q, node = q[hit], node[hit]
                if k:
                    width = np.minimum(self.FAN, len(self.levels[k - 1][0]) - node * self.FAN)
                    q, node = np.repeat(q, width), np.repeat(node * self.FAN, width) + _within(width)
            yield q, self.order[node]


def _within(width: np.ndarray) -> np.ndarray:
    """0..w-1 for each w."""
    ends = np.cumsum(width)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)


def winding_inside(px: np.ndarray, py: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Winding number not 0. An edge, its lower end first, counts +1 or -1 where y0 <= y < y1 and the point is strictly to its left."""
    nx, ny = np.roll(rx, -1), np.roll(ry, -1)
    up = ny > ry
    x0, y0, x1, y1 = np.where(up, rx, nx), np.where(up, ry, ny), np.where(up, nx, rx), np.where(up, ny, ry)
    inc = np.where(up, 1, -1)
    out = np.zeros(len(px), dtype=bool)
    for at in range(0, len(px), 4096):
        x, y = px[at : at + 4096, None], py[at : at + 4096, None]
        counts = (y0 <= y) & (y < y1) & ((x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) > 0)
        out[at : at + 4096] = (counts * inc).sum(axis=1) != 0
    return out


def _tree(objects: DataFrame, box: tuple[float, float, float, float] = WORLD, total: int | None = None) -> QuadTree:
    """The quadtree of a bounded sample; ``objects`` (cx, cy, second) has one row for each object to be placed."""
    total = objects.count() if total is None else total
    if not total:
        return QuadTree(np.empty(0), np.empty(0), 0, np.empty(0, dtype=bool), box)
    rate = min(1.0, SAMPLE_ROWS / total)
    got = objects.select("cx", "cy", "second").sample(rate, 17).limit(2 * SAMPLE_ROWS).toPandas()  # bounded; shapes the plan, never the result
    return QuadTree(got["cx"].to_numpy(float), got["cy"].to_numpy(float), total, got["second"].to_numpy(bool), box)


def _salt(ids: pd.Series) -> np.ndarray:
    return pd.util.hash_array(ids.to_numpy(dtype=object)).astype(np.int64) & 0x7FFFFFFF


def _valid_points(points: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    p = points.select(F.col(key).cast("string").alias("id"), F.col(lon).cast("double").alias("cx"), F.col(lat).cast("double").alias("cy"))
    return p.filter("id IS NOT NULL AND cx BETWEEN -180 AND 180 AND cy BETWEEN -90 AND 90")


def points_in_regions(points: DataFrame, regions: DataFrame, point_key: str = "point_id", region_key: str = "sId", holes: str = "excluded") -> DataFrame:
    """(key_a, key_b): each point with the regions that have a polygon which holds it and none of whose holes does.

    ``holes`` 'ignored': whatever lies in the outer ring counts; 'fallback': where a point lies in no region otherwise, the regions
    in whose holes it lies.
    """
    spark = points.sparkSession
    p = _valid_points(points, point_key, "lon", "lat")
    corners = regions.select(F.expr("try_element_at(polygon, 1)").alias("c")).select(F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.lit(True).alias("second")).filter("cx BETWEEN -180 AND 180 AND cy BETWEEN -90 AND 90")
    tree = _tree(p.select("cx", "cy", F.lit(False).alias("second")).unionByName(corners))  # dense regions split leaves too
    tree_b = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves

    def deal_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tree_b.value
        for pdf in batches:
            o, task = t.deal(t.leaf(pdf["cx"].to_numpy(), pdf["cy"].to_numpy()), _salt(pdf["id"]), False)
            yield pdf.iloc[o].assign(task=task)

    # boxes come from the rings; built-in functions keep this in the JVM. Repeated polygons give the same pairs, which are made distinct
    ring = regions.select(
        F.col(region_key).cast("string").alias("id"),
        F.expr("filter(polygon, p -> p.x IS NOT NULL AND p.y IS NOT NULL)").alias("ring"),
        F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes") if holes == "ignored"
        else F.expr("transform(filter(coalesce(innerRings, array()), r -> r IS NOT NULL), r -> filter(r, p -> p.x IS NOT NULL AND p.y IS NOT NULL))").alias("holes"),
    ).filter("id IS NOT NULL AND size(ring) >= 3")
    flat = ring.selectExpr(
        "id", "xxhash64(id, ring) AS salt", "transform(ring, p -> p.x) AS xs", "transform(ring, p -> p.y) AS ys",
        "transform(holes, r -> transform(r, p -> p.x)) AS hxs", "transform(holes, r -> transform(r, p -> p.y)) AS hys",
        "array_min(transform(ring, p -> p.x)) AS x0", "array_min(transform(ring, p -> p.y)) AS y0", "array_max(transform(ring, p -> p.x)) AS x1", "array_max(transform(ring, p -> p.y)) AS y1",
    )

    tasks = F.pandas_udf(_touching(tree_b, True), "array<bigint>")
    placed = flat.withColumn("task", F.explode(tasks("x0", "y0", "x1", "y1", "salt"))).select("task", "id", "xs", "ys", "hxs", "hys")
    dealt = p.mapInPandas(deal_points, "id string, cx double, cy double, task bigint")
    excluded = holes == "excluded"

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"key_a": pa.array([], pa.string()), "key_b": pa.array([], pa.string()), "clear": pa.array([], pa.bool_())})
        if not len(left) or not len(right):
            return empty
        px, py = left["cx"].to_numpy(), left["cy"].to_numpy()
        xs, ys = _rows(right["xs"]), _rows(right["ys"])
        tree = RTree(*(np.array([f(a) for a in v]) for f, v in ((np.min, xs), (np.min, ys), (np.max, xs), (np.max, ys))))
        hxs, hys = right["hxs"], right["hys"]
        got_p, got_r, got_c = [], [], []
        for q, box in tree.probe(px, py, px, py):
            by = np.argsort(box, kind="stable")
            q, box = q[by], box[by]
            cut = np.flatnonzero(np.diff(box, prepend=-1))
            for s, e in zip(cut, [*cut[1:], len(box)]):
                b, mine = box[s], q[s:e]
                mine = mine[winding_inside(px[mine], py[mine], xs[b], ys[b])]
                clear = np.ones(len(mine), dtype=bool)
                if len(mine):
                    for hx, hy in zip(hxs[int(b)].as_py() or [], hys[int(b)].as_py() or []):
                        if len(hx) >= 3:
                            clear &= ~winding_inside(px[mine], py[mine], np.array(hx), np.array(hy))
                if excluded:
                    mine, clear = mine[clear], clear[clear]
                got_p.append(mine)
                got_r.append(np.full(len(mine), b))
                got_c.append(clear)
        if not got_p:
            return empty
        a = left["id"].take(pa.array(np.concatenate(got_p)))
        b = right["id"].take(pa.array(np.concatenate(got_r)))
        return pa.table({"key_a": a, "key_b": b, "clear": pa.array(np.concatenate(got_c))}).group_by(["key_a", "key_b", "clear"]).aggregate([])

    n = max(shuffle_partitions(spark), 1)
    hit = dealt.repartition(n, "task").groupBy("task").cogroup(placed.repartition(n, "task").groupBy("task")).applyInArrow(probe, "key_a string, key_b string, clear boolean")
    if holes != "fallback":
        return hit.select("key_a", "key_b").distinct()
    each = hit.groupBy("key_a", "key_b").agg(F.max("clear").alias("clear"))
    return each.withColumn("any", F.max("clear").over(Window.partitionBy("key_a"))).filter("clear OR NOT any").select("key_a", "key_b")


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column of double lists as numpy slices."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
    return out


def _touching(tree_b, second: bool):
    def touching(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, salt: pd.Series) -> pd.Series:
        """Tasks of the leaves that each box touches."""
        t = tree_b.value
        o, leaf = t.touched(x0.to_numpy(), y0.to_numpy(), x1.to_numpy(), y1.to_numpy())
        k, task = t.deal(leaf, salt.to_numpy()[o] & 0x7FFFFFFF, second)
        o = o[k]
        by = np.argsort(o, kind="stable")
        return pd.Series(np.split(task[by], np.searchsorted(o[by], np.arange(1, len(x0)))))

    return touching


def overlapping(queries: DataFrame, boxes: DataFrame) -> DataFrame:
    """(q, b) of closed boxes (id, x0, y0, x1, y1) that meet; every pair once for each pair of rows.

    A pair that meets in several leaves is reported by the leaf of its overlap's low corner.
    """
    spark = queries.sparkSession
    both = queries.select("x0", "y0", "x1", "y1", F.lit(False).alias("second")).unionByName(boxes.select("x0", "y0", "x1", "y1", F.lit(True).alias("second")))
    finite = lambda c: F.when(F.abs(c) < 1e300, F.col(c))
    low = both.agg(F.min(finite("x0")), F.min(finite("y0")), F.max(finite("x1")), F.max(finite("y1")), F.count(F.lit(1))).head()
    if any(v is None for v in low):
        low = (-1.0, -1.0, 1.0, 1.0, low[4])
    box = (low[0], low[1], max(low[2] - low[0], 1e-9), max(low[3] - low[1], 1e-9))
    tree = _tree(both.select(F.col("x0").alias("cx"), F.col("y0").alias("cy"), "second"), box, low[4])
    tree_b = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves

    def place(df: DataFrame, second: bool) -> DataFrame:
        tasks = F.pandas_udf(_touching(tree_b, second), "array<bigint>")
        salted = df.select("id", "x0", "y0", "x1", "y1", F.xxhash64("id").alias("salt"))
        return salted.withColumn("task", F.explode(tasks("x0", "y0", "x1", "y1", "salt"))).drop("salt")

    a_type, b_type = dict(queries.dtypes)["id"], dict(boxes.dtypes)["id"]

    def probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = ([t[c].to_numpy() for c in ("x0", "y0", "x1", "y1")] for t in (left, right))
        got_a, got_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if len(left) and len(right):
            t, leaf = tree_b.value, key[0].as_py() // _HALF
            for q, k in RTree(*b).probe(*a):
                some = t.leaf(np.maximum(a[0][q], b[0][k]), np.maximum(a[1][q], b[1][k])) == leaf
                got_a.append(q[some])
                got_b.append(k[some])
        return pa.table({"q": left["id"].take(pa.array(np.concatenate(got_a))), "b": right["id"].take(pa.array(np.concatenate(got_b)))})

    n = max(shuffle_partitions(spark), 1)
    return place(queries, False).repartition(n, "task").groupBy("task").cogroup(place(boxes, True).repartition(n, "task").groupBy("task")).applyInArrow(probe, f"q {a_type}, b {b_type}")


def haversine_km(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.radians(v) for v in (x0, y0, x1, y1))
    h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def near_pairs(points: DataFrame, key: str, lon: str, lat: str, km: float) -> DataFrame:
    """(key_a, key_b), key_a < key_b: different keys with places at most ``km`` apart on the sphere, across the date line too.

    Each place is home in one leaf and is copied to the leaves that its search box touches; a pair is reported by
    the home leaf of its smaller place, so none comes twice from replication.
    """
    spark = points.sparkSession
    p = _valid_points(points, key, lon, lat).distinct()
    tree = _tree(p.withColumn("second", F.lit(False)))
    tree.columns = tree.rows  # as many visitors as homes
    tree_b = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves
    reach = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-12

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Homes and visiting copies, dealt to rows and columns of their leaf's tasks. Visitors that reach over the date line come shifted."""
        t = tree_b.value
        for pdf in batches:
            x, y = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
            ids, salt = pdf["id"].to_numpy(dtype=object), _salt(pdf["id"])
            o, task = t.deal(t.leaf(x, y), salt, False)
            yield pd.DataFrame({"task": task, "visitor": False, "id": ids[o], "cx": x[o], "cy": y[o]})
            # the widest difference of longitude within reach; near a pole all of it
            top = np.radians(np.minimum(np.abs(y) + reach, 90))
            ratio = np.sin(math.radians(reach)) / np.maximum(np.cos(np.radians(y)), 1e-300)
            dx = np.where((top >= math.pi / 2) | (ratio >= 1), 360.0, np.degrees(np.arcsin(np.minimum(ratio, 1)))) * (1 + 1e-9) + 1e-12
            for shift in (0.0, 360.0, -360.0):
                sx = x + shift
                some = np.flatnonzero((sx + dx >= -180) & (sx - dx <= 180))
                if len(some):
                    o, leaf = t.touched(np.maximum(sx - dx, -180)[some], np.maximum(y - reach, -90)[some], np.minimum(sx + dx, 180)[some], np.minimum(y + reach, 90)[some])
                    k, task = t.deal(leaf, salt[some[o]], True)
                    o = some[o][k]
                    yield pd.DataFrame({"task": task, "visitor": True, "id": ids[o], "cx": sx[o], "cy": y[o]})

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        home, other = pdf[~pdf["visitor"]], pdf[pdf["visitor"]]
        empty = pd.DataFrame({"key_a": pd.Series(dtype=object), "key_b": pd.Series(dtype=object)})
        if home.empty or other.empty:
            return empty
        hx, hy, ox, oy = home["cx"].to_numpy(), home["cy"].to_numpy(), other["cx"].to_numpy(), other["cy"].to_numpy()
        hid, oid = home["id"].to_numpy(dtype=object), other["id"].to_numpy(dtype=object)
        tree = RTree(ox, oy, ox, oy)
        top = np.radians(np.minimum(np.abs(hy) + reach, 90))
        ratio = np.sin(math.radians(reach)) / np.maximum(np.cos(np.radians(hy)), 1e-300)
        dx = np.where((top >= math.pi / 2) | (ratio >= 1), 720.0, np.degrees(np.arcsin(np.minimum(ratio, 1)))) * (1 + 1e-9) + 1e-12
        out = []
        for q, box in tree.probe(hx - dx, hy - reach, hx + dx, hy + reach):
            some = hid[q] < oid[box]  # the reference place is the smaller key's
            q, box = q[some], box[some]
            some = haversine_km(hx[q], hy[q], ox[box], oy[box]) <= km
            out.append(pd.DataFrame({"key_a": hid[q[some]], "key_b": oid[box[some]]}))
        return pd.concat(out).drop_duplicates()

    dealt = p.mapInPandas(deal, "task bigint, visitor boolean, id string, cx double, cy double")
    return dealt.groupBy("task").applyInPandas(probe, "key_a string, key_b string").distinct()
