from conftest import rows

from tundra import queries as Q
from tundra.operators import hierarchy


def test_every_nation_is_asked(spark, tmp_path):
    """Each nation against the region of the next; in its own region only where both share it."""
    spark.createDataFrame([(i, f"r{i}") for i in range(9)], "r_regionkey bigint, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"n{i}", i // 3) for i in range(25)], "n_nationkey bigint, n_name string, n_regionkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r.node: (r.ancestor, r.is_instance) for r in Q.QUERIES["hierarchy_is_instance"](spark, str(tmp_path)).collect()}
    assert got == {f"n{i}": (f"r{(i + 1) % 25 // 3}", (i + 1) % 25 // 3 == i // 3) for i in range(25)}


def test_closure_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 3), (None, 1), (5, None)]
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    nodes = {n for c, p in links if c is not None and p is not None for n in (c, p)}
    want = []
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        want += [(n, a) for a in seen]
    df = spark.createDataFrame(links + links[:5], "c bigint, p bigint")
    assert rows(hierarchy.closure(df, "c", "p")) == sorted(want, key=repr)
    assert hierarchy.closure(df.limit(0), "c", "p").count() == 0
