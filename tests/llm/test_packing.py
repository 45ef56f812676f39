import random

import numpy as np
import pytest

from tundra.llm import packing as P


def check(spark, sizes, caps):
    """Texts of known sizes through the operator; returns {cap: (containers, tokens)}."""
    docs = spark.createDataFrame([(i, "a " * n if n else "", 0) for i, n in enumerate(sizes)], "doc_id bigint, text string, piece int")
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    capacities = spark.createDataFrame([(i + 1, "c", c) for i, c in enumerate(caps)], "cap_id bigint, cap_name string, max_tokens int")
    got = P.pack(docs, capacities).collect()
    out = {}
    for i, c in enumerate(caps, 1):
        mine = [r for r in got if r.cap_id == i]
        held, texts = {}, {}
        for r in mine:
            held.setdefault(r.container_id, []).append(r)
            texts.setdefault(r.doc_id, []).append(r)
        for rs in held.values():
            rs.sort(key=lambda r: r.position)
            assert sum(r.n_tokens for r in rs) <= c and [r.position for r in rs] == list(range(len(rs)))
            assert [r.start for r in rs] == [sum(x.n_tokens for x in rs[:k]) for k in range(len(rs))]
        assert set(texts) == set(counts)
        for d, rs in texts.items():
            rs.sort(key=lambda r: r.piece)
            assert sum(r.n_tokens for r in rs) == counts[d] and [r.piece for r in rs] == list(range(len(rs)))
            assert len(rs) == -(-counts[d] // c)
        out[c] = (len(held), sum(r.n_tokens for r in mine))
    return out


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 300)
    r = random.Random(7)
    sizes = [r.choice([0, 1, 7, 60, 61, 100, 100, 100, 180, r.randrange(1, 255), r.randrange(1, 900)]) for _ in range(3000)] + [129] * 500
    for c, (n, tokens) in check(spark, sizes, [256, 1000]).items():
        # texts of just over half a container take one each
        assert n <= 1.02 * max(tokens / c, 0) + 500


def test_small_and_empty(spark):
    assert check(spark, [], [256]) == {256: (0, 0)}
    assert check(spark, [0, 0], [256]) == {256: (0, 0)}
    assert check(spark, [5], [1, 3])[1][0] >= 5
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id bigint, text string, x int")
    assert P.pack(docs, spark.createDataFrame([(1, None), (None, 5), (2, 0)], "cap_id bigint, max_tokens int")).count() == 0
    assert P.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id bigint, text string"), spark.createDataFrame([(1, 9)], "cap_id bigint, max_tokens int")).count() == 2


def test_many_capacities(spark):
    docs = spark.createDataFrame([(1, "a " * 3), (2, "a")], "doc_id bigint, text string")
    caps = spark.createDataFrame([(i, 2 + i % 3) for i in range(1100)], "cap_id bigint, max_tokens int")
    got = P.pack(docs, caps).groupBy("cap_id").sum("n_tokens").collect()
    assert sorted(r[0] for r in got) == list(range(1100)) and len({r[1] for r in got}) == 1


@pytest.mark.parametrize("size,count,cap,best", [([6, 4], [10, 10], 10, 10), ([5, 5], [4, 4], 10, 4), ([7, 5, 3], [4, 6, 4], 10, 7), ([9], [5], 10, 5)])
def test_configurations(size, count, cap, best):
    patterns, times = P.configurations(np.array(size, float), np.array(count, float), cap)
    used = patterns @ times
    assert (used <= count).all() and (np.array(size) @ patterns <= cap).all()
    assert times.sum() <= best and (np.array(count) - used).sum() <= 2 * len(size) * max(patterns.sum(axis=0))
