import random

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tundra import queries as Q
from tundra.operators import kvstore as K
from tundra.operators import notes as N

NOTE = "grp string, holder string, seq bigint, op string, note_key string, num double, str_val string"


def test_word_and_sums(spark):
    ev, seq = [], 0
    for op, kv in [("add", dict(int=0.0, float=1.0, word="hello "))] + [("add", dict(int=float(i), float=1.0 + 0.1 * i, word="world ")) for i in range(10)] + [("add", dict(float=6789.0, word="foobar"))]:
        for k, v in kv.items():
            seq += 1
            ev.append(("nhg1", "nh1_1", seq, op, k, None if isinstance(v, str) else v, v if isinstance(v, str) else None))
    got = {r.note_key: r for r in N.fold(spark.createDataFrame(ev, NOTE), ["grp", "holder"], "note_key", "num", "str_val").collect()}
    assert got["int"].total == 45 and got["float"].total == pytest.approx(6804.5) and got["word"].words == "hello " + 10 * "world " + "foobar" and got["int"].words is None


def test_gate_and_replace_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 97)
    r = random.Random(5)
    ev = []
    for seq in range(1, 3001):
        g = f"g{r.randint(0, 1)}"
        op = r.choices(["add", "replace", "enable", "disable"], [85, 9, 3, 3])[0]
        ev.append((g, f"{g}h{r.choice([0, 0, 0, 1, 2])}", seq, op, None if op in ("enable", "disable") else f"k{r.randint(0, 3)}", r.choice([None, 1.0, 2.5]), None))
    state, on = {}, {}
    for g, h, _, op, k, num, _ in ev:
        if op in ("enable", "disable"):
            on[g] = op == "enable"
        elif on.get(g, True):
            state[g, h, k] = (num or 0.0) + (state.get((g, h, k), 0.0) if op == "add" else 0.0)
    df = spark.createDataFrame(ev + ev[::7], NOTE).repartition(5)
    e = N.effective(N.gate(N.once(df, ["grp", "holder", "seq"])), ["grp", "holder"], "note_key")
    got = {(x.grp, x.holder, x.note_key): x.total or 0.0 for x in N.fold(e, ["grp", "holder"], "note_key", "num").collect()}
    assert got == pytest.approx(state)
    got = {(x.grp, x.holder, x.note_key): x.total or 0.0 for x in N.fold_ledger(df, "note_key", "num").collect()}
    assert got == pytest.approx(state)
    plan = N.fold_ledger(df, "note_key", "num")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 or plan.count("Scan") <= 2
    assert N.fold(N.gate(df.limit(0)), ["grp", "holder"], "note_key", "num").count() == 0


def test_lists_keep_empty_texts(spark, tmp_path):
    ev = [("h_one", 1, 1.0, ""), ("h_two", 2, 1.0, ""), ("h_two", 3, None, ""), ("h_mixed", 5, 2.0, "a"), ("h_mixed", 4, None, ""), ("h_none", 6, 3.0, None), ("h_text", 7, None, "x"), ("h_late", None, None, "n"), ("h_late", 8, 1.0, "m")]
    ledger = f"{tmp_path}/note_ledger.parquet"
    spark.createDataFrame([("g", h, seq, "add", "k", num, text) for h, seq, num, text in ev], NOTE).write.parquet(ledger)
    got = {r.holder: tuple(r) for r in Q.QUERIES["notes_lists"](spark, str(tmp_path)).collect()}
    assert {h: r[1] for h, r in got.items()} == {"h_one": "", "h_two": ",", "h_mixed": ",a", "h_none": None, "h_text": "x", "h_late": "m,n"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW note_ledger AS SELECT * FROM read_parquet('{ledger}/*.parquet')")
    assert got == {r[0]: r for r in con.execute(Q.SQL["notes_lists"]).fetchall()}


def test_report(spark):
    f = spark.createDataFrame([("h1", "name", "n1"), ("h1", "z", "1"), ("h2", "code", "c"), ("h3", "z", "3"), ("h3", "a", "4")], "holder string, note_key string, v string")
    assert N.report(f, ["holder"], "note_key", "v").columns == ["holder", "code", "name", "a", "z"]
    assert rows(N.report(f, ["holder"], "note_key", "v", ["z"], ["z", "a"], ["code"])) == [("h2", None), ("h3", "3")]
    assert rows(N.keep_keys(f, "note_key", "na"), "note_key") == [("name",)]
    lines = rows(N.csv_lines(N.report(f, ["holder"], "note_key", "v", ["z"]), ["holder", "z"], preamble=["# top"]))
    assert [x[1] for x in lines] == ["# top", "holder,z", "h1,1", "h2,NA", "h3,3"]


def test_debit_credit(spark):
    s = spark.createDataFrame([(1, 10), (2, 10), (3, -1)], "key bigint, value bigint")
    req = spark.createDataFrame([(1, 3, 0), (2, 15, 0), (3, 3, 0), (9, 1, 0)], "key bigint, amount bigint, min_remaining bigint")
    assert rows(K.debit_all(s, req, "key"), "key", "new_value", "unmet") == [(1, 7, 0), (2, 0, 5), (3, -1, 3)]
    c = spark.createDataFrame([(1, 8), (2, 12), (3, 8)], "key bigint, value bigint")
    req = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 1, 10)], "key bigint, amount bigint, max_remaining bigint")
    assert rows(K.credit_all(c, req, "key"), "key", "new_value", "unmet") == [(1, 10, 3), (2, 12, 5), (3, 9, 0)]
    with pytest.raises(Exception, match="twice"):
        K.credit_all(c, req.unionByName(req), "key").collect()


@pytest.mark.parametrize("pool,want,left", [(13, [10, 12, 5, 2], 0), (30, [10, 12, 5, 9], 10)])
def test_pool(spark, pool, want, left):
    df = spark.createDataFrame([(0, 3, 10), (1, 12, 10), (2, 1, 5), (3, 0, 9)], "ord int, value bigint, mx bigint")
    got = K.credit_from_pool(df, "ord", "value", "mx", pool).orderBy("ord").collect()
    assert [r.new_value for r in got] == want and {r.leftover for r in got} == {left}


def test_pool_against_a_loop(spark):
    r = random.Random(2)
    data = [(i, r.randint(0, 20), r.randint(0, 20)) for i in range(2000)]
    pool, want = 4000, {}
    for i, v, m in data:
        t = max(min(max(m - v, 0), pool), 0)
        want[i], pool = v + t, pool - t
    df = spark.createDataFrame(data, "ord int, value bigint, mx bigint").repartition(6)
    assert {x.ord: x.new_value for x in K.credit_from_pool(df, "ord", "value", "mx", 4000).collect()} == want
    with pytest.raises(ValueError):
        K.credit_from_pool(df, "ord", "value", "mx", -1)


def test_store(spark, tmp_path):
    s = spark.createDataFrame([(i, i) for i in range(10)], "key bigint, value bigint")
    w = spark.createDataFrame([(3, 30, 1), (3, 31, 2), (11, 5, 1), (None, 1, 1)], "key bigint, value bigint, n int")
    new = K.upsert(s, K.last_wins(w, "key", "n"), "key")
    assert new.count() == 11 and K.get(new, "key", 3, "value") == 31 and K.get(new, "key", 99, "value", 7) == 7
    with pytest.raises(KeyError):
        K.get(new, "key", 99, "value")
    K.save(new, str(tmp_path / "kv"), "key")
    again = K.store_factory(spark, str(tmp_path))("kv").read()
    assert [r.key for r in K.key_range(again, "key", 2, 4).collect()] == [2, 3, 4]
    with pytest.raises(Exception):
        K.save(new, str(tmp_path / "kv"), "key")
    assert rows(K.put_all(s, w.filter("key IS NOT NULL"), "key", "value", 0).filter("value = 0"), "key") == [(0,), (11,), (3,)]
    assert K.delete_all(s, s.limit(0), "key").count() == 10 and K.get_all(s.limit(0), s, "key").filter(F.col("value").isNull()).count() == 10


def test_store_options(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2]), ("b", None)], "key string, value array<int>")
    o = K.Options(integer_keys=False, value_codec="json", dated=True)
    a = K.Store(spark, f"{tmp_path}/s.", "key", {"key": "string", "value": "array<int>"}, o).write(df)
    assert rows(a.read()) == [("a", [1, 2]), ("b", None)] and a.path != f"{tmp_path}/s." and dict(K.open_store(spark, a.path).dtypes)["value"] == "string"
    b = a.copy()
    assert rows(b.read()) == rows(a.read()) and b.options.value_codec == "json" and b.path.startswith(a.path + ".copied.")
    with pytest.raises(Exception, match="exist"):
        a.write(df)
    with pytest.raises(ValueError):
        K.Options(value_codec="pickle")
    with pytest.raises(ValueError):
        K.Options(key_codec="json")
    json_keys = K.Store(spark, f"{tmp_path}/j", "key", {"key": "struct<x:int>", "value": "int"}, K.Options(integer_keys=False, key_codec="json", overwrite=True))
    pairs = spark.createDataFrame([((1,), 5)], "key struct<x:int>, value int")
    assert json_keys.write(pairs).write(pairs).read().head().key.x == 1
