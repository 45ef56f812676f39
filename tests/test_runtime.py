import pytest
from conftest import rows

from tundra.plans import runtime


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5).orderBy("k", "id")
    got = rows(runtime.number_rows(df, "n", 3), "n", "k", "id")
    want = sorted((i % 7, i) for i in range(1000))
    assert got == sorted([(n + 3, *w) for n, w in enumerate(want)], key=repr)
    assert runtime.number_rows(df.limit(0), "n").count() == 0


def test_small(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(runtime.small(spark.range(5), 5)) and "ResolvedHint" not in plan(runtime.small(spark.range(6), 5))


class Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


class Session:
    sparkContext = Context()
    conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        runtime.shared_folder(Session())
