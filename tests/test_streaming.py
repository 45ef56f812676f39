from conftest import rows

from tundra.operators.accum import sample_stdv  # noqa: F401
from tundra.streaming import ledger


def test_running_statistics(spark, tmp_path):
    src, schema = tmp_path / "in", "k string, v double"
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = ledger.running_statistics(stream, ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("stats").start()
    h = ledger.running_histogram(stream, ["k"], "v", 2.0).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    for x in (q, h):
        x.processAllAvailable()
    spark.createDataFrame([("b", 7.0)], schema).coalesce(1).write.mode("append").parquet(str(src))
    for x in (q, h):
        x.processAllAvailable()
        x.stop()
    assert rows(spark.table("stats"), "k", "count", "mean") == [("a", 2, 2.0), ("b", 2, 6.0)]
    assert rows(spark.table("bins"), "k", "bin", "n") == [("a", 0, 1), ("a", 1, 1), ("b", 2, 1), ("b", 3, 1)]
