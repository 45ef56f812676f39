"""Incremental forms of the mergeable aggregates on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.accum import sample_stdv
from ..operators.histogram import bin_of
from ..plans.runtime import shared_folder


def running_statistics(stream: DataFrame, keys: list[str], value: str, time: str | None = None, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """count, sum, mean, stdv, min, max of each group so far, or of each event-time window with late rows up to ``late``."""
    if time:
        stream = stream.withWatermark(time, late)
    by = [F.window(time, window)] if window else []
    x = F.col(value)
    return stream.groupBy(*by, *keys).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), sample_stdv(x).alias("stdv"), F.min(x).alias("min"), F.max(x).alias("max"))


def running_histogram(stream: DataFrame, keys: list[str], value: str, quantum: float = 0.5) -> DataFrame:
    """The bins of each group so far."""
    x = F.col(value)
    return stream.filter(x.isNotNull()).groupBy(*keys, bin_of(x, quantum).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(x == 0, 1).otherwise(0)).alias("zeros"))


def first_deliveries(stream: DataFrame, ident: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ident)


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    # a pattern, as a stream's plain path must be a folder while a table may be one file
    return spark.readStream.schema(schema).parquet(f"{root}/{name}.parque[t]")


def run_available(aggregated: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a streaming aggregation to the present end of its source and gives its last result.

    Every batch upserts its changed groups into a table in the shared checkpoint folder, so the result is never held by
    the driver; readers take each group's row of the last batch.
    """
    spark = aggregated.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream_{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    q = aggregated.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(store).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    rest = [c for c in aggregated.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
