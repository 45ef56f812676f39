"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SHIPPED: set[str] = set()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers that don't share the driver's path.

    The archive goes through Spark's own file distribution, once for each application.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="tundra_", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder will do only if executors run in the driver's process; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="tundra_ckpt_")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan over at least as many partitions as there are task slots.

    Only layout: a table of few large files feeds one slow Python task each, so its selected columns are dealt out
    once; a table with partitions enough is left as it is. Only for scans, whose partitions are known without a job.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most: int) -> DataFrame:
    """The table marked for a broadcast if it has at most ``most`` rows, otherwise as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def number_rows(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: the rows' numbers in their present order, over all partitions.

    Rows are numbered inside their partitions, which are cut off by a checkpoint so that they stay the same; the partitions'
    counts (one row each) are summed up and joined back.
    """
    cut = checkpoint(df.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = cut.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a partition
    return cut.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place + start).drop("_at", "_part", "_before")
