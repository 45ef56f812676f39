"""Registry of the queries on training text and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.runtime import ship_package, spread, table
from . import langid, leakage, names, packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            ship_package(spark)
            return f(spark, root)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


@query("p8_found")
def p8_found(spark, d):
    return langid.mislabelled(_documents(spark, d))


@query("p8_segments")
def p8_segments(spark, d):
    return langid.segments(_documents(spark, d))


@query("p7_found")
def p7_found(spark, d):
    return leakage.leaks(_documents(spark, d), table(spark, d, "eval_item"))


@query("p7_spans")
def p7_spans(spark, d):
    return leakage.leak_spans(_documents(spark, d), table(spark, d, "eval_item"))


@query("p3_found")
def p3_found(spark, d):
    return names.linked_pairs(names.resolve(table(spark, d, "test_csv_input")))


@query("p3_classes")
def p3_classes(spark, d):
    return names.class_sizes(names.resolve(table(spark, d, "test_csv_input")))


@query("p6_pack")
def p6_pack(spark, d):
    return packing.pack(_documents(spark, d), table(spark, d, "pack_capacity"))


@query("p6_usage")
def p6_usage(spark, d):
    return packing.usage(packing.pack(_documents(spark, d), table(spark, d, "pack_capacity")), table(spark, d, "pack_capacity"))
