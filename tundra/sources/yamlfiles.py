"""YAML records: reading folders of files, simplifying provenance away, writing records back.

Defined results: a file that isn't one mapping gives a row with null record and an error; keys keep their order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext
from ..operators.nested import is_provenance
from ..plans.runtime import number_rows
from .files import decode

FIRST_KEYS = ("name", "abbrev", "category")


def load_text(text: str) -> object:
    """Safe YAML; the Python tags for plain text are read as text."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    for tag in ("python/unicode", "python/str"):
        Loader.add_constructor(f"tag:yaml.org,2002:{tag}", lambda loader, node: loader.construct_scalar(node))
    return yaml.load(text, Loader=Loader)


def simplify(entry: object) -> object:
    """Provenance dropped, {value: v} collapsed to v as it is, lists of {category, count or value} flattened into key+category.

    Downwards every object is cut to what stays of it; then, from the innermost out, each spreads its lists. No recursion.
    """
    top = [entry]
    objects: list[dict] = []
    todo: list[tuple] = [(top, 0)]
    while todo:
        holder, at = todo.pop()
        v = holder[at]
        if isinstance(v, dict) and "value" in v:
            holder[at] = v["value"]
        elif isinstance(v, dict):
            holder[at] = kept = {k: x for k, x in v.items() if not is_provenance(k)}
            objects.append(kept)
            todo += [(kept, k) for k in kept]
        elif isinstance(v, list):
            holder[at] = kept = list(v)
            todo += [(kept, i) for i in range(len(kept))]
    for o in reversed(objects):
        flat = dict(pair for k, v in o.items() for pair in (_spread(k, v) if isinstance(v, list) else [(k, v)]))
        o.clear()
        o.update(flat)
    return top[0]


def _spread(key: str, members: list) -> list[tuple[str, object]]:
    """A list as fields: one for each member with a category and an amount, and one for the members without a category."""
    counted = [m for m in members if isinstance(m, dict) and "category" in m]
    fields = [(f"{key}{m['category']}", m["count" if "count" in m else "value"]) for m in counted if "count" in m or "value" in m]
    rest = [m for m in members if not (isinstance(m, dict) and "category" in m)]
    return fields + ([(key, rest)] if rest else [])


def read_folder(spark: SparkSession, folder: str, simplified: bool = False) -> DataFrame:
    """(path, keys, record, error) of every .yaml file; ``record`` is JSON text in key order, ``keys`` the raw top-level keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rec = load_text(decode(bytes(data)))
                    if not isinstance(rec, dict):
                        raise ValueError("not a mapping")
                    out.append((path, [str(k) for k in rec], json.dumps(simplify(rec) if simplified else rec, ensure_ascii=False, default=str), None))
                except Exception as e:  # noqa: BLE001 - any unreadable file is reported
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "keys", "record", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select("path", "content").mapInPandas(run, "path string, keys array<string>, record string, error string")


def key_union(records: DataFrame) -> list[str]:
    """All top-level keys, sorted."""
    return sorted(r[0] for r in records.select(F.explode("keys")).distinct().collect())  # column names


def simplify_json(records: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """(id, simplified): records given as JSON text; broken ones are null. Numbers keep their text form as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, doc in zip(pdf["id"], pdf["doc"]):
                try:
                    got = jsontext.dumps(simplify(jsontext.loads(doc)))
                except (ValueError, TypeError):
                    got = None
                out.append((i, got))
            yield pd.DataFrame(out, columns=["id", "simplified"])

    return records.select(F.col(id_col).cast("bigint").alias("id"), F.col(doc_col).alias("doc")).mapInPandas(run, "id bigint, simplified string").withColumnRenamed("id", id_col)


def file_names(records: DataFrame, order: str, record: str = "record") -> DataFrame:
    """Adds ``file_name``: abbrev.yaml, or noneN.yaml numbered in order over records without an abbrev."""
    abbrev = F.get_json_object(record, "$.abbrev")
    bare = F.coalesce(abbrev, F.lit("")) == ""
    named = records.withColumn("file_name", F.when(~bare, F.concat(abbrev, F.lit(".yaml"))))
    numbered = number_rows(named.filter(bare).select(order).orderBy(order), "_n")
    return named.join(numbered, order, "left").withColumn("file_name", F.coalesce("file_name", F.concat(F.lit("none"), F.col("_n").cast("string"), F.lit(".yaml")))).drop("_n")


def dump(record: str, first: tuple[str, ...] = FIRST_KEYS) -> str:
    """YAML text of a JSON record, the preferred keys first where present."""
    import yaml

    rec = json.loads(record)
    rec = {k: rec[k] for k in [*(k for k in first if k in rec), *(k for k in rec if k not in first)]}
    return yaml.safe_dump(rec, default_flow_style=False, indent=4, width=130, explicit_start=True, allow_unicode=True, sort_keys=False)


def save_folder(records: DataFrame, folder: str, order: str, record: str = "record", first: tuple[str, ...] = FIRST_KEYS) -> None:
    """One file a record, written by the tasks into a shared folder."""
    import os

    named = file_names(records, order, record).select("file_name", record)
    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        for name, rec in rows:
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(dump(rec, first))

    named.foreachPartition(write)
