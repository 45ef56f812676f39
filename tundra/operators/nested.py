"""Deeply nested semi-structured records to related flat tables, by columnar shredding.

A record is striped into columns, one for each leaf path; every entry has a repetition level (which repeated
ancestor it continues) and a definition level (how much of its path is present). Tables for each repeated or nested
ancestor are then rebuilt from the level sequences alone: array positions are counted from the repetition levels,
presence is read from the definition levels. All of it is per record, so the plan has no shuffle.

Defined results
    null, broken or non-object records give no rows (``record_status`` says which); records may be nested to any depth; empty objects and arrays give no leaves; null leaves are entries
    below their full definition level; text that holds an object or array is read as that structure in place;
    provenance keys are dropped with all below them; repeated records give rows each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import loads

#: The step of a path into the members of an array.
ITEM = None
Path = tuple


def is_provenance(key: str) -> bool:
    return key == "prov" or "_prov" in key


def unfold(value: object) -> object:
    """Text that holds a whole object or array, as that structure; anything else as it is."""
    if isinstance(value, str):
        t = value.strip()
        if t[:1] in ("{", "[") and t[-1:] in ("}", "]"):
            try:
                got = loads(t)
            except ValueError:
                return value
            if isinstance(got, (dict, list)):
                return got
    return value


def clean(value: object) -> object:
    """The structure without provenance and with embedded text unfolded; by a stack, for any depth."""
    root: list = [None]
    todo = [(root, 0, value)]
    while todo:
        into, at, v = todo.pop()
        v = unfold(v)
        if isinstance(v, dict):
            out: dict | list = {}
            into[at] = out
            for k, x in v.items():
                if not is_provenance(k):
                    out[k] = None
                    todo.append((out, k, x))
        elif isinstance(v, list):
            out = [None] * len(v)
            into[at] = out
            todo += [(out, i, x) for i, x in enumerate(v)]
        else:
            into[at] = v
    return root[0]


def read_record(doc: str | None) -> tuple[dict | None, str]:
    """(the cleaned record, 'whole'), or (None, why not): 'null', 'broken' or 'no object'."""
    if doc is None:
        return None, "null"
    try:
        got = clean(loads(doc))
    except ValueError:
        return None, "broken"
    return (got, "whole") if isinstance(got, dict) else (None, "no object")


def parse_record(doc: str | None) -> dict | None:
    """One whole record, cleaned, or None."""
    return read_record(doc)[0]


class _Node:
    """What occurs at one path of a record: a scalar, an object's fields, an array's members."""

    __slots__ = ("scalar", "fields", "item", "parent", "step", "live")

    def __init__(self, parent: _Node | None = None, step: str | None = ITEM) -> None:
        self.scalar, self.fields, self.item, self.parent, self.step, self.live = False, {}, None, parent, step, True

    def path(self) -> Path:
        out, n = [], self
        while n.parent is not None:
            out.append(n.step)
            n = n.parent
        return tuple(reversed(out))

    def children(self) -> list[_Node]:
        return [*self.fields.values(), *([self.item] if self.item is not None else [])]


def _shape(value: object) -> list[_Node]:
    """The nodes of a record, parents first."""
    root = _Node()
    nodes, todo = [root], [(value, root)]
    while todo:
        v, n = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k not in n.fields:
                    n.fields[k] = _Node(n, k)
                    nodes.append(n.fields[k])
                todo.append((x, n.fields[k]))
        elif isinstance(v, list):
            if n.item is None:
                n.item = _Node(n)
                nodes.append(n.item)
            todo += [(x, n.item) for x in v]
        else:
            n.scalar = True
    return nodes


def _prune(nodes: list[_Node], keep: Callable[[Path], bool]) -> None:
    """Column pruning: drop subtrees without a wanted leaf, from the innermost out."""
    for n in reversed(nodes):
        n.scalar = n.scalar and keep(n.path())
        n.fields = {k: x for k, x in n.fields.items() if x.live}
        if n.item is not None and not n.item.live:
            n.item = None
        n.live = n.scalar or bool(n.fields) or n.item is not None


#: stands for a field or member that a record lacks
_ABSENT = object()


def stripe(record: dict, keep: Callable[[Path], bool] | None = None) -> dict[Path, list[tuple[int, int, object]]]:
    """Columns of a record: leaf path -> [(repetition level, definition level, value)]. By a stack, for any depth."""
    nodes = _shape(record)
    if keep is not None:
        _prune(nodes, keep)
    columns: dict[_Node, list] = {}
    # value, node, repetition level, definition level, repeated ancestors
    todo: list[tuple] = [(record, nodes[0], 0, 0, 0)]
    while todo:
        v, n, r, d, depth = todo.pop()
        if n.scalar:
            here = v is not _ABSENT and v is not None and not isinstance(v, (dict, list))
            columns.setdefault(n, []).append((r, d + here, v if here else None))
        parts: list[tuple] = []
        for k, x in n.fields.items():
            parts.append((v[k], x, r, d + 1, depth) if isinstance(v, dict) and k in v else (_ABSENT, x, r, d, depth))
        if n.item is not None:
            if isinstance(v, list) and v:
                parts += [(x, n.item, r if i == 0 else depth + 1, d + 1, depth + 1) for i, x in enumerate(v)]
            else:
                parts.append((_ABSENT, n.item, r, d, depth))
        todo += reversed(parts)
    return {n.path(): entries for n, entries in columns.items()}


def positions(path: Path, entries: list[tuple[int, int, object]]) -> Iterator[tuple[Path, object]]:
    """Concrete paths and values of a column's present entries, from its levels alone."""
    repeated = [i for i, step in enumerate(path) if step is ITEM]
    full = len(path) + 1
    count = [0] * len(repeated)
    for r, d, v in entries:
        if r == 0:
            count = [0] * len(repeated)
        else:
            count[r - 1] += 1
            count[r:] = [0] * (len(repeated) - r)
        if d == full:
            at = list(path)
            for i, c in zip(repeated, count):
                at[i] = c
            yield tuple(at), v


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v)  # a leaf


def _owner(path: Path, field: str) -> int | None:
    """Length of the path of the object whose ``field`` this leaf gives: the field itself, wrapped in value or arrays."""
    i = len(path) - 1
    while i >= 0 and path[i] != field and (path[i] is ITEM or path[i] == "value"):
        i -= 1
    return i if i > 0 and path[i] == field else None


def labelled_objects(record: dict, field: str = "category") -> list[tuple[str, str, str]]:
    """(path, parent_path, label) of each object below the root that has a label."""
    found: list[tuple[Path, tuple, str]] = []
    for path, entries in stripe(record, lambda p: _owner(p, field) is not None).items():
        n = _owner(path, field)
        found += [(at[:n], at[n:], _text(v)) for at, v in positions(path, entries)]
    owners = {at for at, _, _ in found}

    def parent(at: Path) -> str:
        for i in range(len(at) - 1, 0, -1):
            if at[:i] in owners:
                return "/".join(map(str, at[:i]))
        return ""

    return [("/".join(map(str, at)), parent(at), v) for at, _, v in found]


def objects_table(records: DataFrame, id_col: str = "rec_id", doc_col: str = "doc", field: str = "category") -> DataFrame:
    """One row for each labelled object: id, path, parent_path (link to the enclosing labelled object), label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *row) for i, doc in zip(pdf["rec_id"], pdf["doc"]) if (rec := parse_record(doc)) is not None for row in labelled_objects(rec, field)]
            yield pd.DataFrame(out, columns=["rec_id", "path", "parent_path", "label"]).astype({"rec_id": "int64"})

    src = records.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(doc_col).cast("string").alias("doc")).filter("rec_id IS NOT NULL")
    return src.mapInPandas(run, "rec_id bigint, path string, parent_path string, label string").withColumnRenamed("label", field)


def leaf_levels(records: DataFrame, id_col: str = "rec_id", doc_col: str = "doc") -> DataFrame:
    """The striped columns of every record: column path, entry number, levels, value as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, doc in zip(pdf["rec_id"], pdf["doc"]):
                if (rec := parse_record(doc)) is not None:
                    for path, entries in stripe(rec).items():
                        name = "/".join("[]" if s is ITEM else s for s in path)
                        out += [(i, name, k, r, d, None if v is None else _text(v)) for k, (r, d, v) in enumerate(entries)]
            yield pd.DataFrame(out, columns=["rec_id", "column_path", "entry", "rep_level", "def_level", "value"]).astype({"rec_id": "int64", "entry": "int32", "rep_level": "int32", "def_level": "int32"})

    src = records.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(doc_col).cast("string").alias("doc")).filter("rec_id IS NOT NULL")
    return src.mapInPandas(run, "rec_id bigint, column_path string, entry int, rep_level int, def_level int, value string")


def values_table(records: DataFrame, id_col: str = "rec_id", doc_col: str = "doc") -> DataFrame:
    """The present leaf values of every record, with the path of the object or array each belongs to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, doc in zip(pdf["rec_id"], pdf["doc"]):
                if (rec := parse_record(doc)) is not None:
                    for path, entries in stripe(rec).items():
                        out += [(i, "/".join(map(str, at[:-1])), str(at[-1]), _text(v)) for at, v in positions(path, entries)]
            yield pd.DataFrame(out, columns=["rec_id", "parent_path", "field", "value"]).astype({"rec_id": "int64"})

    src = records.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(doc_col).cast("string").alias("doc")).filter("rec_id IS NOT NULL")
    return src.mapInPandas(run, "rec_id bigint, parent_path string, field string, value string")


def record_status(records: DataFrame, id_col: str = "rec_id", doc_col: str = "doc") -> DataFrame:
    """(rec_id, status) of every record: 'whole', 'null', 'broken' or 'no object'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "status": [read_record(doc)[1] for doc in pdf["doc"]]})

    src = records.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(doc_col).cast("string").alias("doc")).filter("rec_id IS NOT NULL")
    return src.mapInPandas(run, "rec_id bigint, status string")
