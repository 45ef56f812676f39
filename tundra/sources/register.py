"""Spark data sources for the text formats: spark.read.format("kvp" | "yaml_records" | "ogr_listing" | "loose_csv").load(path).

Each file of the path (a file, folder or glob on storage that all executors mount) is one partition, read by its
executor; the driver only lists names (and for CSV reads one header).
"""

from __future__ import annotations

import glob
import gzip
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import csvtext, kvp, yamlfiles
from .files import GZIP, decode


def _files(path: str, pattern: str = "*") -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    found = glob.glob(os.path.join(path, pattern)) if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))


def _text(path: str, encoding: str | None) -> str:
    with open(path, "rb") as f:
        data = f.read()
    return decode(gzip.decompress(data) if data[:2] == GZIP else data, encoding)


class _Reader(DataSourceReader):
    pattern = "*"

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.options["path"], self.pattern)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from self.rows(partition.value, _text(partition.value, self.options.get("encoding")))

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError


class _KvpReader(_Reader):
    def rows(self, path: str, text: str) -> Iterator[tuple]:
        for i, line in enumerate(text.splitlines()):
            try:
                if (got := kvp.parse_line(line)) is not None:
                    yield path, i, got[0], kvp._kind(got[1]), json.dumps(got[1], ensure_ascii=False), None
            except kvp.Unreadable as e:
                yield path, i, None, None, None, str(e)


class _YamlReader(_Reader):
    pattern = "*.yaml"

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        try:
            rec = yamlfiles.load_text(text)
            if not isinstance(rec, dict):
                raise ValueError("not a mapping")
        except Exception as e:  # noqa: BLE001 - any unreadable file is reported
            yield path, None, None, str(e)
            return
        if self.options.get("simplified", "false").lower() == "true":
            yield path, [str(k) for k in rec], json.dumps(yamlfiles.simplify(rec), ensure_ascii=False, default=str), None
        else:
            yield path, [str(k) for k in rec], json.dumps(rec, ensure_ascii=False, default=str), None


class _OgrReader(_Reader):
    def rows(self, path: str, text: str) -> Iterator[tuple]:
        for i, part in enumerate(("\n" + text).split("\nOGRFeature")[1:]):
            yield path, i, part


class _CsvReader(_Reader):
    def __init__(self, options: dict, delim: str | None, width: int) -> None:
        super().__init__(options)
        self.delim, self.width = delim, width

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        for line in text.splitlines()[1:]:
            if line.strip():
                cells = csvtext.split_line(line, self.delim)
                if len(cells) != self.width:
                    raise ValueError(f"{self.width} cells expected in {path}, not {len(cells)}")
                yield tuple(c[1:-1] if len(c) > 1 and c[0] == c[-1] == '"' else c for c in cells)


class KvpSource(DataSource):
    """Key-value text: a row for each key, in line order, with an error for each unreadable line."""

    @classmethod
    def name(cls) -> str:
        return "kvp"

    def schema(self) -> str:
        return "path string, seq bigint, key string, kind string, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _KvpReader(self.options)


class YamlSource(DataSource):
    """YAML records: a row for each file."""

    @classmethod
    def name(cls) -> str:
        return "yaml_records"

    def schema(self) -> str:
        return "path string, keys array<string>, record string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _YamlReader(self.options)


class OgrSource(DataSource):
    """Shape listings: a row for each feature's text, for ``ogr.attributes`` and ``ogr.rings``."""

    @classmethod
    def name(cls) -> str:
        return "ogr_listing"

    def schema(self) -> str:
        return "path string, feature_no bigint, feature string"

    def reader(self, schema) -> DataSourceReader:
        return _OgrReader(self.options)


class LooseCsvSource(DataSource):
    """CSV with the delimiter of its header; all cells as text. ``csvtext.read_csv`` types them."""

    @classmethod
    def name(cls) -> str:
        return "loose_csv"

    def _head(self) -> tuple[list[str], str | None]:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no file at {self.options['path']}")
        lines = _text(files[0], self.options.get("encoding")).splitlines()
        for d in csvtext.DELIMITERS:
            n = len(csvtext.split_line(lines[0], d)) if d is None or d in lines[0] else 0
            if n >= (3 if d is None else 2) and all(len(csvtext.split_line(x, d)) == n for x in lines[1:] if x.strip()):
                return csvtext.header_keys(lines[0], d)[0], d
        raise ValueError("no delimiter fits this text")

    def schema(self) -> str:
        return ", ".join(f"`{k.replace('`', '')}` string" for k in self._head()[0])

    def reader(self, schema) -> DataSourceReader:
        keys, delim = self._head()
        return _CsvReader(self.options, delim, len(keys))


def register(spark: SparkSession) -> None:
    """Make all of them known to the session."""
    for source in (KvpSource, YamlSource, OgrSource, LooseCsvSource):
        spark.dataSource.register(source)
