"""Loosely typed CSV text: delimiter sniffing, cells typed by their quotes, and writing.

The delimiter is found on the header and confirmed over all lines by one aggregation; a scanner cuts lines into cells in
Arrow batches; then every cell is typed on its own in the JVM: text in double quotes stays text when all headers are quoted; else
percent, whole number, number, text.

Defined results
    blank lines are skipped; a record whose number of cells differs from the header's is an error in strict mode and left
    out otherwise; '' is a value; cells keep their quotes when headers are unquoted; only '"' quotes are taken off cells.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import float_value, int_value
from ..plans.runtime import number_rows
from . import files

#: tried in this order; None is white space
DELIMITERS = (";", ",", "\t", None)


def split_line(line: str, delim: str | None) -> list[str]:
    """The trimmed cells of one line, by a scanner that knows at every cell's start whether it is quoted.

    A cell is quoted if it begins with a quote mark and the next such mark is followed by the delimiter or the line's end; else it
    is bare and ends at the next delimiter. A bare cell of a tab file with a quote mark in it makes the record unreadable: no cells.
    """
    line = line.rstrip("\r\n")
    if delim is None:
        return line.split()
    cells, at, end = [], 0, len(line)
    while True:
        start = _skip(line, at, delim)
        mark = line[start] if start < end else ""
        stop = -1
        if mark and mark in "\"'":
            close = line.find(mark, start + 1)
            after = _skip(line, close + 1, delim) if close > 0 else end + 1
            if after == end or (after < end and line[after] == delim):
                cells.append(line[start : close + 1])
                stop = after
        if stop < 0:
            stop = line.find(delim, at)
            stop = end if stop < 0 else stop
            bare = line[at:stop].strip()
            if delim == "\t" and ('"' in bare or "'" in bare):
                return []
            cells.append(bare)
        if stop >= end:
            return cells
        at = stop + 1


def _skip(line: str, at: int, delim: str) -> int:
    """The next place that is no blank; a delimiter is none."""
    while at < len(line) and line[at] != delim and line[at].isspace():
        at += 1
    return at


def split_cells(line: Column, delim: str | None) -> Column:
    """The trimmed cells of a line, in Arrow batches; null lines have none."""
    return F.pandas_udf(lambda s: s.map(lambda t: [] if t is None else split_line(t, delim)), "array<string>")(line)


def is_blank(line: str) -> Column:
    return F.trim(F.regexp_replace(line, r"[\r\n]", "")) == ""


def sniff(lines: DataFrame, header: str, line: str = "line") -> str | None:
    """The first delimiter that splits the header into enough cells and every line into as many; one pass for all."""
    tried = [(d, len(split_line(header, d))) for d in DELIMITERS if d is None or d in header]
    tried = [(d, n) for d, n in tried if n >= (3 if d is None else 2)]
    if not tried:
        raise ValueError("no delimiter fits this text")

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ok = [True] * len(tried)
        for pdf in batches:
            for text in pdf["line"]:
                ok = [was and len(split_line(text, d)) == n for was, (d, n) in zip(ok, tried)]
        yield pd.DataFrame({"which": range(len(tried)), "ok": ok})

    got = lines.filter(~is_blank(line)).select(F.col(line).alias("line")).mapInPandas(fits, "which int, ok boolean").groupBy("which").agg(F.min("ok").alias("ok")).collect()  # one row a delimiter
    for i, (d, _) in enumerate(tried):
        if all(r["ok"] for r in got if r["which"] == i):
            return d
    raise ValueError("no delimiter fits this text")


def header_keys(header: str, delim: str | None) -> tuple[list[str], bool]:
    """(keys, whether all headers are quoted)."""
    keys = split_line(header.lstrip("﻿"), delim)
    quoted = all(not k or (len(k) > 1 and k[0] == k[-1] and k[0] in "\"'") for k in keys)
    return [k[1:-1] for k in keys] if quoted else keys, quoted


def infer_cell(cell: Column, quoted: bool) -> Column:
    """(kind, i, f, s) of one cell: 'str', 'pct', 'int' or 'float'; whole numbers beyond BIGINT stay text."""
    inner = F.substr(cell, F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0)))
    is_text = cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1) if quoted else F.lit(False)
    pct = F.when(cell.endswith("%"), F.lit(0.01) * float_value(F.substr(cell, F.lit(1), F.greatest(F.length(cell) - 1, F.lit(0)))))
    whole = int_value(cell)
    digits = cell.rlike(r"^\s*[+-]?\d+\s*$")
    num = F.when(~digits, float_value(cell))
    kind = F.when(is_text, "str").when(pct.isNotNull(), "pct").when(cell.endswith("%"), "str").when(whole.isNotNull(), "int").when(num.isNotNull(), "float").otherwise("str")
    return F.struct(
        kind.alias("kind"), F.when(kind == "int", whole).alias("i"), F.when(kind == "pct", pct).when(kind == "float", num).alias("f"),
        F.when(kind == "str", F.when(is_text, inner).otherwise(cell)).alias("s"),
    )


def long_cells(lines: DataFrame, header: str, delim: str | None = ",", line: str = "line", carry: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(carry..., place, name, kind, i, f, s): a row for each cell of every record; one expression types them all."""
    keys, quoted = header_keys(header, delim)
    carry = carry or []
    cells = _records(lines, keys, delim, line, carry, strict).select(*carry, F.posexplode("_c").alias("place", "_t"))
    name = F.element_at(F.array(*map(F.lit, keys)), F.col("place") + 1)
    return cells.select(*carry, "place", name.alias("name"), infer_cell(F.col("_t"), quoted).alias("_x")).select(*carry, "place", "name", "_x.*")


def _records(lines: DataFrame, keys: list[str], delim: str | None, line: str, carry: list[str], strict: bool) -> DataFrame:
    """(carry..., _c) of the records with as many cells as there are keys."""
    cells = lines.filter(~is_blank(line)).select(*carry, split_cells(F.col(line), delim).alias("_c"))
    fits = F.size("_c") == len(keys)
    if not strict:
        return cells.filter(fits)
    return cells.withColumn("_c", F.when(fits, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit(f"{len(keys)} cells expected, not "), F.size("_c").cast("string"))).cast("array<string>")))


def parse_cells(lines: DataFrame, header: str, delim: str | None = ",", line: str = "line", carry: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(carry..., one struct column (kind, i, f, s) for each key) of every record."""
    keys, quoted = header_keys(header, delim)
    carry = carry or []
    # one lambda types all cells, so that the plan's code doesn't grow with the columns
    typed_ = _records(lines, keys, delim, line, carry, strict).select(*carry, F.transform("_c", lambda c: infer_cell(c, quoted)).alias("_t"))
    return typed_.select(*carry, *[F.element_at("_t", i + 1).alias(k) for i, k in enumerate(keys)])


def column_kinds(cells: DataFrame, keys: list[str]) -> dict[str, str]:
    """The narrowest type that holds every cell of a column, from ``long_cells``: one aggregation, one row a column."""
    order = F.create_map(*[F.lit(x) for kv in {"int": 0, "float": 1, "pct": 1, "str": 2}.items() for x in kv])
    empty = F.col("kind").eqNullSafe("str") & (F.col("s") == "")
    got = {r["place"]: r["top"] for r in cells.groupBy("place").agg(F.max(F.when(~empty, F.element_at(order, F.col("kind")))).alias("top")).collect()}
    return {k: {0: "bigint", 1: "double"}.get(got.get(i), "string") for i, k in enumerate(keys)}


def typed(parsed: DataFrame, kinds: dict[str, str], carry: list[str] | None = None) -> DataFrame:
    """Plain typed columns; '' is null in number columns."""
    pick = {
        "bigint": lambda c: c["i"],
        "double": lambda c: F.coalesce(c["f"], c["i"].cast("double")),
        "string": lambda c: F.coalesce(c["s"], c["i"].cast("string"), c["f"].cast("string")),
    }
    return parsed.select(*(carry or []), *[pick[t](F.col(f"`{k}`")).alias(k) for k, t in kinds.items()])


def read_csv(spark: SparkSession, source: str | DataFrame, encoding: str | None = None, strict: bool = True) -> DataFrame:
    """A CSV file, a folder of such files or a DataFrame (returned as it is), with inferred columns.

    Large files are read in splits; every file opens with the same header, which is left out wherever a file begins.
    """
    if isinstance(source, DataFrame):
        return source
    lines = files.split_lines(spark, source, encoding)
    head = _header(lines)
    if head is None:
        raise ValueError(f"{source} is empty")
    body = lines.filter(~(F.col("first") & (F.rtrim(F.regexp_replace("line", "^\ufeff", "")) == head)))
    delim = sniff(body, head)
    keys = header_keys(head, delim)[0]
    kinds = column_kinds(long_cells(body, head, delim, strict=strict), keys)
    return typed(parse_cells(body, head, delim, strict=strict), kinds).select(*keys)


def _header(lines: DataFrame) -> str | None:
    """The first line with text of the first file; only files' first lines are looked at, unless the first file opens with blank ones."""
    top = lines.filter("first").orderBy("path").head()
    if top is None:
        return None
    if not top["line"].strip("\ufeff \r\n\t"):
        top = lines.filter((F.col("path") == top["path"]) & ~is_blank("line")).orderBy("block", "place").head()
    return top["line"].lstrip("\ufeff").rstrip() if top else None


def read_header(spark: SparkSession, source: str | DataFrame, encoding: str | None = None) -> list[str]:
    """Only the keys."""
    if isinstance(source, DataFrame):
        return source.columns
    lines = files.split_lines(spark, source, encoding)
    head = _header(lines)
    if head is None:
        raise ValueError(f"{source} is empty")
    return header_keys(head, sniff(lines.filter(~F.col("first")), head))[0]


def number_text(c: Column, kind: str) -> Column:
    """Whole numbers as digits (booleans 1 and 0), doubles as their shortest form without Spark's capital E."""
    if kind == "boolean":
        return c.cast("int").cast("string")
    if kind in ("double", "float"):
        s = c.cast("string")
        # 1.0E10 is written 10000000000.0, 1.5E-5 is written 1.5e-05
        plain = F.concat(F.format_string("%.0f", c.cast("double")), F.lit(".0"))
        small = F.concat(F.regexp_replace(F.regexp_extract(s, r"^(.*)E", 1), r"\.0$", ""), F.lit("e-"), F.lpad(F.regexp_extract(s, r"E-(\d+)$", 1), 2, "0"))
        return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(s.contains("E-"), F.when(F.abs(c) >= 1e-4, F.regexp_replace(F.format_string("%.20f", c.cast("double")), "0+$", "")).otherwise(small)).when(s.contains("E") & (F.abs(c) < 1e16) & (c == F.floor(c)), plain).otherwise(s)
    return c.cast("string")


def cell_text(df: DataFrame, column: str, empty: str, quote: bool) -> Column:
    kind = dict(df.dtypes)[column]
    text = number_text(F.col(f"`{column}`"), kind)
    if quote and kind == "string":
        c = F.col(f"`{column}`")
        text = F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), c).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    return F.coalesce(text, F.lit(f'"{empty}"' if quote else empty))


def render_rows(df: DataFrame, fields: list[str], delim: str = ",", quote: bool = False, sort: str | None = None, empty: str = "NA", preamble: list[str] | None = None) -> DataFrame:
    """(line_no, line): preamble, header and rows. ``sort``: case-insensitive by a column's text; an unknown one is ignored.

    Row numbers come from the partitions' counts, so no task holds all rows.
    """
    spark = df.sparkSession
    lines = df.select(F.concat_ws(delim, *[cell_text(df, f, empty, quote) for f in fields]).alias("line"), *([F.lower(F.col(f"`{sort}`").cast("string")).alias("_s")] if sort in df.columns else []))
    if sort in df.columns:
        lines = lines.orderBy("_s", "line")
    head = [*(preamble or []), delim.join(f'"{f}"' if quote else f for f in fields)]
    body = number_rows(lines.select("line"), "line_no", len(head)).select("line_no", "line")
    return spark.createDataFrame(list(enumerate(head)), "line_no bigint, line string").unionByName(body)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, delim: str = ",", quote: bool = False, sort: str | None = None, empty: str = "NA", encoding: str = "UTF-8", sink: Callable[[DataFrame, str], None] | None = None) -> None:
    """Text files in order, the header first; ``sink`` writes the ordered lines in another way."""
    lines = render_rows(df, fields or df.columns, delim, quote, sort, empty).sort("line_no").select("line")
    if sink:
        sink(lines, path)
    else:
        lines.write.mode("overwrite").option("encoding", encoding).text(path)


def parse_text(text: str, delim: str = ",") -> list[list[str]]:
    """Small text on the driver."""
    return list(csv.reader(io.StringIO(text), delimiter=delim))
