"""Rows that fail to parse: strict record parsing with a reason for every rejected record.

Lines are assembled to records by a machine that follows the quotes from field to field: a quote opens a field only at its
start. Where each line is a record of its own, a field that is still open at the line's end is a fault; where records may span lines
(``assemble``), it goes on in the next. Every record then goes through Python's strict csv reader inside ``mapInPandas``;
what the machine or the reader finds wrong is caught before the typed field constructors run.

Defined results
    lines without an id are left out; null or blank lines (also with a carriage return or byte order mark) and header lines give no row;
    ``reason`` is null for a good row, else the first that holds of 'quoting', 'columns', 'value';
    typed columns of a rejected row are null; repeated lines give repeated rows; an empty table gives none;
    other columns of the input are ignored, so names may clash.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The columns of the equipment list, in order.
COLUMNS = [
    "Make", "Model", "DisplayName", "Year", "Energy", "Category", "Technology", "BaseCost", "BaseCostCur", "BaseCostYear",
    "PowerRate", "PowerRateUnits", "NoPowerHoldoverDays", "freezer", "cooler", "roomtemperature", "Name", "ClassName", "chain",
    "ColdLifetime", "AlarmDays", "SnoozeDays", "Notes",
]
INTEGER = {"BaseCostYear": "int", "roomtemperature": "bigint"}
NUMERIC = ["BaseCost", "BaseCostYear", "PowerRate", "NoPowerHoldoverDays", "freezer", "cooler", "roomtemperature", "ColdLifetime", "AlarmDays", "SnoozeDays"]
YEARS = ["BaseCostYear"]
REQUIRED = ["Name"]
CLEAN_TEXT = ["Model", "Notes"]

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?%?")
_SPACED_PERCENT = re.compile(r"\s+%$")
_YEAR = re.compile(r"[0-9]+")
_DIRTY = re.compile("[\x00-\x1f\ufffd]")
csv.field_size_limit(2**31 - 1)


class Structure(ValueError):
    """A record whose structure can't be read; the message is the reason."""


OPEN, CLOSED, FAULT = "open", "closed", "fault"


def follow(line: str, inside: bool = False) -> str:
    """How a line leaves the machine that begins at a field's start or inside a quoted field: OPEN, CLOSED or FAULT."""
    at, end = 0, len(line)
    while True:
        if not inside and not line.startswith('"', at):  # a bare field ends at the next comma
            stop = line.find(",", at)
            stop = end if stop < 0 else stop
            if line.find('"', at, stop) >= 0:
                return FAULT
        else:
            close = at if inside else at + 1
            while (close := line.find('"', close)) >= 0 and line.startswith('"', close + 1):
                close += 2
            if close < 0:
                return OPEN
            stop, inside = close + 1, False
            if stop < end and line[stop] != ",":
                return FAULT
        if stop >= end:
            return CLOSED
        at = stop + 1


def split_record(text: str) -> list[str]:
    """The fields of one assembled record by the strict csv reader, or Structure('quoting').

    Line breaks are text here, which the reader would take for a record's end, so they go in as two characters that the text lacks.
    """
    if follow(text) != CLOSED:
        raise Structure("quoting")
    breaks = "\n" in text or "\r" in text
    if breaks:
        feed, ret = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text), None
        feed, ret = next(feed), next(feed)
        text = text.replace("\n", feed).replace("\r", ret)
    try:
        (fields,) = csv.reader([text], strict=True) if text else [[""]]
    except (csv.Error, ValueError):
        raise Structure("quoting") from None
    return [f.replace(feed, "\n").replace(ret, "\r") for f in fields] if breaks else fields


def typed(column: str, text: str) -> float | int | str | None:
    """The typed value of one field, or ValueError. Blank number fields are null; percentages are fractions."""
    if column not in NUMERIC:
        return text
    t = text.strip()
    if not t:
        return None
    if column in YEARS:
        if not _YEAR.fullmatch(t):
            raise ValueError(column)
        return int(t)
    t = _SPACED_PERCENT.sub("%", t)
    if not _NUMBER.fullmatch(t):
        raise ValueError(column)
    value = 0.01 * float(t[:-1]) if t[-1] == "%" else float(t)
    return int(value) if column in INTEGER and abs(value) < 2**63 else value


_HEADER = [c.lower() for c in COLUMNS]
_CHECKED = [(i, c) for i, c in enumerate(COLUMNS) if c in NUMERIC]
_NAMED = [COLUMNS.index(c) for c in REQUIRED]
_TEXTS = [COLUMNS.index(c) for c in CLEAN_TEXT]


def parse_line(line: str | None) -> tuple[list | None, str | None] | None:
    """(typed fields, None), (None, reason), or None for a line that is no record."""
    if line is None:
        return None
    if line.endswith("\r"):
        line = line[:-1]
    bare = line[1:] if line.startswith("\ufeff") else line
    if not bare.strip():
        return None
    try:
        if bare is not line:
            try:
                if [f.strip().lower() for f in split_record(bare)] == _HEADER:
                    return None
            except Structure:
                pass
        fields = split_record(line)
    except Structure as e:
        return None, str(e)
    if len(fields) != len(COLUMNS):
        return None, "columns"
    if fields[0].strip().lower() == _HEADER[0] and [f.strip().lower() for f in fields] == _HEADER:
        return None
    if any(not fields[i].strip() for i in _NAMED) or any(_DIRTY.search(fields[i]) for i in _TEXTS):
        return None, "value"
    try:
        for i, c in _CHECKED:
            fields[i] = typed(c, fields[i])
    except ValueError:
        return None, "value"
    return fields, None


def _ddl(column: str) -> str:
    return f"`{column}` " + (INTEGER.get(column, "double") if column in NUMERIC else "string")


SCHEMA = "line_id bigint, reason string, " + ", ".join(map(_ddl, COLUMNS))


def _fitting(values: list, column: str) -> pd.Series:
    kind = INTEGER.get(column)
    if column not in NUMERIC:
        return pd.Series(values, dtype=object)
    if kind is None:
        return pd.Series(values, dtype="float64")
    top = 2**31 if kind == "int" else 2**63
    return pd.Series([v if v is not None and -top <= v < top else None for v in values], dtype="Int64")


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    blank = [None] * len(COLUMNS)
    for pdf in batches:
        ids, reasons, rows = [], [], []
        for i, line in zip(pdf["line_id"], pdf["line"]):
            if (got := parse_line(line)) is not None:
                ids.append(i)
                rows.append(got[0] or blank)
                reasons.append(got[1])
        cols = list(zip(*rows)) if rows else [[] for _ in COLUMNS]
        yield pd.DataFrame({"line_id": pd.Series(ids, dtype="int64"), "reason": pd.Series(reasons, dtype=object), **{c: _fitting(v, c) for c, v in zip(COLUMNS, cols)}})


def parse_records(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """Every record of ``lines`` as typed columns plus ``reason`` (null: loaded)."""
    return lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(line_col).cast("string").alias("line")).filter("line_id IS NOT NULL").mapInPandas(_parse_batches, SCHEMA)


def _reason_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [(i, r[1]) for i, line in zip(pdf["line_id"], pdf["line"]) if (r := parse_line(line)) is not None and r[1]]
        yield pd.DataFrame({"line_id": pd.Series([g[0] for g in got], dtype="int64"), "reason": pd.Series([g[1] for g in got], dtype=object)})


def rejected(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """Only the rejected lines with their reason; the same parser, without building the typed columns."""
    return lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(line_col).cast("string").alias("line")).filter("line_id IS NOT NULL").mapInPandas(_reason_batches, "line_id bigint, reason string")


def loaded(lines: DataFrame, **cols: str) -> DataFrame:
    """The good rows, typed."""
    return parse_records(lines, **cols).filter("reason IS NULL").drop("reason")


#: lines of a file whose neighbours are looked for in one window
SLICE = 100_000


def _line_states(width: int):
    def states(lines: pd.Series) -> pd.DataFrame:
        outside, inside, whole = [], [], []
        for t in lines:
            outside.append(follow(t))
            inside.append(follow(t, True))
            whole.append(outside[-1] == CLOSED and len(split_record(t)) == width)
        return pd.DataFrame({"whole": whole, "opens": [x == OPEN for x in outside], "inside": inside})

    return F.pandas_udf(states, "whole boolean, opens boolean, inside string")


def _join_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of lines in order; only the lines of one record are held, which is known to close."""
    held: list[str] = []
    first = until = None
    for pdf in batches:
        out: list[tuple] = []
        for file, o, line, last in zip(pdf["file"], pdf["o"], pdf["line"], pdf["until"]):
            if held:
                held.append(line)
                if (file, o) == until:
                    out.append((*first, len(held), "\n".join(held)))
                    held = []
            elif pd.notna(last):
                held, first, until = [line], (file, o), (file, int(last))
            else:
                out.append((file, o, 1, line))
        yield pd.DataFrame(out, columns=["file", "o", "n", "record"])


def assemble(lines: DataFrame, file_col: str, order_col: str, line_col: str, width: int = len(COLUMNS)) -> DataFrame:
    """(file, first line's order, n_lines, record): lines joined to records where a quoted field stays open over line ends.

    For inputs whose records may span lines; ``parse_records`` takes its result as lines. A line that opens a field goes on up to the
    line that closes it, however far. A line that is a sound record of ``width`` fields by itself always stands alone, so a stray
    quote spoils its own line only: where such a line comes before the close, or the quote never closes soundly, the opening line comes out alone.

    For each line the next one that leaves the quotes and the next whole one are found in windows over slices, with what later slices
    begin with handed back; the records are then joined in a stream that holds one record.
    """
    src = lines.select(F.col(file_col).alias("file"), F.col(order_col).cast("bigint").alias("o"), F.coalesce(F.col(line_col), F.lit("")).alias("line"))
    src = src.withColumn("x", _line_states(width)(F.col("line"))).withColumn("s", F.floor(F.col("o") / SLICE))
    leaves = F.when(F.col("x.inside") != OPEN, F.struct(F.col("o").alias("o"), (F.col("x.inside") == CLOSED).alias("closed")))
    whole = F.when(F.col("x.whole"), F.col("o"))
    later = Window.partitionBy("file").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("file").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = src.groupBy("file", "s").agg(F.min(leaves).alias("leave"), F.min(whole).alias("whole"), F.max(whole).alias("last"))
    per = per.select("file", "s", F.last("leave", True).over(later).alias("leave_after"), F.min("whole").over(later).alias("whole_after"), F.last(F.when(F.col("last").isNotNull(), F.col("s")), True).over(so_far).alias("before"))
    after = Window.partitionBy("file", "s").orderBy("o", "line").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy("file", "s").orderBy("o", "line").rowsBetween(Window.unboundedPreceding, 0)
    seen = src.withColumn("leave", F.first(leaves, True).over(after)).withColumn("next", F.first(whole, True).over(after)).withColumn("led", F.count(whole).over(upto) > 0)
    all_ = seen.join(per, ["file", "s"]).withColumn("leave", F.coalesce("leave", "leave_after")).withColumn("next", F.coalesce("next", "whole_after"))
    closes = F.col("x.opens") & F.col("leave.closed") & (F.col("next").isNull() | (F.col("next") > F.col("leave.o")))
    # a stream begins at a whole line, which no record spans
    keyed = all_.select("file", F.when(F.col("led"), F.col("s")).otherwise(F.coalesce("before", F.lit(-1))).alias("key"), "o", "line", F.when(closes, F.col("leave.o")).alias("until"))
    joined = keyed.repartition("file", "key").sortWithinPartitions("file", "key", "o", "line").mapInPandas(_join_lines, f"file {dict(lines.dtypes)[file_col]}, o bigint, n int, record string")
    return joined.select(F.col("file").alias(file_col), F.col("o").alias(order_col), F.col("n").alias("n_lines"), F.col("record").alias(line_col))
