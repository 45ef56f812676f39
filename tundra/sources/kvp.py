"""Key-value text: one ``key = value`` a line, with comments, quoted strings, numbers and lists.

Grammar of a line, by an own scanner: an identifier alone is a flag (true); after '=' comes a value, or several with the
equivalent separators ',', ';' and ':'. A lone identifier true, false or none is that constant. Blanks are allowed around '=',
before a comment and at the end only. Numbers with an exponent need a point. Empty quotes give no token.

Defined results: blank and comment lines have no key; ``x=''`` and ``x =`` are flags; a line that can't be read has an error
and no value; of repeated keys in a document the last line wins; null lines are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_DIGITS = frozenset("0123456789")
_NAMED = _LETTERS | _DIGITS
_BETWEEN = frozenset(",;:")
#: constants by their lower-case name
_CONSTANTS = {"none": None, "true": True, "false": False}


class Unreadable(ValueError):
    """A line that is no key and value; the message names it."""


class _Reader:
    """A place in a line; each method reads one thing and moves on."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.end = text, 0, len(text)

    def peek(self) -> str:
        return self.text[self.at] if self.at < self.end else ""

    def run(self, allowed: frozenset[str]) -> str:
        """The characters from here on that are allowed."""
        start = self.at
        while self.at < self.end and self.text[self.at] in allowed:
            self.at += 1
        return self.text[start : self.at]

    def blanks(self) -> bool:
        start = self.at
        while self.at < self.end and self.text[self.at].isspace():
            self.at += 1
        return self.at > start

    def fail(self) -> Unreadable:
        return Unreadable(f"Failed to read <{self.text}> at {self.at}")

    def quoted(self) -> str:
        """Text up to the same quote mark."""
        close = self.text.find(self.text[self.at], self.at + 1)
        if close < 0:
            raise self.fail()
        got, self.at = self.text[self.at + 1 : close], close + 1
        return got

    def number(self) -> int | float:
        """Sign and digits; with a point a real number, which may have an exponent."""
        start = self.at
        if self.peek() in ("+", "-"):
            self.at += 1
        digits = self.run(_DIGITS)
        if self.peek() != ".":
            if not digits or self.peek() in ("e", "E"):
                raise self.fail()
            return int(self.text[start : self.at])
        self.at += 1
        self.run(_DIGITS)
        if self.peek() in ("e", "E"):
            self.at += 1
            if self.peek() in ("+", "-"):
                self.at += 1
            self.run(_DIGITS)
        try:
            return float(self.text[start : self.at])
        except ValueError:
            raise self.fail() from None


def tokens(text: str) -> Iterator[tuple[str, object]]:
    """(kind, value): name, sep, eq, str, int, float, end. Raises Unreadable where no token starts."""
    r = _Reader(text)
    while r.at < r.end:
        start, gap = r.at, r.blanks()
        c = r.peek()
        if c in ("", "#"):
            yield "end", text[start:]
            return
        if c == "=":
            r.at += 1
            r.blanks()
            yield "eq", "="
        elif gap:
            r.at = start
            raise r.fail()
        elif c in _LETTERS:
            yield "name", r.run(_NAMED)
        elif c in _BETWEEN:
            r.at += 1
            yield "sep", c
        elif c in "'\"":
            if got := r.quoted():
                yield "str", got
        else:
            n = r.number()
            yield "int" if isinstance(n, int) else "float", n


def parse_line(text: str) -> tuple[str, object] | None:
    """(key, value) of one line, None for a line without one, or Unreadable."""
    text = text.rstrip("\r\n")
    said = [t for t in tokens(text) if t[0] != "end"]
    if not said:
        return None
    (first, key), mark, values = said[0], said[1:2], said[2:]
    lists = [kind == "sep" for kind, _ in values]
    if first != "name" or (mark and mark[0][0] != "eq") or any(kind == "eq" for kind, _ in values) or lists[:1] == [True] or lists[1:2] == [False]:
        raise Unreadable(f"Failed to parse <{text}>")
    if not values:
        return key, True
    if len(values) > 1:
        return key, [v for kind, v in values if kind != "sep"]
    kind, v = values[0]
    return key, _CONSTANTS.get(v.lower(), v) if kind == "name" else v


_ROW = "doc_id string, seq bigint, key string, kind string, value string, error string"


def _kind(v: object) -> str:
    return "null" if v is None else {bool: "bool", int: "int", float: "float", str: "str", list: "list"}[type(v)]


def parse_lines(lines: DataFrame, doc: str = "doc_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """(doc_id, seq, key, kind, value, error) of every line with a key or an error; ``value`` is JSON text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, s, text in zip(pdf["doc_id"], pdf["seq"], pdf["line"]):
                try:
                    if (got := parse_line(text)) is not None:
                        out.append((d, s, got[0], _kind(got[1]), json.dumps(got[1], ensure_ascii=False), None))
                except Unreadable as e:
                    out.append((d, s, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "key", "kind", "value", "error"])

    src = lines.select(F.col(doc).cast("string").alias("doc_id"), F.col(seq).cast("bigint").alias("seq"), F.col(line).alias("line")).filter("line IS NOT NULL")
    return src.mapInPandas(run, _ROW)


def parse_documents(lines: DataFrame, doc: str = "doc_id", seq: str = "seq", line: str = "line", strict: bool = True) -> DataFrame:
    """(doc_id, key, kind, value): each document's keys, the last line of a key winning. ``strict``: an unreadable line is an error."""
    rows = parse_lines(lines, doc, seq, line)
    if strict:
        rows = rows.withColumn("key", F.when(F.col("error").isNull(), F.col("key")).otherwise(F.raise_error(F.col("error")).cast("string")))
    return rows.filter("key IS NOT NULL").groupBy("doc_id", "key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("v")).select("doc_id", "key", "v.kind", "v.value")


def format_value(kind: F.Column, value: F.Column) -> F.Column:
    """The text of a value: strings in '"', or in "'" where they hold '"'; lists by their members."""
    quote = lambda s: F.when(s.contains('"'), F.concat(F.lit("'"), s, F.lit("'"))).otherwise(F.concat(F.lit('"'), s, F.lit('"')))
    item = lambda j: F.when(j.startswith('"'), quote(F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<string>")[0])).otherwise(j)
    members = F.from_json(value, "array<variant>")
    listed = F.array_join(F.transform(members, lambda v: item(F.to_json(v))), ",")
    const = F.when(value == "true", "True").when(value == "false", "False").otherwise("None")
    return F.when(kind == "list", listed).when(kind.isin("bool", "null"), const).otherwise(item(value))


def write_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, key, line) of parsed rows."""
    return rows.select("doc_id", "key", F.concat(F.col("key"), F.lit(" = "), format_value(F.col("kind"), F.col("value"))).alias("line"))
