"""Rows of numbers packed as little-endian 32-bit floats, with or without their column names.

Layout with names: a 4-byte count of names, each name as a 4-byte length and UTF-8 bytes, then the rows. Packing
loses precision to 32 bits on purpose. Null or empty input gives empty bytes or no rows; bytes that don't fill whole rows are
an error.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_rows(rows) -> bytes:
    return b"" if rows is None or not len(rows) else np.array([list(r) for r in rows], dtype="<f4").tobytes()


def header(names: list[str]) -> bytes:
    out = struct.pack("<i", len(names))
    for n in names:
        b = n.encode("utf-8")
        out += struct.pack("<i", len(b)) + b
    return out


def unpack_rows(data: bytes | None, width: int) -> list[list[float]]:
    got = np.frombuffer(data or b"", dtype="<f4")
    if len(got) % width:
        raise ValueError("the bytes don't fill whole rows")
    return got.reshape(-1, width).tolist()


def unpack_header(data: bytes) -> tuple[list[str], bytes]:
    (n,), at, names = struct.unpack_from("<i", data), 4, []
    for _ in range(n):
        (k,) = struct.unpack_from("<i", data, at)
        names.append(data[at + 4 : at + 4 + k].decode("utf-8"))
        at += 4 + k
    return names, data[at:]


def pack(rows: Column) -> Column:
    """ARRAY<ARRAY<DOUBLE>> as bytes."""
    return F.pandas_udf(lambda s: pd.Series([pack_rows(r) for r in s]), "binary")(rows)


def pack_named(rows: Column, names: list[str]) -> Column:
    h = header(names)
    return F.pandas_udf(lambda s: pd.Series([h + pack_rows(r) for r in s]), "binary")(rows)


def unpack(data: Column, width: int) -> Column:
    return F.pandas_udf(lambda s: pd.Series([unpack_rows(b, width) for b in s]), "array<array<float>>")(data)


def unpack_named(data: Column) -> Column:
    """(names, rows)."""

    def run(s: pd.Series) -> pd.DataFrame:
        got = [unpack_header(bytes(b)) for b in s]
        return pd.DataFrame({"names": [n for n, _ in got], "rows": [unpack_rows(b, len(n)) for n, b in got]})

    return F.pandas_udf(run, "names array<string>, rows array<array<float>>")(data)
