"""Reading text whatever its compression or encoding says."""

from __future__ import annotations

import fnmatch
import gzip
import locale
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP = b"\x1f\x8b"


def output_encoding(base: str | None = None) -> str:
    """The preferred encoding for output, in its usual spelling."""
    name = (base or locale.getpreferredencoding(False) or "utf-8").lower().replace("_", "-")
    return {"cp65001": "utf-8", "utf8": "utf-8", "ansi-x3.4-1968": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8"}.get(name, name)


def run_suffix() -> str:
    """A folder name suffix of the present time."""
    return datetime.now().strftime("%Y%m%d_%H%M%S_%f")


#: from this confidence on, bytes are decoded strictly
SURE = 0.9
# Byte order marks and their encodings.
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


#: the control characters of ISO 8859-1 that are characters in Windows-1252
_PLACES = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]
_C1, _C1_CP1252 = "".join(map(chr, _PLACES)), bytes(_PLACES).decode("cp1252")


def detect(data: bytes) -> tuple[str, float]:
    """(encoding, confidence): by mark, by every second byte being null, by valid UTF-8 sequences, else a Latin code page.

    Each valid UTF-8 sequence halves the doubt that they come by chance; of the code pages, Windows-1252 is as likely as its high bytes
    are letters and usual marks.
    """
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name, 1.0
    if data.isascii() and b"\x00" not in data:
        return "utf-8", 1.0
    for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        nulls, others = data[first::2].count(0), data[1 - first :: 2].count(0)
        if nulls > 0.6 * (len(data) / 2) and not others:
            return name, min(0.99, 2 * nulls / len(data))
    try:
        text = data.decode("utf-8")
        several = sum(c > "\x7f" for c in text)
        return "utf-8", 1 - 0.5 ** (several + 3)
    except UnicodeDecodeError:
        pass
    high = data.translate(None, bytes(range(128))).decode("cp1252", "replace")
    usual = sum(c.isalpha() or c in "–—‘’“”…€£°·«» " for c in high)
    return "cp1252", 0.95 * usual / len(high)


def decode(data: bytes, encoding: str | None = None) -> str:
    """Bytes as text: by a given encoding or the detected one, strictly if it is sure, otherwise with bad bytes replaced."""
    name, sure = (encoding, 0.0) if encoding else detect(data)
    try:
        return data.decode(name, "strict" if sure >= SURE else "replace").removeprefix("\ufeff")
    except UnicodeDecodeError:
        return data.decode(name, "replace").removeprefix("\ufeff")


def _heads(spark: SparkSession, source: str, glob: str | None, size: int = 4096) -> list[tuple[str, bytes]]:
    """(path, first bytes) of the files at a path; read by the driver, ``size`` bytes of each."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], list(fs.globStatus(path) or [])
    while todo:
        f = todo.pop()
        name = f.getPath().getName()
        if f.isDirectory():
            todo += [x for x in fs.listStatus(f.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        elif glob is None or fnmatch.fnmatch(name, glob):
            stream = fs.open(f.getPath())
            try:
                out.append((f.getPath().toString(), bytes(stream.readNBytes(size))))
            finally:
                stream.close()
    return sorted(out)


def split_lines(spark: SparkSession, source: str, encoding: str | None = None, glob: str | None = None) -> DataFrame:
    """(path, block, place, first, line): lines of files that Spark reads in splits, in order of path, block and place.

    Plain files in encodings where a line end is one byte are split; the rest (packed ones, UTF-16) are read whole by a task
    each. ``first``: the line opens its file.
    """
    found = _heads(spark, source, glob)
    whole = [p for p, head in found if head[:2] == GZIP or (encoding or detect(head)[0]).lower().startswith(("utf-16", "utf-32"))]
    rest = [p for p, _ in found if p not in set(whole)]
    parts = []
    if rest:
        raw = spark.read.text(rest).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
        if encoding and encoding.lower().replace("_", "-") not in ("utf-8", "utf8", "utf-8-sig"):
            text = F.pandas_udf(lambda v: v.map(lambda x: bytes(x).decode(encoding, "replace")), "string")(F.col("value").cast("binary"))
        else:  # bytes that are no UTF-8 are read as the Latin code page, line by line
            text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.translate(F.decode(F.col("value").cast("binary"), "iso-8859-1"), _C1, _C1_CP1252))
        least = raw.filter("block = 0").groupBy("path").agg(F.min("place").alias("top"))
        parts.append(raw.join(least, "path", "left").select("path", "block", "place", ((F.col("block") == 0) & (F.col("place") == F.col("top"))).alias("first"), text.alias("line")))
    if whole:
        got = read_lines(spark, whole, encoding)
        parts.append(got.select("path", F.lit(0).cast("bigint").alias("block"), F.col("line_no").alias("place"), (F.col("line_no") == 0).alias("first"), "line"))
    if not parts:
        return spark.createDataFrame([], "path string, block bigint, place bigint, first boolean, line string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_lines(spark: SparkSession, source: str | list[str] | DataFrame, encoding: str | None = None, glob: str | None = None) -> DataFrame:
    """(path, line_no, line) of files, gzipped or plain by content, not by name. A file is read by one task.

    For large plain files, ``split_lines`` deals them over tasks.
    """
    if isinstance(source, DataFrame):
        return source

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                data = bytes(data)
                text = decode(gzip.decompress(data) if data[:2] == GZIP else data, encoding)
                lines = text.splitlines()
                for at in range(0, len(lines), 100_000):
                    part = lines[at : at + 100_000]
                    yield pd.DataFrame({"path": path, "line_no": range(at, at + len(part)), "line": part})

    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(source).select(F.col("path"), "content").mapInPandas(run, "path string, line_no bigint, line string")
