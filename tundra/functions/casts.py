"""Cast chains: each cast is a pair of Columns (succeeded, value); the first that succeeds gives the result.

A successful null stops a chain, so chains are CASE expressions and not coalesce. All casts are JVM expressions that never
fail a job unless the chain ends in ``strict``. Text that Spark alone would read as a number ('1.0d', '0x1p3') is gated out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"^(?i)\s*[+-]?(nan|inf|infinity)\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def float_value(s: Column) -> Column:
    """Text as a double, null if it isn't one; 'nan' and 'inf' are numbers."""
    t = F.lower(F.trim(s))
    special = (
        F.when(t.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    )
    return F.when(s.rlike(_FLOAT), F.trim(s).try_cast("double")).otherwise(special)


def int_value(s: Column) -> Column:
    """Text of digits as a BIGINT; null beyond its range or if it isn't one."""
    return F.when(s.rlike(_INT), F.regexp_replace(F.trim(s), r"^\+", "").try_cast("bigint"))


@dataclass(frozen=True)
class Cast:
    """One cast: ``ok`` and ``value`` as functions of the text column; ``kind`` is the value's type."""

    ok: Callable[[Column], Column]
    value: Callable[[Column], Column]
    kind: str


def _whole(s: Column) -> Column:
    return int_value(s)


def _boolean(s: Column) -> Column:
    t = F.lower(F.trim(s))
    n = float_value(s)
    return (
        F.when(s.isNull(), 0).when(t.isin("t", "true"), 1).when(t.isin("f", "false"), 0).when(n.isNotNull(), F.when(n == 0, 0).otherwise(1)).when(s == "", 0).otherwise(1)
    )


def _yes(_: Column) -> Column:
    return F.lit(True)


#: the casts by name
CASTS: dict[str, Cast] = {
    "INT": Cast(lambda s: _whole(s).isNotNull(), _whole, "bigint"),
    "LONG": Cast(lambda s: s.rlike(_INT) & F.trim(s).try_cast("decimal(38,0)").isNotNull(), lambda s: F.when(s.rlike(_INT), F.trim(s).try_cast("decimal(38,0)")), "decimal(38,0)"),
    "FLOAT": Cast(lambda s: float_value(s).isNotNull(), float_value, "double"),
    "STRING": Cast(lambda s: s.isNotNull(), lambda s: s, "string"),
    "EMPTY": Cast(lambda s: s.isNull(), lambda s: F.lit(None).cast("string"), "string"),
    "NA": Cast(lambda s: s.eqNullSafe("NA"), lambda s: F.lit("NA"), "string"),
    "NONNEGATIVE_INT": Cast(lambda s: F.coalesce(_whole(s) >= 0, F.lit(False)), _whole, "bigint"),
    "POSITIVE_INT": Cast(lambda s: F.coalesce(_whole(s) >= 1, F.lit(False)), _whole, "bigint"),
    "EMPTY_IS_NULL_STRING": Cast(lambda s: F.coalesce(s, F.lit("")) == "", lambda s: F.lit(""), "string"),
    "EMPTY_IS_ZERO": Cast(lambda s: F.coalesce(s, F.lit("")) == "", lambda s: F.lit(0), "bigint"),
    "EMPTY_IS_NONE": Cast(lambda s: F.coalesce(s, F.lit("")) == "", lambda s: F.lit(None).cast("string"), "string"),
    "BOOLEAN": Cast(_yes, _boolean, "int"),
}


def register(name: str, ok: Callable[[Column], Column], value: Callable[[Column], Column], kind: str) -> None:
    """A cast of one's own, by Column functions (a pandas UDF gives a Column too)."""
    CASTS[name] = Cast(ok, value, kind)


_WIDER = ["int", "bigint", "decimal(38,0)", "double", "string"]


def common_kind(kinds: list[str]) -> str:
    """The type that holds all values of a chain."""
    return max(kinds, key=_WIDER.index)


def cast_value(s: Column, chain: list[str], strict: bool = True, context: Column | None = None) -> Column:
    """The first cast that succeeds. ``strict``: else an error that names the value and the context; otherwise null."""
    casts = [CASTS[c] for c in chain]
    nulls = {"EMPTY", "EMPTY_IS_NONE"}
    kind = common_kind([c.kind for n, c in zip(chain, casts) if n not in nulls] or ["string"])
    out: Column | None = None
    for c in casts:
        ok, v = c.ok(s), c.value(s).cast(kind)
        out = F.when(ok, v) if out is None else out.when(ok, v)
    if strict:
        text = F.concat(F.lit("cannot cast <"), F.coalesce(s, F.lit("NULL")), F.lit("> by " + ",".join(chain)), *([context] if context is not None else []))
        return out.otherwise(F.raise_error(text).cast(kind))
    return out.otherwise(F.lit(None).cast(kind))


def cast_ok(s: Column, chain: list[str]) -> Column:
    """Whether any cast of the chain succeeds."""
    ok = F.lit(False)
    for c in chain:
        ok = ok | F.coalesce(CASTS[c].ok(s), F.lit(False))
    return ok


def cast_column(df: DataFrame, column: str, chain: list[str], line: str | None = None, source: str = "", strict: bool = True) -> DataFrame:
    """The column cast by a chain; errors carry value, column, line and source."""
    where = F.concat(F.lit(f" in column {column}"), *([F.lit(", line "), F.col(line).cast("string")] if line else []), F.lit(f" of {source}" if source else ""))
    return df.withColumn(column, cast_value(F.col(column).cast("string"), chain, strict, where))


def get_float(*cells: Column) -> Column:
    """The first present cell as a double; text that is no number is an error."""
    first = F.coalesce(*[c.cast("string") for c in cells])
    return F.when(first.isNull(), F.lit(None).cast("double")).otherwise(cast_value(first, ["FLOAT"]))


def safe_float(cells: list[Column], default: float | None, ignore: str | None = None) -> Column:
    """The first present cell as a double, else the default.

    With ``ignore``, cells equal to it are passed over, of several cells '' too, and a bad number is an error; without
    it a bad number gives the default.
    """
    texts = [c.cast("string") for c in cells]
    if ignore is not None:
        skip = [ignore, ""] if len(texts) > 1 else [ignore]
        texts = [F.when(~t.isin(skip), t) for t in texts]
    first = F.coalesce(*texts) if len(texts) > 1 else texts[0]
    n = float_value(first)
    if ignore is None:
        return F.coalesce(n, F.lit(default).cast("double"))
    return F.when(first.isNull(), F.lit(default).cast("double")).otherwise(cast_value(first, ["FLOAT"]))


def percent(s: Column) -> Column:
    """'12%' as 0.12; other text null."""
    return F.when(s.endswith("%"), F.lit(0.01) * float_value(F.regexp_replace(s, "%$", "")))


def listify(v: Column, is_array: bool = False, keep_null: bool = False) -> Column:
    """A scalar as an array of one; null as an empty array unless kept."""
    if is_array:
        return v
    return F.array(v) if keep_null else F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.array(v.cast("string")))


def listify_column(df: DataFrame, column: str, keep_null: bool = False) -> Column:
    """``listify`` by the column's own type."""
    return listify(F.col(column), dict(df.dtypes)[column].startswith("array"), keep_null)


#: codecs tried on bytes, in this order
TEXT_CODECS = ("utf-8", "cp1252", "latin-1")


def decode_bytes(data: Column, codecs: tuple[str, ...] = TEXT_CODECS, hint: str | None = None) -> Column:
    """Bytes as text by the first codec that reads them without an error, the hint's first; null if none does."""
    tried = (*([hint] if hint else []), *codecs)

    def one(b: bytes | None) -> str | None:
        for c in tried if b is not None else ():
            try:
                return bytes(b).decode(c)
            except UnicodeDecodeError:
                continue
        return None

    return F.pandas_udf(lambda s: s.map(one).astype(object), "string")(data)
