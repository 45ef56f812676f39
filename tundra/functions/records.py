"""Enumerations, typed records and maps with computed defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Enum:
    """Names numbered from 0, or with given numbers, as map literals in both directions."""

    def __init__(self, *names: str, **named: int) -> None:
        self.numbers = {**{n: i for i, n in enumerate(names)}, **named}

    def number(self, name: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in self.numbers.items() for x in kv]), name)

    def name(self, number: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for n, i in self.numbers.items() for x in (i, n)]), number.cast("int"))


def record(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def record_text(type_name: str, rec: Column, kinds: dict[str, Enum | str]) -> Column:
    """Type(field=value, ...): enumerations by name, text in quotes. ``kinds``: Enum, 'string' or any other type name."""
    parts = []
    for n, k in kinds.items():
        v = k.name(rec[n]) if isinstance(k, Enum) else F.concat(F.lit("'"), rec[n], F.lit("'")) if k == "string" else rec[n].cast("string")
        parts.append(F.concat(F.lit(f"{n}="), v))
    return F.concat(F.lit(f"{type_name}("), F.concat_ws(", ", *parts), F.lit(")"))


def with_default(m: Column, key: Column, keygen: Callable[[Column], Column]) -> Column:
    """The value of a key, or what ``keygen`` makes of the key; the map is not changed."""
    return F.coalesce(F.try_element_at(m, key), keygen(key))
