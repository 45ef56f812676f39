"""A value computed once and used several times inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. Lambdas of array functions would otherwise compute ``value`` anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
