"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_of(*cases: tuple[Column, Column | str], otherwise: Column | str | None = None) -> Column:
    """The value of the first case whose condition holds."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def idiv(n: Column, by: int) -> Column:
    return F.call_function("div", n.cast("long"), F.lit(by).cast("long"))
