"""Column -> Column functions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it several times in `body`.

    Column expressions are trees, so naming an intermediate result by reuse would copy its whole
    subtree at each mention; a one-element `transform` evaluates it once.
    """
    return F.transform(F.array(value), body)[0]


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
