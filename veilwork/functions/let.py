"""Bind an intermediate Column once so that later expressions can use it many times.

A multi-step text pass refers to the result of the step before it several
times.  Written as plain nested expressions that grows exponentially; written
as a chain of projections it is undone whenever the optimizer pushes a filter
through them.  A one-element ``transform`` binds the value to a lambda variable,
which is evaluated once per row and keeps the whole pass a single Column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters refer to without evaluating it again.

    A filter on a projected column is pushed below the projection, expression
    and all, even below a repartitioning.  A generated column stays put.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
