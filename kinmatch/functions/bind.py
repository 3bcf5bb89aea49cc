"""Compute a value once and use it in several places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    A repeated subexpression under a condition or in a lambda is otherwise
    evaluated at every place it occurs.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later steps read instead of computing again.

    A filter on a computed column is normally moved below it, and the column then
    computed for the filter and for the output.  A filter is not moved below a
    generator, so the value comes from one that makes one row per row.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
