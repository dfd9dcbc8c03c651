"""The aggregate functions of the query surface whose rules differ from Spark's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(column: Column) -> Column:
    """Sum as a real number, 0.0 over no rows."""
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def _any_null(columns: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a | b, [column.isNull() for column in columns])


def scalar_max(*columns: Column) -> Column:
    """Greatest argument, NULL when any argument is NULL."""
    return F.when(~_any_null(columns), F.greatest(*columns))


def scalar_min(*columns: Column) -> Column:
    """Least argument, NULL when any argument is NULL."""
    return F.when(~_any_null(columns), F.least(*columns))
