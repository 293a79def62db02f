"""Small tools for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(kind: DataType) -> Column:
    """An empty array of an array type."""
    return F.array().cast(kind)


def exploded(df: DataFrame, array: Column, name: str, *kept: str) -> DataFrame:
    """Columns `kept` and a row for each element of an array without nulls.

    A plain explode lets the optimizer add a filter on the array's size below it, which computes a costly array twice.
    """
    return df.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
