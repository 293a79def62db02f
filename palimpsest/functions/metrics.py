"""Precision, recall and F1 from counts, null where a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp.cast("double"), (tp + fp).cast("double"))


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp.cast("double"), (tp + fn).cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.try_divide(2 * p * r, p + r)


def shown(x: Column) -> Column:
    """Three decimals, `-` for null."""
    return F.when(x.isNull(), F.lit("-")).otherwise(F.format_string("%.3f", x))
