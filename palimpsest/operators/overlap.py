"""Resolving overlapping spans by precedence: structured before recognised, then confidence, length, start, and order of detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.lets import empty
from palimpsest.schema import SPANS, STRUCTURED


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_priority(spans: Column) -> Column:
    """Structs led by the sort key, most preferred first; the span itself is `s`."""

    def key(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(s["entity_type"].isin(*STRUCTURED), 0).otherwise(1).alias("tier"),
            (-s["confidence"]).alias("c"),
            (s["start"] - s["end"]).alias("n"),
            s["start"].alias("at"),
            i.alias("ord"),
            s.alias("s"),
        )

    return F.array_sort(F.transform(spans, key))


def by_start(spans: Column) -> Column:
    """Stably ordered by start."""
    return F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("at"), i.alias("ord"), s.alias("s")))), lambda x: x["s"])


def resolve(spans: Column) -> Column:
    """Accept spans in order of priority, each if it overlaps none accepted before; the result is ordered by start and free of overlaps."""
    accepted = F.aggregate(
        by_priority(spans),
        empty(SPANS),
        lambda taken, x: F.when(F.exists(taken, lambda a: overlaps(a, x["s"])), taken).otherwise(F.array_append(taken, x["s"])).cast(SPANS),
    )
    return F.when(F.size(spans) < 2, spans).otherwise(by_start(accepted)).cast(SPANS)
