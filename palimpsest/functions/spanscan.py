"""All matches of a pattern with their offsets, without leaving the JVM.

Spark has no such function, but the matches and the gaps between them come from two functions that walk the same matches:
regexp_extract_all and split. A match starts after all gaps up to its own and all matches before it. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.lets import empty, let
from palimpsest.schema import SPANS


def span(entity_type: Column, start: Column, end: Column, text: Column, confidence: Column, detector: Column) -> Column:
    """A span; one that breaks the invariants raises when it is checked by `checked`."""
    return F.struct(entity_type.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), confidence.cast("double").alias("confidence"), detector.alias("detector"))


def _ends(matches: Column, gaps: Column) -> Column:
    """[0, end of the first match, ...]."""
    sizes = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.length(m) + F.length(g))
    return F.aggregate(sizes, F.array(F.lit(0)).cast("array<int>"), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)).cast("array<int>"))


def scan(text: Column, pattern: str, guard: Column, entity_type: str, confidence: float, detector: str) -> Column:
    """Spans of all matches. pattern must not match the empty string; guard: a cheap condition that every text with a match meets."""
    nothing = empty(SPANS)

    def placed(found: Column) -> Column:
        return let(
            F.split(text, pattern, -1),
            lambda gaps: let(
                _ends(found, gaps),
                lambda ends: F.transform(found, lambda m, i: span(F.lit(entity_type), F.get(ends, i) + F.length(F.get(gaps, i)), F.get(ends, i + 1), m, F.lit(confidence), F.lit(detector))),
            ),
        ).cast(SPANS)

    found = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(nothing))


def checked(spans: Column) -> Column:
    """The same spans; raises on a negative start, an end not after it, or a confidence outside 0 to 1."""
    bad = F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["confidence"] < 0) | (s["confidence"] > 1))
    return F.when(bad, F.raise_error(F.lit("a span breaks 0 <= start < end or 0 <= confidence <= 1")).cast(SPANS)).otherwise(spans)
