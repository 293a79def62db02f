"""Rewriting text by spans: strategies, pseudonyms that are consistent within a document, splicing, and records without the text removed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.lets import let
from palimpsest.functions.textnorm import strip
from palimpsest.operators.overlap import by_start
from palimpsest.schema import NAIVE_TOKEN, PLACEHOLDERS, PSEUDONYM, RECORD, REMOVED, RETAINED, SPANS, UNHANDLED


def pseudonym(index: Column) -> Column:
    """0 -> PERSON_A, 25 -> PERSON_Z, 26 -> PERSON_AA, ...: letters as digits of a number without zero."""
    start = F.struct(index.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(
        a["n"] >= 0, F.struct((F.floor(a["n"] / 26) - 1).cast("long").alias("n"), F.concat(F.char(65 + a["n"] % 26), a["s"]).alias("s"))
    ).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda a: F.concat(F.lit("PERSON_"), a["s"]))


def strategy(entity_type: Column) -> Column:
    placeholder = entity_type.isin(*PLACEHOLDERS)
    return F.when(placeholder, F.lit(REMOVED)).when(entity_type == "PERSON", F.lit(PSEUDONYM)).when(entity_type == "LOCATION", F.lit(RETAINED)).otherwise(F.lit(UNHANDLED))


def name_key(text: Column) -> Column:
    return F.lower(strip(text))


def replaced(spans: Column) -> Column:
    """array<struct<s, replacement>> in order of start. Names are numbered by first appearance."""
    fixed = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))

    def with_names(ordered: Column) -> Column:
        people = F.filter(ordered, lambda s: s["entity_type"] == "PERSON")
        return let(
            F.array_distinct(F.transform(people, lambda s: name_key(s["text"]))),
            lambda keys: F.transform(
                ordered,
                lambda s: F.struct(
                    s.alias("s"),
                    F.when(s["entity_type"].isin(*PLACEHOLDERS), F.element_at(fixed, s["entity_type"]))
                    .when(s["entity_type"] == "PERSON", pseudonym(F.array_position(keys, name_key(s["text"])) - 1))
                    .otherwise(s["text"])
                    .alias("replacement"),
                ),
            ),
        )

    return let(by_start(spans), with_names)


def spliced(text: Column, parts: Column) -> Column:
    """text with each part's span replaced; parts in order of start and free of overlaps."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(parts, i - 1)["s"]["end"])
    pieces = F.transform(parts, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["s"]["start"] - before(i)), x["replacement"]))
    tail = F.coalesce(F.try_element_at(parts, F.lit(-1))["s"]["end"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, tail + 1, F.length(text)))


def records(parts: Column) -> Column:
    """What was done, without the text that it was done to."""
    return F.transform(
        parts,
        lambda x: F.struct(
            x["s"]["entity_type"].alias("entity_type"),
            x["s"]["start"].alias("start"),
            x["s"]["end"].alias("end"),
            (x["s"]["end"] - x["s"]["start"]).alias("original_length"),
            strategy(x["s"]["entity_type"]).alias("strategy"),
            x["replacement"].alias("replacement"),
            x["s"]["confidence"].alias("confidence"),
            x["s"]["detector"].alias("detector"),
        ),
    ).cast(f"array<{RECORD.simpleString()}>")


def redact(text: Column, spans: Column) -> Column:
    """struct<redacted, records> of a text and its resolved spans."""
    whole = let(replaced(spans), lambda parts: F.struct(spliced(text, parts).alias("redacted"), records(parts).alias("records")))
    nothing = F.struct(text.alias("redacted"), F.array().cast(f"array<{RECORD.simpleString()}>").alias("records"))
    return F.when(F.size(spans) > 0, whole).otherwise(nothing)


def naive_redact(text: Column, spans: Column) -> Column:
    """Every PERSON span becomes the same token; nothing is resolved."""
    people = by_start(F.filter(spans, lambda s: s["entity_type"] == "PERSON").cast(SPANS))
    parts = F.transform(people, lambda s: F.struct(s.alias("s"), F.lit(NAIVE_TOKEN).alias("replacement")))
    return let(parts, lambda p: spliced(text, p))
