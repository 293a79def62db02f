"""Building labelled sets: offsets from the texts of spans, checks, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.lets import exploded, let
from palimpsest.operators.detectors import AadhaarDetector, Detector, EmailDetector, GazetteerDetector, PanDetector, PhoneDetector
from palimpsest.schema import GOLD_ENTITY, STRUCTURED


def located(text: Column, entities: Column) -> Column:
    """entities array<struct<type, text>> in reading order -> array<struct<type, start, end, text>>. Each is sought after the end of the one before; a missing one raises."""
    kind = f"struct<cursor:int,out:array<{GOLD_ENTITY.simpleString()}>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array().alias("out")).cast(kind)

    def step(acc: Column, e: Column) -> Column:
        at = F.call_function("locate", e["text"], text, acc["cursor"] + 1)
        found = F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("not found: "), e["text"])).cast("int"))
        end = found + F.length(e["text"])
        one = F.struct(e["type"].alias("type"), found.alias("start"), end.alias("end"), e["text"].alias("text"))
        return F.struct(end.alias("cursor"), F.array_append(acc["out"], one).alias("out")).cast(kind)

    return F.aggregate(entities, start, step, lambda acc: acc["out"])


def build(cases: DataFrame, position: str = "position", unique: bool = True) -> DataFrame:
    """cases(position 0.., category, text, entities of type and text) -> the labelled set: id is the position in four digits at least.

    Ids must differ: a repeated one raises. unique=False leaves that out, and with it the shuffle that it takes; `repeated_ids` tells them.
    """
    number = F.col(position).cast("string")
    name = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    out = cases.select(name.alias("id"), "category", "text", located(F.col("text"), F.col("entities")).alias("entities"))
    if not unique:
        return out
    times = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return out.withColumn("id", F.when(times == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), F.coalesce("id", F.lit("null")))).cast("string")))


def repeated_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("id").count().where("count > 1")


def overlapping(cases: DataFrame) -> DataFrame:
    """(id, start, previous_end) of gold spans that start before the one before them ends."""
    spans = cases.select("id", F.explode("entities").alias("e")).select("id", "e.start", "e.end")
    before = F.lag("end").over(Window.partitionBy("id").orderBy("start", "end"))
    return spans.withColumn("previous_end", before).where(F.col("start") < F.col("previous_end")).select("id", "start", "previous_end")


def summary(cases: DataFrame) -> DataFrame:
    """(kind, name, n): cases by category and spans by type."""
    by_category = cases.groupBy("category").count().select(F.lit("category").alias("kind"), F.col("category").alias("name"), F.col("count").alias("n"))
    spans = cases.select(F.explode("entities.type").alias("type")).groupBy("type").count()
    return by_category.unionByName(spans.select(F.lit("type").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n")))


def without_hit(cases: DataFrame, recogniser: Detector | None = None) -> DataFrame:
    """(id, type, text) of gold spans whose text their own detector doesn't find: names and places in any span of the recogniser."""
    text = F.col("text")
    own: Sequence[Detector] = (EmailDetector(), PhoneDetector(), PanDetector(), AadhaarDetector())
    texts = lambda d: F.transform(d.spans(text), lambda s: s["text"])
    hits = F.create_map(*(x for d in own for x in (F.lit(d.entity_type), texts(d))))

    def missed(found: Column) -> Column:
        def gone(e: Column) -> Column:
            known = F.when(e["type"].isin(*STRUCTURED), F.array_contains(F.element_at(found["hits"], e["type"]), e["text"])).when(e["type"].isin("PERSON", "LOCATION"), F.array_contains(found["names"], e["text"]))
            return F.coalesce(~known, F.lit(False))

        return F.filter("entities", gone)

    found = F.struct(hits.alias("hits"), texts(recogniser or GazetteerDetector()).alias("names"))
    return exploded(cases, let(found, missed), "e", "id").select("id", "e.type", "e.text")
