"""The document pipeline: normalise, detect, resolve, redact. One narrow stage; no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.lets import exploded
from palimpsest.functions.textnorm import normalise
from palimpsest.operators.detectors import AadhaarDetector, Detector, NaiveAadhaarDetector, detect
from palimpsest.operators.overlap import resolve
from palimpsest.operators.redaction import redact
from palimpsest.sources.audit import write_audit_log


def spread_out(docs: DataFrame) -> DataFrame:
    """docs over all cores, if its files give fewer partitions than there are cores. Best before long texts are read or derived, as all columns move."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


def detected(docs: DataFrame, text: str = "text", detectors: Sequence[Detector] | None = None, unicode: bool = True) -> DataFrame:
    """docs plus normalised (string), raw_spans and spans (resolved)."""
    out = docs.withColumn("normalised", normalise(F.col(text), unicode))
    out = out.withColumn("raw_spans", F.coalesce(detect(F.col("normalised"), detectors), F.array().cast("array<struct<entity_type:string,start:int,end:int,text:string,confidence:double,detector:string>>")))
    return out.withColumn("spans", resolve(F.col("raw_spans")))


def redact_documents(docs: DataFrame, text: str = "text", detectors: Sequence[Detector] | None = None, unicode: bool = True) -> DataFrame:
    """docs plus normalised, spans, redacted and records. Null text stays null and has no spans; an empty list of detectors finds nothing."""
    out = detected(docs, text, detectors, unicode).drop("raw_spans").withColumn("__done", redact(F.col("normalised"), F.col("spans")))
    return out.withColumns({"redacted": F.col("__done.redacted"), "records": F.col("__done.records")}).drop("__done")


def audit_entries(redacted: DataFrame, document_id: str | None = None) -> DataFrame:
    """One row a record of `redact_documents`, with document_id only if a column for it is named."""
    named = redacted.select(*([F.col(document_id).cast("string").alias("document_id")] if document_id else []), "records")
    rows = exploded(named, F.col("records"), "record", *(["document_id"] if document_id else []))
    return rows.select("record.*", *(["document_id"] if document_id else []))


def redact_to_log(docs: DataFrame, path: str, document_id: str | None = None, text: str = "text", detectors: Sequence[Detector] | None = None, append: bool = True) -> DataFrame:
    """`redact_documents`, after its audit entries have been written. The frame returned is computed anew when it is used."""
    done = redact_documents(docs, text, detectors)
    write_audit_log(audit_entries(done, document_id), path, append)
    return done


def redact_document(spark: SparkSession, text: str, detectors: Sequence[Detector] | None = None, audit_log_path: str | None = None, document_id: str | None = None) -> tuple[str, list[dict]]:
    """One document: (redacted text, records), logged if a path is given."""
    docs = spark.createDataFrame([(document_id, text)], "document_id string, text string")
    done = redact_to_log(docs, audit_log_path, "document_id" if document_id is not None else None, detectors=detectors) if audit_log_path else redact_documents(docs, detectors=detectors)
    row = done.select("redacted", "records").first()
    return row["redacted"], [r.asDict() for r in row["records"]]


def for_evaluation(cases: DataFrame, detectors: Sequence[Detector] | None = None) -> DataFrame:
    """Labelled cases plus predicted spans. Raises where normalising would change a text, as its gold offsets would no longer hold."""
    out = detected(cases, "text", detectors)
    same = F.when(F.col("normalised") == F.col("text"), F.col("spans")).otherwise(F.raise_error(F.concat(F.lit("normalising changes the text of case "), F.col("id"))).cast(out.schema["spans"].dataType))
    return out.withColumn("predicted", same).drop("normalised", "raw_spans", "spans")


def naive_precision(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: format matches, how many of their texts are also valid, and the share; null without matches. Valid texts are looked up in the same document."""
    both = docs.select(NaiveAadhaarDetector().spans(F.col(text)).alias("naive"), AadhaarDetector().spans(F.col(text)).alias("checked"))
    texts = F.transform("checked", lambda s: s["text"])
    counts = both.select(F.size("naive").alias("n"), F.size(F.filter("naive", lambda s: F.array_contains(texts, s["text"]))).alias("ok"))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("naive_hits"), F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("valid_hits"))
    return totals.withColumn("naive_precision", F.try_divide(F.col("valid_hits").cast("double"), F.col("naive_hits").cast("double")))


def spot_check(cases: DataFrame, detectors: Sequence[Detector] | None = None) -> DataFrame:
    """cases(text, expected) plus got (sorted PERSON texts) and matched."""
    spans = detect(F.col("text"), detectors)
    out = cases.withColumn("got", F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s["entity_type"] == "PERSON"), lambda s: s["text"]))))
    return out.withColumn("matched", F.array_contains("got", F.col("expected")))
