"""One document through everything: what each detector finds, formats against checksums, the redacted text, and a log begun anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.detectors import Detector, NaiveAadhaarDetector, default_detectors
from palimpsest.plans.pipeline import audit_entries, naive_precision, redact_documents
from palimpsest.sources.audit import read_audit_log, write_audit_log


@dataclass
class Demo:
    found: dict[str, list[str]]  # by detector, in the text as it is given
    naive_precision: float | None
    redacted: str
    logged: list[dict]


def run(spark: SparkSession, text: str, log_path: str, document_id: str = "demo") -> Demo:
    """Detectors see the text as it is given, the pipeline normalises it first. The log at log_path is overwritten."""
    docs = spark.createDataFrame([(document_id, text)], "document_id string, text string")
    given: list[Detector] = [*default_detectors(), NaiveAadhaarDetector()]
    found = docs.select(*(F.transform(d.spans(F.col("text")), lambda s: s["text"]).alias(f"d{k}") for k, d in enumerate(given))).first()
    share = naive_precision(docs).first()["naive_precision"]
    done = redact_documents(docs)
    write_audit_log(audit_entries(done, "document_id"), log_path, append=False)
    entries = read_audit_log(spark, log_path).orderBy("start")
    return Demo({d.name: list(found[k]) for k, d in enumerate(given)}, share, done.first()["redacted"], [r.asDict() for r in entries.collect()])
