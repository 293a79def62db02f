"""The same pipeline on a stream: it keeps no state, so the batch columns serve as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.detectors import Detector
from palimpsest.plans.pipeline import audit_entries, redact_documents


def redact_stream(docs: DataFrame, text: str = "text", detectors: Sequence[Detector] | None = None) -> DataFrame:
    if not docs.isStreaming:
        raise ValueError("docs is not a stream; use redact_documents")
    return redact_documents(docs, text, detectors)


def write_audit_stream(docs: DataFrame, path: str, checkpoint: str, document_id: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append audit entries of a stream of documents as JSON lines, each batch once."""
    writer = audit_entries(redact_stream(docs), document_id).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
