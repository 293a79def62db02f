"""Scoring detectors on a labelled set from end to end: detect once, judge by both rules, write the report and all failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from palimpsest.operators import scoring
from palimpsest.operators.detectors import Detector
from palimpsest.plans.pipeline import for_evaluation
from palimpsest.plans.reports import SHOWN, detection_report, write_failures, write_report


def evaluate_detection(gold: DataFrame, report_path: str | None = None, failures_path: str | None = None, detectors: Sequence[Detector] | None = None, limit: int = SHOWN) -> dict[str, dict[str, DataFrame]]:
    """gold as `read_gold` gives it -> the frames of both evaluations. The report is a file of the driver, the failures a table with their texts."""
    frames = scoring.evaluate_all(for_evaluation(gold, detectors))
    if failures_path:
        write_failures(frames["strict"]["failures"], failures_path)
    if report_path:
        write_report(detection_report(frames, gold.count(), limit), report_path)
    return frames
