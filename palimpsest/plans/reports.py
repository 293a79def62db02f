"""Markdown reports from small aggregated frames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.metrics import shown


def table(df: DataFrame, titles: dict[str, str]) -> str:
    """Columns of df under titles; doubles with three decimals, null as `-`. For frames of a few rows, in their order."""
    kinds = dict(df.dtypes)
    cells = df.select(*(shown(F.col(c)).alias(c) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in titles)).collect()
    lines = ["| " + " | ".join(titles.values()) + " |", "|" + "---|" * len(titles)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in cells])


#: Misses and false alarms that a report shows; all of them go to a table with `write_failures`.
SHOWN = 50
_COUNTS = {"tp": "hits", "fp": "false alarms", "fn": "misses", "precision": "precision", "recall": "recall", "f1": "F1"}


def failure_table(failures: DataFrame, limit: int = SHOWN) -> str:
    """The first `limit` failures as a Markdown table; their texts aren't shown."""
    rows = failures.limit(limit).collect()
    lines = [f"| {r['case_id']} | {r['category']} | {'missed' if r['kind'] == 'FN' else 'false alarm'} | {r['entity_type']} | `{r['span_text']}` |" for r in rows]
    return "\n".join(["| case | category | what | type | span |", "|---|---|---|---|---|", *lines]) if lines else "No misses and no false alarms."


def write_failures(failures: DataFrame, path: str) -> None:
    """All failures, with their texts, as JSON lines: however many there are, none passes through the driver."""
    failures.write.mode("overwrite").json(path)


def detection_report(evaluations: dict[str, dict[str, DataFrame]], n_cases: int, limit: int = SHOWN) -> str:
    """A section a rule: scores by type and in all, then by category of names; the failures of the first rule last."""
    parts = [f"# Detection, {n_cases} cases"]
    for rule, frames in evaluations.items():
        parts += [f"## By the {rule} rule", table(frames["per_type"].orderBy("entity_type"), {"entity_type": "type"} | _COUNTS), "All types:", table(frames["overall"], _COUNTS)]
        parts += ["Cases about people, by category:", table(frames["person_by_category"].orderBy("category"), {"category": "category"} | _COUNTS)]
    first = next(iter(evaluations))
    return "\n\n".join([*parts, f"## What the {first} rule counts as wrong", f"At most {limit} are listed.", failure_table(evaluations[first]["failures"], limit)]) + "\n"


def retrieval_report(results: DataFrame) -> str:
    """One table: a row a variant, with the three groups of queries side by side."""
    titles = {"variant": "texts", "mean_sim_to_original": "cosine to the original", "top1_accuracy": "first, all", "mrr": "MRR, all"}
    titles |= {"single_top1": "first, one person", "single_mrr": "MRR, one person", "multi_top1": "first, several", "multi_mrr": "MRR, several"}
    ordered = results.orderBy(F.array_position(F.array(*map(F.lit, ("original", "naive", "pipeline"))), F.col("variant")))
    return "\n\n".join(["# Retrieval after redaction", table(ordered, titles)]) + "\n"


def write_report(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf-8")
