"""Scoring predicted spans against gold spans, strictly (type and offsets) or relaxed (type and any overlap)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.lets import exploded, let
from palimpsest.functions.metrics import f1, precision, recall

RULES = ("strict", "relaxed")


def matches(pred: Column, gold: Column, rule: str) -> Column:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    same = pred["entity_type"] == gold["type"]
    if rule == "strict":
        return same & (pred["start"] == gold["start"]) & (pred["end"] == gold["end"])
    return same & (pred["start"] < gold["end"]) & (gold["start"] < pred["end"])


def outcomes(predicted: Column, gold: Column, rule: str) -> Column:
    """array<struct<outcome, entity_type, span_text, kind_rank, pos>> of one case, one to one and greedily: each gold span, in order, takes the first prediction left."""
    numbered = F.transform(predicted, lambda p, i: F.struct(i.alias("pos"), p.alias("p")))
    row = "struct<outcome:string,entity_type:string,span_text:string,kind_rank:int,pos:int>"

    def entry(outcome: Column, kind: Column, text: Column, rank: int, pos: Column) -> Column:
        return F.struct(outcome.alias("outcome"), kind.alias("entity_type"), text.alias("span_text"), F.lit(rank).alias("kind_rank"), pos.cast("int").alias("pos")).cast(row)

    def run(items: Column) -> Column:
        start = F.struct(items.alias("left"), F.array().cast(f"array<{row}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            g = x["g"]
            hit = F.array_position(F.transform(acc["left"], lambda p: matches(p["p"], g, rule)), True)
            return let(
                hit,
                lambda at: F.struct(
                    F.when(at > 0, F.filter(acc["left"], lambda p, i: i != (at - 1))).otherwise(acc["left"]).alias("left"),
                    F.array_append(acc["out"], entry(F.when(at > 0, F.lit("TP")).otherwise(F.lit("FN")), g["type"], g["text"], 0, x["pos"])).alias("out"),
                ),
            )

        finish = lambda acc: F.concat(acc["out"], F.transform(acc["left"], lambda p: entry(F.lit("FP"), p["p"]["entity_type"], p["p"]["text"], 1, p["pos"])))
        return F.aggregate(F.transform(gold, lambda g, i: F.struct(i.alias("pos"), g.alias("g"))), start, step, finish)

    return let(numbered, run)


def _case_columns(cases: DataFrame) -> list[str]:
    return ["id", "category", "text", *(["position"] if "position" in cases.columns else [])]


def judged(cases: DataFrame, rule: str) -> DataFrame:
    """cases(id, category, text, entities, predicted, and perhaps position) -> a row for each outcome; no shuffle."""
    kept = _case_columns(cases)
    return exploded(cases, outcomes(F.col("predicted"), F.col("entities"), rule), "o", *kept).select(*kept, "o.*")


def judged_by(cases: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """The outcomes by several rules, in one pass over the cases: what finds the predictions runs once. (rule, and the columns of `judged`)."""
    kept = _case_columns(cases)
    named = lambda r, found: F.transform(found, lambda o: F.struct(F.lit(r).alias("rule"), o.alias("o")))
    by_rule = let(F.col("predicted"), lambda p: F.flatten(F.array(*(named(r, outcomes(p, F.col("entities"), r)) for r in rules))))
    return exploded(cases, by_rule, "by", *kept).select("by.rule", *kept, "by.o.*")


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "FN")]


def _scored(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def per_type(outcome_rows: DataFrame) -> DataFrame:
    """(entity_type, tp, fp, fn, precision, recall, f1)."""
    return _scored(outcome_rows.groupBy("entity_type").agg(*_counts()))


def overall(outcome_rows: DataFrame) -> DataFrame:
    return _scored(outcome_rows.agg(*_counts()))


def per_type_and_overall(outcome_rows: DataFrame) -> DataFrame:
    """Both in one pass: entity_type is null in the row for all."""
    return _scored(outcome_rows.rollup("entity_type").agg(*_counts()))


def person_by_category(outcome_rows: DataFrame) -> DataFrame:
    """(category, tp, fp, fn, ...) of cases whose category starts with person_; spans of all types count."""
    return _scored(outcome_rows.where(F.startswith("category", F.lit("person_"))).groupBy("category").agg(*_counts()))


def failures(outcome_rows: DataFrame, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """(kind, case_id, category, entity_type, span_text, text), misses before false alarms in each case.

    Cases come by their position if they have one, else by id as a string. ordered=False spares the sort of all. limit: only the first so many.
    """
    bad = outcome_rows.where(F.col("outcome") != "TP")
    if ordered or limit is not None:
        bad = bad.orderBy(*(["position"] if "position" in bad.columns else []), "id", "kind_rank", "pos")
    out = bad.select(F.col("outcome").alias("kind"), F.col("id").alias("case_id"), "category", "entity_type", "span_text", "text")
    return out if limit is None else out.limit(limit)


def _frames(rows: DataFrame) -> dict[str, DataFrame]:
    return {"per_type": per_type(rows), "overall": overall(rows), "person_by_category": person_by_category(rows), "failures": failures(rows)}


def evaluate(cases: DataFrame, rule: str) -> dict[str, DataFrame]:
    """The frames of one evaluation: per_type, overall, person_by_category, failures. Outcomes are computed once and kept on disk for all
    of them, until the session's cache is cleared."""
    return _frames(judged(cases, rule).persist(StorageLevel.DISK_ONLY))


def evaluate_all(cases: DataFrame, rules: tuple[str, ...] = RULES) -> dict[str, dict[str, DataFrame]]:
    """The frames of each rule's evaluation, from one pass over the cases."""
    rows = judged_by(cases, rules).persist(StorageLevel.DISK_ONLY)
    return {r: _frames(rows.where(F.col("rule") == r).drop("rule")) for r in rules}


def scores_by_rule(cases: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(rule, entity_type, tp, fp, fn, precision, recall, f1), one pass and one aggregation."""
    return _scored(judged_by(cases, rules).groupBy("rule", "entity_type").agg(*_counts()))
