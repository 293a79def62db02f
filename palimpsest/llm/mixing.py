"""Mixing sources to target weights. DataFrame functions only.

A source's target is a share of all words by weight, at most `ceiling` times what the source has; what that cuts off is shared out again by
weight until no source is above. That fixed point is a water level: target = min(ceiling * size, level * weight). With sources ordered by
ceiling * size / weight, the level is (all - capped before) / (weights left) at the first source that it doesn't fill.
A document is emitted floor(rate) times, rate = target / size of its source, and once more with probability rate - floor(rate),
drawn from a hash of its id, source and text, so that reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import stage, word_count

#: Weights by rank of the source, repeating, and the most repetitions of a source.
WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix"


def draw(doc_id: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from 52 bits of a hash."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("?")), F.coalesce(source.cast("string"), F.lit("?")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """sizes(source, source_size), one row a source -> the same plus target.

    Sources rank by code point, null last. The windows order one row a source, not documents: a mixture's table of weights.
    """
    if not weights or min(weights) <= 0 or ceiling < 1:
        raise ValueError("weights must be positive and the ceiling at least 1")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * ceiling).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / weight_left)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    levelled = levelled.withColumn("level", F.first(fits, ignorenulls=True).over(everything))
    return levelled.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _goals(sizes: DataFrame, weights: Sequence[float], ceiling: int) -> DataFrame:
    """sizes(source, source_size) -> (__of, __source_size, __target, __rate), staged: one row a source."""
    goal = stage(targets(sizes, weights, ceiling), "targets")
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.greatest("source_size", F.lit(1)))
    return goal.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("__rate"))


def _copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def allotment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """One row for each row of docs: (doc_id, size, source_size, target, copies, taken = size * copies).

    size is the number of words, 0 for a null or empty text; texts are read once, however long. A null source is a source, a null id an id. A source
    without words has target 0. Repeated rows draw alike; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    drawn = draw(F.col(doc_id), F.col(source), F.col(text), seed)
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), drawn.alias("drawn")), "sizes")
    goal = _goals(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    rated = rows.join(goal, F.col("source").eqNullSafe(F.col("__of"))).withColumn("copies", _copies(F.col("__rate"), F.col("drawn")))
    return rated.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """The rows of docs, all columns kept, each as many times as the mix takes it: no row for documents that it leaves out. Nulls, repeats and empty tables as in `allotment`."""
    goal = _goals(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    drawn = draw(F.col(doc_id), F.col(source), F.col(text), seed)
    rows = docs.select(F.struct("*").alias("__row"), F.col(source).alias("__source"), drawn.alias("__draw"))
    rated = rows.join(goal, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__copies", _copies(F.col("__rate"), F.col("__draw")))
    copied = rated.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"))
    return copied.select("__row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, '?'), coalesce(source, '?'), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, (source_size * 3)::DOUBLE AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k
  FROM r WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * (SELECT arg_min(lev, k) FROM l WHERE lev <= most / weight)) AS target FROM l),
c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / greatest(source_size, 1) END AS rate, u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
