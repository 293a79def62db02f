"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, substrings, warc


#: Where the vocabulary of op6 is read from, on the driver only.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontamination import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality import scores

    return scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.language import languages

    return languages(_table(spark, sf_dir, "documents"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    from palimpsest.llm.tokens import sentencepiece_pieces, token_counts

    return token_counts(_table(spark, sf_dir, "documents"), sentencepiece_pieces(model))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.mixing import allotment

    return allotment(_table(spark, sf_dir, "documents"))


def op8_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.substrings import repeats

    return repeats(_table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.licences import licenses

    return licenses(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.neighbours import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_leaks,
        op2_warc_round_trip,
        op3_quality_scores,
        op4_language_id,
        op5_simhash_near_duplicates,
        op6_token_counts,
        op7_mixing_sources,
        op8_substring_repeats,
        op9_license_scans,
        op10_nearest_neighbours,
    )
}

ORACLES: dict[str, str] = {"op2_warc_round_trip": warc.ORACLE, "op7_mixing_sources": mixing.ORACLE, "op8_substring_repeats": substrings.ORACLE}
