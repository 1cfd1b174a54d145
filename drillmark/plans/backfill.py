"""Rewrites that bring older tables to the current form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S


def legacy_status(attempts: DataFrame) -> DataFrame:
    """Attempts without a status get ``legacy_<test result>``; null stays null."""
    legacy = F.concat(F.lit("legacy_"), F.col("test_result"))
    return attempts.withColumn("assessment_status", F.coalesce("assessment_status", legacy))


def legacy_source_key(sources: DataFrame) -> DataFrame:
    """Sources without a key get ``legacy:<id>``."""
    legacy = F.concat(F.lit("legacy:"), F.col("id").cast("string"))
    return sources.withColumn("source_key", F.coalesce("source_key", legacy))


def default_test_result(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn(
        "deterministic_test_result",
        F.coalesce("deterministic_test_result", F.lit("not_run")),
    )


def expand_methods(questions: DataFrame) -> DataFrame:
    """Curated algorithm questions offer every algorithm language."""
    curated = (F.col("question_type") == "algorithm") & ~F.col("is_ai_generated")
    languages = F.array(*[F.lit(m) for m in S.ALGORITHM_METHODS])
    return questions.withColumn(
        "supported_methods", F.when(curated, languages).otherwise(F.col("supported_methods"))
    )


def schema_version(versions: DataFrame) -> DataFrame:
    """Highest applied version, 0 when there is none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
