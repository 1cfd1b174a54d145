"""Filters of the catalog, the attempt log and the item bank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.text import starts_with_any


def all_of(*conditions: Column | None) -> Column:
    """conjunction of the conditions that are given; none means true."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True)) if given else F.lit(True)


def equals(column: str, value) -> Column | None:
    """An optional equality: no condition when the value is None."""
    return None if value is None else F.col(column) == F.lit(value)


def has_member(column: str, value) -> Column | None:
    """an optional array membership."""
    return None if value is None else F.array_contains(F.col(column), F.lit(value))


def topic_condition(topic: str | None, tags: str = "tags") -> Column | None:
    """Any topic, or the topic is one of the tags; null tags match no topic."""
    if topic is None or topic == S.ANY_TOPIC:
        return None
    return F.array_contains(F.col(tags), F.lit(topic))


def curated(question_type=None, difficulty=None, method=None, topic=None) -> Column:
    """complete, not generated, and matching the given facets.

    The scalar tests come first so that they reach the parquet scan.
    """
    return all_of(
        equals("question_type", question_type),
        equals("difficulty", difficulty),
        F.col("is_complete"),
        ~F.col("is_ai_generated"),
        has_member("supported_methods", method),
        topic_condition(topic),
    )


def item_filter(
    answer_format: str, difficulty: str, prompt_style=None, domain=None, topic=None
) -> Column:
    """complete items of a format and difficulty."""
    return all_of(
        F.col("is_complete"),
        equals("answer_format", answer_format),
        equals("prompt_style", prompt_style),
        equals("difficulty", difficulty),
        equals("domain", domain),
        equals("topic", topic),
    )


def is_unfinished(status: Column) -> Column:
    """F8."""
    return status.isin(*S.UNFINISHED_QUIZ_STATUSES)


def relevant_asset(method: Column, asset_method: Column) -> Column:
    """review assets that are shared or belong to the method."""
    return F.col("asset_type").isin(*S.REQUIRED_ANALYSIS_ASSETS) & (
        asset_method.isNull() | (asset_method == "shared") | (asset_method == method)
    )


def shared_assets(assets: DataFrame, asset_type: str) -> DataFrame:
    """F16: shared or method-less assets of one type."""
    return assets.filter(
        (F.col("asset_type") == asset_type)
        & (F.col("method").isNull() | (F.col("method") == "shared"))
    )


def mentions_topic(title: Column, statement: Column, tags: Column, topic: str) -> Column:
    """does title, statement or a tag hold the topic, ignoring case?

    Null tags give null, which the caller counts as no match.
    """
    body = F.concat(title, F.lit(" "), statement, F.lit(" "), tags)
    return F.contains(F.lower(body), F.lower(F.lit(topic)))


def with_status(df: DataFrame, status: str) -> DataFrame:
    """F11."""
    return df.filter(F.col("status") == status)


def has_marks(df: DataFrame, column: str = "marks") -> DataFrame:
    """F12."""
    return df.filter(F.col(column).isNotNull())


# Bullet starts that are notes, not prompts.
NOTE_STARTS = (
    "Implementation rounds (",
    "Algorithm rounds (",
    "Solve 75+",
    "Focus on data structures",
    "Traditional ML focuses",
    "AI/LLM system design focuses",
)


def is_prompt(text: Column, min_chars: int) -> Column:
    """long enough and not one of the known notes."""
    return (F.length(text) >= min_chars) & ~starts_with_any(text, NOTE_STARTS)


def known_methods(methods: Column) -> Column:
    """The methods of the fixed vocabulary, order and repeats kept."""
    return F.filter(
        F.coalesce(methods, F.array().cast("array<string>")),
        lambda m: m.isin(*S.ALL_METHODS),
    )
