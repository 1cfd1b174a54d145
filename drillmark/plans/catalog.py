"""Catalog queries: picker, facets, counts, samples and import status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.payload import entries
from drillmark.functions.scoring import difficulty_rank, starter_code
from drillmark.operators.barrier import once
from drillmark.operators.joins import left_join_known
from drillmark.operators.ordered import latest_per_key, number_rows, top_per_key
from drillmark.operators.predicates import curated, item_filter
from drillmark.operators.sampling import seeded_sample


def picker_page(
    questions: DataFrame, question_type, difficulty, method, topic=S.ANY_TOPIC, n: int = 20
) -> DataFrame:
    """First page of the question picker."""
    wanted = questions.filter(curated(question_type, difficulty, method, topic))
    return (
        wanted.select("id", "title", "difficulty", "tags")
        .orderBy(F.col("title").asc_nulls_last(), "id")
        .limit(n)
    )


def curated_count(
    questions: DataFrame, question_type=None, difficulty=None, method=None, topic=None
) -> DataFrame:
    """A16."""
    wanted = questions.filter(curated(question_type, difficulty, method, topic))
    return wanted.agg(F.count("*").alias("n"))


def available_topics(questions: DataFrame, question_type=None, difficulty=None, method=None) -> DataFrame:
    """Distinct tags of the matching questions, sorted."""
    wanted = questions.filter(curated(question_type, difficulty, method))
    return (
        wanted.select(F.explode("tags").alias("topic"))
        .filter(F.col("topic").isNotNull())
        .distinct()
        .orderBy("topic")
    )


def available_difficulties(questions: DataFrame, question_type=None, method=None) -> DataFrame:
    """Distinct difficulties in canonical order."""
    wanted = questions.filter(curated(question_type, None, method))
    return (
        wanted.select("difficulty")
        .distinct()
        .withColumn("place", difficulty_rank(F.col("difficulty")))
        .filter(F.col("place").isNotNull())
        .orderBy("place")
    )


def item_facets(items: DataFrame) -> DataFrame:
    """Distinct domains and topics of the complete items."""
    complete = items.filter("is_complete")
    pairs = F.array(
        F.struct(F.lit("domain").alias("facet"), F.col("domain").alias("value")),
        F.struct(F.lit("topic").alias("facet"), F.col("topic").alias("value")),
    )
    return (
        complete.select("domain", "topic")
        .distinct()
        .select(F.inline(pairs))
        .distinct()
        .orderBy("facet", "value")
    )


def random_questions(
    questions: DataFrame, n: int, seed: str, question_type=None, difficulty=None, method=None, topic=None
) -> DataFrame:
    """K9: a reproducible sample of the curated questions."""
    wanted = questions.filter(curated(question_type, difficulty, method, topic))
    return seeded_sample(wanted, "id", n, seed)


def learning_modes(questions: DataFrame, question_type, method, modes) -> DataFrame:
    """All modes when a curated question exists, else generated only."""
    exists = questions.filter(curated(question_type, None, method)).limit(1)
    found = exists.agg(F.count("*").alias("n"))
    all_modes = F.array(*[F.lit(m) for m in modes])
    return found.select(
        F.when(F.col("n") > 0, all_modes)
        .otherwise(F.array(F.lit("ai_generated")))
        .alias("learning_modes")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Status of the newest import run of each dataset."""
    return latest_per_key(runs, ["dataset_name"], ["started_at", "id"], ["started_at", "id", "status"])


def pending_datasets(runs: DataFrame, configured: DataFrame, questions: DataFrame) -> DataFrame:
    """Configured datasets whose newest run is not completed.

    Empty when curated questions exist although none of the datasets was ever
    imported: the catalog was then built elsewhere.
    """
    statuses = latest_runs(runs).join(configured, "dataset_name", "left_semi")
    done = statuses.filter(F.col("status") == "completed")
    curated_rows = questions.filter(curated()).agg(F.count("*"))
    known_runs = statuses.agg(F.count("*"))
    pending = configured.join(done, "dataset_name", "left_anti")
    return pending.filter((curated_rows.scalar() == 0) | (known_runs.scalar() > 0))


def by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    """Point read."""
    return df.filter(F.col(column) == F.lit(key))


def starter_codes(questions: DataFrame, assets: DataFrame, templates: dict) -> DataFrame:
    """Starter code of every question and method, else the method's template."""
    stored = (
        assets.filter(F.col("asset_type") == "starter_code")
        .groupBy("question_id", "method")
        .agg(F.min_by("content", "id").alias("_stored"))
    )
    wanted = questions.select(
        F.col("id").alias("question_id"), F.explode("supported_methods").alias("method")
    )
    return wanted.join(stored, ["question_id", "method"], "left").select(
        "question_id", "method", starter_code(F.col("_stored"), F.col("method"), templates).alias("code")
    )


def references_for(items: DataFrame, answer_format, difficulty, domain=None, topic=None) -> DataFrame:
    """Three reference items, lowest ids first."""
    wanted = items.filter(item_filter(answer_format, difficulty, None, domain, topic))
    return wanted.orderBy("id").limit(3)


def examples_of(questions: DataFrame, cases: DataFrame, n: int = 3) -> DataFrame:
    """Test cases standing in for missing examples, marked examples first."""
    lacking = questions.filter(
        F.col("examples").isNull() | F.col("examples").isin("", "[]")
    ).select(F.col("id").alias("question_id"))
    ranked = top_per_key(
        cases, ["question_id"], [F.col("is_example").desc_nulls_last(), "id"], n, "example_no"
    )
    return ranked.join(lacking, "question_id", "left_semi")


def question_detail(questions: DataFrame, sources: DataFrame, generated: DataFrame) -> DataFrame:
    """Questions with provenance, imported or generated."""
    return (
        left_join_known(questions, sources, "source_id", "source_id")
        .join(generated, "question_id", "left")
        .withColumn(
            "source_kind",
            F.when(F.col("is_ai_generated"), "ai_generated").otherwise("dataset"),
        )
    )


def catalog_of(question_type):
    """The catalog that holds a question type."""
    return F.when(question_type == "data_analysis", "data_analysis").otherwise("algorithm")


def stored_solutions(solutions: DataFrame, block=None) -> DataFrame:
    """Solutions of each (question, method) in id order, repeats kept.

    One row per solution with its place in the list, so that no question's
    solutions are gathered into one value.  Stored ids are the question's digest
    and a six-digit place; without the last three digits they cut a long list
    into blocks of a thousand.
    """
    block = F.substring("id", 1, 36) if block is None else block
    return number_rows(solutions, ["question_id", "method"], ["id"], block, position="place")


def assets_by_type(assets: DataFrame) -> DataFrame:
    """A10: one content per question and asset type, the last id wins."""
    return assets.groupBy("question_id", "asset_type").agg(
        F.max_by("content", "id").alias("content")
    )


def fixture_preview(assets: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of every fixture table, one row each.

    A fixture is a list of rows or an object of such lists by table name; one
    that is neither has no preview.
    """
    fixtures = assets.filter(F.col("asset_type") == "fixture_data")
    parsed = once(fixtures, "_data", F.try_parse_json("content"))
    data = F.col("_data")
    listed = F.try_variant_get(data, "$", "array<variant>")
    single = F.array(F.struct(F.lit(None).cast("string").alias("key"), listed.alias("value")))
    named = F.transform(
        F.map_entries(entries(data)),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.try_variant_get(e["value"], "$", "array<variant>").alias("value"),
        ),
    )
    tables = F.when(listed.isNotNull(), single).otherwise(named)
    by_table = parsed.select("question_id", F.inline(tables).alias("table_name", "_rows"))
    heads = by_table.select(
        "question_id", "table_name", F.posexplode(F.slice("_rows", 1, n)).alias("_no", "_row")
    )
    return heads.select(
        "question_id", "table_name", (F.col("_no") + 1).alias("row_no"), F.to_json("_row").alias("row")
    )
