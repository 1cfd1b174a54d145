"""Import runs over the configured datasets, audited and repeatable."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.text import relative_path
from drillmark.sources import interviews, sinks
from drillmark.sources.inspection import inspect_dataset, require_sound, revisions, with_revisions
from drillmark.sources.normalisers import NORMALISERS
from drillmark.sources.readers import (
    as_variant,
    read_json_array,
    read_json_lines,
    read_parquet_records,
    read_whole,
)
from drillmark.sources.specs import PROMPT_CORPORA, QuestionCorpus, PromptCorpus, choose


def read_raw(spark: SparkSession, spec: QuestionCorpus, paths: list[str], root: str) -> DataFrame:
    """Raw records of a dataset with relative file, index, revision and reject flag."""
    known = revisions(spark, root)
    if spec.short == "codecontests":
        raw = read_parquet_records(spark, paths, ["path", "task_binary"])
        raw = raw.withColumn("rejected", F.lit(False))
    elif spec.files.format == "parquet":
        raw = as_variant(read_parquet_records(spark, paths))
    elif spec.files.format == "jsonl":
        raw = read_json_lines(spark, paths)
    else:
        raw = read_json_array(spark, paths)
    return with_revisions(raw, known).withColumn(
        "source_file", relative_path(F.col("source_file"), root)
    )


def outcome_counts(records: DataFrame, accepted: DataFrame, dataset: str) -> DataFrame:
    """Imported and skipped records per dataset; their sum is what was read."""
    read = records.groupBy(dataset).agg(F.count("*").alias("records"))
    kept = accepted.groupBy(dataset).agg(F.count("*").alias("imported"))
    return (
        read.join(kept, dataset, "left")
        .withColumn("imported", F.coalesce("imported", F.lit(0)))
        .withColumn("skipped", F.col("records") - F.col("imported"))
        .drop("records")
    )


def write_audit(spark, catalog, run_id, dataset, started, status, counts=(0, 0), error=None):
    """The run's audit row, replaced as the run goes on."""
    done = None if status == "running" else datetime.now(timezone.utc)
    message = None if error is None else error[: S.MAX_ERROR_CHARS]
    row = [(run_id, dataset, started, done, *counts, status, message)]
    audit = spark.createDataFrame(row, S.TABLES["import_runs"]).coalesce(1)
    sinks.append_rows(audit, catalog, "import_runs", run_id)


def audited(
    spark: SparkSession, catalog: str, run_id: str, dataset: str, work: Callable[[], tuple[int, int]]
) -> dict:
    """Run ``work`` between its audit rows; a failure is recorded, not raised.

    A run that is repeated turns ``running`` first: its earlier rows no longer
    count as stored, so the repetition writes them again.
    """
    started = datetime.now(timezone.utc)
    write_audit(spark, catalog, run_id, dataset, started, "running")
    counts, status, error = (0, 0), "completed", None
    try:
        counts = work()
    except Exception as exc:
        status, error = "failed", str(exc)
    write_audit(spark, catalog, run_id, dataset, started, status, counts, error)
    imported, skipped = counts
    return {
        "dataset_name": dataset,
        "imported": imported,
        "skipped": skipped,
        "status": status,
        "error": error,
    }


def import_records(
    spark: SparkSession, raw: DataFrame, spec: QuestionCorpus, catalog: str, run_id: str
) -> tuple[int, int]:
    """Import raw records as one run; returns (imported, skipped).

    The accepted records are written once and read back, so that the five
    tables of a question come from the same rows whatever task is lost.
    """
    usable = raw.filter(~F.col("rejected")).drop("rejected")
    normalised = NORMALISERS[spec.short](usable, spec, run_id)
    staging = sinks.run_path(catalog, "_staging", run_id)
    stored = sinks.committed_keys(spark, catalog)
    sinks.new_by_keys(normalised, stored).write.mode("overwrite").parquet(staging)
    accepted = spark.read.schema(S.NORMALISED_QUESTION).parquet(staging)
    tables = sinks.question_tables(accepted)
    sinks.write_run(tables, catalog, run_id)
    sinks.write_keys(tables, catalog, run_id)
    imported = accepted.count()
    return imported, raw.count() - imported


def import_questions(
    spark: SparkSession, spec: QuestionCorpus, root: str, catalog: str, run_id: str
) -> tuple[int, int]:
    """Inspect all files of a dataset, then import them."""
    paths = require_sound(inspect_dataset(spark, spec, root), spec)
    return import_records(spark, read_raw(spark, spec, paths, root), spec, catalog, run_id)


def run_import(
    spark: SparkSession, root: str, catalog: str, run_prefix: str, datasets: list[str] | None = None
) -> list[dict]:
    """Import the chosen datasets one by one; a failure stays with its dataset."""
    results = []
    for spec in choose(datasets):
        run_id = f"{run_prefix}-{spec.short}"

        def work(spec=spec, run_id=run_id):
            return import_questions(spark, spec, root, catalog, run_id)

        results.append(audited(spark, catalog, run_id, spec.name, work))
    return results


# --- Interview sources -------------------------------------------------------


def _files(spark: SparkSession, path: str, revision: str | None, pattern: str | None = None) -> DataFrame:
    return read_whole(spark, path, pattern).withColumn("source_revision", F.lit(revision).cast("string"))


def interview_records(
    spark: SparkSession, root: str, run_id: str, revision: dict[str, str]
) -> dict[str, Callable[[], DataFrame]]:
    """Per allowed source, its item rows read by its own reader."""

    def reader(source: PromptCorpus) -> DataFrame:
        folder, rev = f"{root.rstrip('/')}/{source.name}", revision.get(source.name)
        if source.reader == "json":
            raw = read_json_array(spark, f"{folder}/data/questions.json")
            raw = raw.withColumn("source_revision", F.lit(rev).cast("string"))
            return interviews.interview_json(raw, run_id)
        if source.reader == "qa_markdown":
            return interviews.qa_markdown(_files(spark, f"{folder}/README.md", rev), run_id)
        readme = F.lower(F.col("source_file")).endswith("/readme.md")
        files = _files(spark, folder, rev, "*.md").filter(~readme)
        described = files.withColumns(
            {
                "dataset": F.lit(source.name),
                "license": F.lit(source.rights.license).cast("string"),
                "domain": F.lit(source.domain),
            }
        )
        return interviews.generic_markdown(described, run_id)

    return {s.name: partial(reader, s) for s in PROMPT_CORPORA if s.rights.importable}


def selected_sections(spark: SparkSession, folder: str, run_id: str, revision: str) -> DataFrame:
    """Items of the section Markdown files in a folder."""
    return interviews.section_markdown(_files(spark, f"{folder.rstrip('/')}/*.md", revision), run_id)


def import_items(spark: SparkSession, items: DataFrame, catalog: str, run_id: str) -> tuple[int, int]:
    """Import interview items as one run; returns (imported, skipped)."""
    staging = sinks.run_path(catalog, "_staging", run_id)
    fresh = sinks.new_items_by_keys(items, sinks.committed_keys(spark, catalog))
    fresh.write.mode("overwrite").parquet(staging)
    accepted = spark.read.schema(fresh.schema).parquet(staging)
    tables = sinks.item_tables(accepted)
    sinks.write_run(tables, catalog, run_id)
    sinks.write_keys(tables, catalog, run_id)
    imported = accepted.count()
    return imported, items.count() - imported


def run_interview_import(
    spark: SparkSession, root: str, catalog: str, run_prefix: str, revision: dict[str, str]
) -> list[dict]:
    """Import every allowed interview source as its own audited run."""
    results = []
    for key in interview_records(spark, root, "", revision):
        run_id = f"{run_prefix}-{key}"

        def work(key=key, run_id=run_id):
            items = interview_records(spark, root, run_id, revision)[key]()
            return import_items(spark, items, catalog, run_id)

        results.append(audited(spark, catalog, run_id, key, work))
    return results
