"""Generations: small batches of a table rewritten together.

``<catalog>/_generations/<table>/generation=<n>/rows`` holds the rows of the
batches, ``.../covered`` their (import_run, started_at).  The list is one file
and is written last, so a generation counts as a whole or not at all, and a
batch that is written again (it gets a new start time) leaves its generation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COVERED = "import_run string, started_at timestamp, generation long"


def generation_path(catalog: str, table: str, generation: int | str, part: str) -> str:
    return f"{_root(catalog, table)}/generation={generation}/{part}"


def _root(catalog: str, table: str) -> str:
    return f"{catalog.rstrip('/')}/_generations/{table}"


def _all_generations(spark: SparkSession, catalog: str, table: str, part: str, schema) -> DataFrame | None:
    """One part of every generation, null when there is none."""
    reader = spark.read.schema(schema).option("basePath", _root(catalog, table))
    try:
        return reader.parquet(generation_path(catalog, table, "*", part))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def covered_runs(spark: SparkSession, catalog: str, table: str) -> DataFrame | None:
    """(import_run, started_at, generation): what the generations hold, null when there are none."""
    return _all_generations(spark, catalog, table, "covered", COVERED)


def last_generation(covered: DataFrame | None) -> int:
    """The number of the newest generation, 0 when there is none."""
    return 0 if covered is None else covered.agg(F.max("generation")).first()[0] or 0


def started_runs(audit: DataFrame) -> DataFrame:
    """(import_run, started_at): of the audit's rows; a run without a start time has the first second."""
    started = F.coalesce("started_at", F.lit(0).cast("timestamp"))
    return audit.select(F.col("id").alias("import_run"), started.alias("started_at"))


def current_runs(covered: DataFrame, audit: DataFrame) -> DataFrame:
    """(import_run, generation): the newest generation of each run not written again since."""
    current = covered.join(started_runs(audit), ["import_run", "started_at"])
    return current.groupBy("import_run").agg(F.max("generation").alias("generation"))


def generation_rows(spark: SparkSession, catalog: str, table: str, schema) -> DataFrame:
    """All rows of all generations, with ``import_run`` and ``generation``."""
    return _all_generations(spark, catalog, table, "rows", schema.add("generation", "long"))
