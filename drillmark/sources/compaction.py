"""Compaction of tables that grow batch by batch.

Every appended batch is a folder.  ``compact`` rewrites the completed batches of
a table as one generation of files of a good size; readers that started before
go on with the folders, which stay until ``drop_superseded``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark.sources import generations, sinks


def _open_runs(spark: SparkSession, catalog: str, table: str, merge: bool) -> DataFrame:
    """(import_run, started_at): the finished runs a compaction has to rewrite."""
    audit = sinks.read_table(spark, catalog, "import_runs")
    # The audit keeps runs that failed; other tables take completed runs only.
    ended = F.col("status") != "running" if table == "import_runs" else F.col("status") == "completed"
    done = generations.started_runs(audit.filter(ended))
    if table != "import_runs":
        written = sinks.read_table(spark, catalog, table).select("import_run").distinct()
        done = done.join(written, "import_run", "left_semi")
    covered = generations.covered_runs(spark, catalog, table)
    if merge or covered is None:
        return done
    return done.join(covered, ["import_run", "started_at"], "left_anti")


def compact(spark: SparkSession, catalog: str, table: str, merge: bool = False) -> int:
    """Rewrite the batches that no generation holds as a new one; returns its number, 0 for none.

    ``merge`` takes the rows of the earlier generations along.  Rows keep their
    ``import_run``.  Nothing is deleted, and a compaction that dies leaves a
    folder nobody reads, which the next one overwrites.  Not to be run while the
    same table is being compacted.
    """
    runs = _open_runs(spark, catalog, table, merge).persist()
    try:
        if runs.isEmpty():
            return 0
        number = generations.last_generation(generations.covered_runs(spark, catalog, table)) + 1
        rows = sinks.read_table(spark, catalog, table).join(runs.select("import_run"), "import_run", "left_semi")
        # Adaptive execution cuts the rebalanced rows into files of its advisory size.
        rows.hint("rebalance").write.mode("overwrite").parquet(
            generations.generation_path(catalog, table, number, "rows")
        )
        runs.coalesce(1).write.mode("overwrite").parquet(
            generations.generation_path(catalog, table, number, "covered")
        )
    finally:
        runs.unpersist()
    return number


def drop_superseded(spark: SparkSession, catalog: str, table: str) -> int:
    """Delete the batch folders, and the generations, whose rows a later generation holds.

    For when readers that started before the last compaction have ended.  Not to
    be run while a batch of the table is written again.  Returns the number of
    folders that went.
    """
    covered = generations.covered_runs(spark, catalog, table)
    if covered is None:
        return 0
    current = generations.current_runs(covered, sinks.read_table(spark, catalog, "import_runs")).persist()
    try:
        live = {r["generation"] for r in current.select("generation").distinct().toLocalIterator()}
        paths = [
            generations.generation_path(catalog, table, n, "")
            for n in range(1, generations.last_generation(covered) + 1)
            if n not in live
        ]
        gone = sum(_delete(spark, path) for path in paths)
        for row in current.select("import_run").toLocalIterator():  # one name per run, in turn
            gone += _delete(spark, sinks.run_path(catalog, table, row["import_run"]))
    finally:
        current.unpersist()
    return gone


def _delete(spark: SparkSession, path: str) -> bool:
    """Whether the folder was there; it is gone afterwards."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
