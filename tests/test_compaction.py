"""Compaction: the same rows from fewer folders, whatever is written or lost meanwhile."""

from datetime import datetime

from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.sources import compaction, sinks

T = datetime(2024, 1, 1)


def attempts(spark, ids, method="sql"):
    rows = [(i, "q", T, method, *[None] * 8) for i in ids]
    return spark.createDataFrame(rows, S.TABLES["attempts"]).coalesce(1)


def seen(spark, catalog):
    return sorted((r.id, r.method) for r in sinks.read_committed(spark, catalog, "attempts").collect())


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir()) if path.exists() else []


def test_many_batches_become_one_generation(spark, tmp_path):
    """A thousand batches as the sink leaves them, written by one partitioned job."""
    catalog = str(tmp_path)
    number = spark.range(1000).withColumn("import_run", F.format_string("b%04d", "id"))
    rows = attempts(spark, ["x"]).drop("id").crossJoin(F.broadcast(number.select(F.col("id").cast("string"), "import_run")))
    rows.write.partitionBy("import_run").parquet(f"{catalog}/attempts")
    audit = spark.createDataFrame([("", "t", T, T, 1, 0, "completed", None)], S.TABLES["import_runs"]).drop("id")
    runs = audit.crossJoin(F.broadcast(number.select(F.col("import_run").alias("id"), "import_run")))
    runs.write.partitionBy("import_run").parquet(f"{catalog}/import_runs")
    before = seen(spark, catalog)
    reader = sinks.read_committed(spark, catalog, "attempts")
    assert len(before) == 1000
    for table in ("attempts", "import_runs"):
        assert compaction.compact(spark, catalog, table) == 1
        assert compaction.compact(spark, catalog, table) == 0
    assert seen(spark, catalog) == before
    # who started before still has the old folders
    assert reader.count() == 1000
    for table in ("attempts", "import_runs"):
        assert compaction.drop_superseded(spark, catalog, table) == 1000
        assert compaction.drop_superseded(spark, catalog, table) == 0
        assert folders(tmp_path / table) == []
        assert folders(tmp_path / "_generations" / table) == ["generation=1"]
    assert seen(spark, catalog) == before
    assert sinks.read_table(spark, catalog, "import_runs").count() == 1000


def test_a_batch_written_again_leaves_its_generation(spark, tmp_path):
    catalog = str(tmp_path)
    assert compaction.compact(spark, catalog, "attempts") == 0
    assert compaction.drop_superseded(spark, catalog, "attempts") == 0
    sinks.append_rows(attempts(spark, ["a", "b"]), catalog, "attempts", "b1")
    sinks.append_rows(attempts(spark, ["c"]), catalog, "attempts", "b2")
    for table in ("attempts", "import_runs"):
        compaction.compact(spark, catalog, table)
        compaction.drop_superseded(spark, catalog, table)
    sinks.append_rows(attempts(spark, ["b"], "python"), catalog, "attempts", "b1")
    assert seen(spark, catalog) == [("b", "python"), ("c", "sql")]
    # a run that is being repeated is not visible, neither in its old nor in its new form
    running = [("b2", "attempts", datetime(2030, 1, 1), None, 0, 0, "running", None)]
    sinks.append_rows(spark.createDataFrame(running, S.TABLES["import_runs"]).coalesce(1), catalog, "import_runs", "b2")
    assert seen(spark, catalog) == [("b", "python")]
    sinks.append_rows(attempts(spark, ["c", "d"]), catalog, "attempts", "b2")
    want = [("b", "python"), ("c", "sql"), ("d", "sql")]
    assert seen(spark, catalog) == want
    assert compaction.compact(spark, catalog, "attempts") == 2
    assert seen(spark, catalog) == want
    # the first generation has no run of its own left
    assert compaction.drop_superseded(spark, catalog, "attempts") == 3
    assert folders(tmp_path / "_generations" / "attempts") == ["generation=2"]
    assert seen(spark, catalog) == want
    assert compaction.compact(spark, catalog, "attempts", merge=True) == 3
    compaction.drop_superseded(spark, catalog, "attempts")
    assert folders(tmp_path / "_generations" / "attempts") == ["generation=3"]
    assert seen(spark, catalog) == want


def test_a_compaction_that_died_is_not_read(spark, tmp_path):
    catalog = str(tmp_path)
    sinks.append_rows(attempts(spark, ["a"]), catalog, "attempts", "b1")
    half = tmp_path / "_generations" / "attempts" / "generation=1" / "rows"
    attempts(spark, ["a", "z"]).withColumn("import_run", F.lit("b1")).write.parquet(str(half))
    assert seen(spark, catalog) == [("a", "sql")]
    assert compaction.compact(spark, catalog, "attempts") == 1
    assert seen(spark, catalog) == [("a", "sql")]
