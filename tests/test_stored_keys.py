"""Stored keys: what an import shuffles, and which runs count."""

import re

from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.sources import sinks, stored_keys


def question(key, file="f.jsonl", index=0, text="text"):
    source = ("set", key, file, key, None, index, None, "a", "r", None)
    return ("t", "essay", "Easy", text, None, None, [], [], source, [], [], [], True)


def exchanges(df):
    """The columns behind every shuffle of the plan."""
    plan = df._jdf.queryExecution().executedPlan()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan.toString(), [m[1] for m in re.finditer(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)]


def committed(spark, catalog, run, status="completed"):
    row = [(run, "set", None, None, 0, 0, status, None)]
    spark.createDataFrame(row, S.TABLES["import_runs"]).write.mode("overwrite").parquet(sinks.run_path(catalog, "import_runs", run))


def test_keys_decide_and_texts_stay(spark):
    """No statement is shuffled before the records are chosen."""
    incoming = spark.createDataFrame([question("k1"), question("k2", index=1), question("k1", index=2)], S.NORMALISED_QUESTION)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nothing = incoming.select("source.*").limit(0)
        new = sinks.new_questions(incoming, nothing)
        _, shuffled = exchanges(new)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with_texts = [x for x in shuffled if "problem_statement" in x]
    # the last join alone, in which the records of the chosen rows are fetched
    assert len(shuffled) >= 3 and len(with_texts) == 1 and "_file" in with_texts[0] and "_row" in with_texts[0]
    assert sorted((r.source.source_key, r.source.source_record_index) for r in new.collect()) == [("k1", 0), ("k2", 1)]


def test_stored_side_lies_where_it_is(spark, tmp_path):
    """Incoming keys go to the buckets; the stored ones are not shuffled."""
    catalog = str(tmp_path / "it's a catalog")
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    for run in ("a", "b"):
        stored_keys.write_keys(keys.filter(F.col("key").endswith("1" if run == "a" else "2")), catalog, run)
        committed(spark, catalog, run)
    found = sinks.committed_keys(spark, catalog)
    assert found.count() == 1000
    incoming = spark.range(100).select(F.concat(F.lit("k"), "id").alias("mine"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = incoming.join(found, F.col("mine") == F.col("key"), "left_anti")
        plan, shuffled = exchanges(fresh)
        assert fresh.count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    assert [x for x in shuffled if "key" in x] == []


def test_only_completed_runs_count_and_runs_replace_their_keys(spark, tmp_path):
    catalog = str(tmp_path)
    one = spark.createDataFrame([("x",), ("x",), ("y",)], "key string")
    stored_keys.write_keys(one, catalog, "r1")
    committed(spark, catalog, "r1", "running")
    assert sinks.committed_keys(spark, catalog).count() == 0
    committed(spark, catalog, "r1")
    assert sorted(r.key for r in sinks.committed_keys(spark, catalog).collect()) == ["x", "y"]
    stored_keys.write_keys(one.filter("key = 'y'"), catalog, "r1")
    assert [r.key for r in sinks.committed_keys(spark, catalog).collect()] == ["y"]
    # a run without keys, as from before there were any
    source = {"id": "s", "dataset_name": "set", "original_id": "o", "source_key": "k", "source_file": "dir/F.jsonl"}
    row = dict.fromkeys(S.TABLES["question_sources"].names) | source
    spark.createDataFrame([row], S.TABLES["question_sources"]).write.parquet(sinks.run_path(catalog, "question_sources", "old"))
    committed(spark, catalog, "old")
    got = {r.key.replace("\u0000", "|") for r in sinks.committed_keys(spark, catalog).collect()}
    assert got == {"y", "key|set|k", "old|set|o|f.jsonl"}


def test_keys_without_a_part_match_nothing(spark):
    stored = spark.createDataFrame([("set", None, None, None)], "dataset_name string, source_key string, original_id string, source_file string")
    assert stored_keys.keys_of_sources(stored).count() == 0
    incoming = spark.createDataFrame([question("k1"), question("k1", file="e.jsonl", index=9)], S.NORMALISED_QUESTION)
    (row,) = sinks.new_questions(incoming, stored).collect()
    assert row.source.source_file == "e.jsonl"
