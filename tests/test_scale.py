"""Plans and work that must not depend on how small a file looks."""

import contextlib
import io
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from drillmark.operators import ordered, sampling  # noqa: E402
from drillmark.functions.payload import unfence_json  # noqa: E402
from drillmark.functions.text import _WHITE, has_text  # noqa: E402
from drillmark.plans import retrieval  # noqa: E402
from drillmark.plans import validation as V  # noqa: E402

POOL = [(k, "g" if k % 3 else "h", "t") for k in range(40)]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture()
def pool(spark, tmp_path):
    """From a file, whose size is what Spark plans by."""
    spark.createDataFrame(POOL, "item_id long, g string, t string").write.parquet(f"{tmp_path}/pool")
    return spark.read.parquet(f"{tmp_path}/pool")


def test_block_sizes_are_not_broadcast(pool):
    numbered = ordered.number_rows(pool, ["g"], ["item_id"], F.floor(F.col("item_id") / 4), total="n")
    assert "BroadcastHashJoin" not in plan(numbered)
    assert sorted((r.position, r.n) for r in numbered.filter("g = 'h'").collect()) == [(k, 14) for k in range(1, 15)]


def test_slots_are_not_broadcast(spark, pool):
    requests = spark.createDataFrame([(k, "gh"[k % 2], 3) for k in range(30)], "quiz_id long, g string, n int")
    drawn = sampling.draw(requests, pool, ["g"], "quiz_id", "item_id", "n", "s")
    assert "BroadcastHashJoin" not in plan(drawn)
    assert drawn.count() == 90 and drawn.select("quiz_id", "item_id").distinct().count() == 90


def test_next_unused_does_not_broadcast_the_pool(spark, pool):
    sessions = spark.createDataFrame([(k, "gh"[k % 2]) for k in range(30)], "session_id long, g string")
    used = spark.createDataFrame([(k, i) for k in range(30) for i in range(0, 40, 2)], "session_id long, item_id long")
    found = sampling.next_unused(sessions, used, pool, ["g"], "session_id", "item_id", "s")
    assert "BroadcastHashJoin" not in plan(found)
    assert found.count() == 30 and found.filter("item_id % 2 = 0").count() == 0


def test_mixed_quizzes_do_not_broadcast_their_places(spark):
    entry_dir = "/root/testdata/sf0.001"
    assert "BroadcastHashJoin" not in plan(entry.queries()["quiz_assembly_mixed"](spark, entry_dir))


@pytest.mark.parametrize("name", ["teaching_context", "review_context", "choice_set_verdicts"])
def test_narrow_rows_are_dealt_before_costly_work(spark, name):
    assert "REPARTITION_BY_NUM" in plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))


def test_review_context_adds_the_question_last(spark):
    submissions = spark.createDataFrame([(1, 7, "sql"), (2, 7, "java"), (3, 8, "sql"), (4, 9, None)], "submission_id long, question_id long, method string")
    questions = spark.createDataFrame([(7, "seven"), (9, "nine")], "id long, title string").select(
        "id", "title", *[F.lit("x").alias(c) for c in ("question_type", "difficulty", "problem_statement", "constraints")], F.array("title").alias("tags")
    )
    solutions = spark.createDataFrame([(7, "sql", 1, "code")], "question_id long, method string, id long, code string")
    assets = spark.createDataFrame([(7, 1, "schema", None, "a")], "question_id long, id long, asset_type string, method string, content string")
    cases = spark.createDataFrame([(7, 1, "i", "o")], "question_id long, id long, input_data string, expected_output string")
    found = retrieval.review_context(submissions, questions, solutions, assets, cases)
    assert found.columns == ["question_id", "method", "submission_id", "question", "cases", "reference_solution", "assets"]
    assert sorted((r.submission_id, r.question.title, r.reference_solution) for r in found.collect()) == [(1, "seven", "code"), (2, "seven", None)]
    # the last join is the one with the questions: they take part in no earlier one
    joins = [x for x in plan(found).splitlines() if "Join" in x]
    assert "SortMergeJoin [question_id" in joins[0]


def test_assessments_are_dealt_before_they_are_written_and_read(spark):
    assert "REPARTITION_BY_NUM" in plan(entry.queries()["assessment_payloads"](spark, "/root/testdata/sf0.001"))


def test_members_of_a_reply_are_listed_once(spark):
    assert str(V.assessment(F.col("v"))._jc).count("map_keys") == 1
    held = {"ab": True, "abc": True, "a": False, "abd": False, "abcd": False, "": False, "aab": None}
    rows = [("{" + ",".join(f'"{c}":1' for c in reversed(names)) + "}",) for names in held] + [("[1]",), ("null",)]
    value = F.try_parse_json("reply")
    found = spark.createDataFrame(rows, "reply string").select(V._members(value, ("b", "a"), ("c",)).alias("ok")).collect()
    assert [r.ok for r in found] == [*held.values(), None, None]


def test_blank_and_fenced_texts_are_told_as_before(spark):
    texts = [(c, False) for c in ("", " ", _WHITE, None)] + [(t, True) for t in ("a", _WHITE + "~", "\u00e9", " \u200b", "\x00", "\x7f", "\x1b")]
    found = spark.createDataFrame(texts, "t string, ok boolean").select("ok", has_text(F.col("t")).alias("is")).collect()
    assert [r["is"] for r in found] == [ok for _, ok in texts]
    replies = [(" ```JSON {}\n``` ", "{}"), ("```{}```", "```{}```"), ("x```json {}```", "x```json {}```"), ("```json {}", "```json {}"), (None, None)]
    found = spark.createDataFrame(replies, "t string, body string").select("body", unfence_json(F.col("t")).alias("is")).collect()
    assert [r["is"] for r in found] == [body for _, body in replies]
