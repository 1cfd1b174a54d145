"""Violations of single payloads, and verdicts over tables."""

import json

import pytest
from pyspark.sql import functions as F

from drillmark.plans import validation as V


def violations(spark, reply, check):
    text = reply if isinstance(reply, str) else json.dumps(reply)
    df = spark.createDataFrame([(text,)], "reply string")
    return V.checked(df, "reply", check).first().violations


def changed(base, **changes):
    out = {**base, **changes}
    return {k: v for k, v in out.items() if v is not ...}


ALGORITHM = {
    "question_type": "algorithm",
    "title": "Sum",
    "problem_statement": "Add.",
    "examples": [{"input": "1", "output": "2"}],
    "constraints": "n < 9",
    "difficulty": "Easy",
    "tags": ["math"],
    "starter_code": "def f(): pass",
    "test_cases": [{"input": 1, "expected_output": None}],
}


@pytest.mark.parametrize(
    ("changes", "broken"),
    [
        ({}, []),
        ({"reference_solution": "return 1"}, []),
        ({"reference_solution": " "}, ["reference_solution"]),
        ({"title": ...}, ["members", "title"]),
        ({"title": 5}, ["title"]),
        ({"unexpected": 1}, ["members"]),
        ({"difficulty": "Hard"}, ["difficulty"]),
        ({"question_type": "data_analysis"}, ["question_type"]),
        ({"tags": []}, ["tags"]),
        ({"tags": ["a", 1]}, ["tags"]),
        ({"tags": ["a", None]}, ["tags"]),
        ({"examples": []}, ["examples"]),
        ({"examples": [{"input": 1}]}, ["examples"]),
        ({"examples": [{"input": 1, "expected_output": 2}]}, []),
        ({"test_cases": [{"input": 1}]}, ["test_cases"]),
        ({"test_cases": "x"}, ["test_cases"]),
        ({"starter_code": "  "}, ["starter_code"]),
    ],
)
def test_algorithm_question(spark, changes, broken):
    def check(value):
        return V.algorithm_question(value, F.lit("Easy"))

    assert violations(spark, changed(ALGORITHM, **changes), check) == broken


@pytest.mark.parametrize("reply", ["", "{", "[1]", '{"a": NaN}', "```json\n{}"])
def test_malformed_replies(spark, reply):
    def check(value):
        return V.algorithm_question(value, F.lit("Easy"))

    assert violations(spark, reply, check)


CODES = dict.fromkeys(("sql", "pandas", "pyspark", "polars"), "code")
ANALYSIS = {
    "question_type": "data_analysis",
    "title": "Sales",
    "problem_statement": "Sum.",
    "difficulty": "Easy",
    "tags": ["sum"],
    "schema_sql": "create table Sales (a INT)",
    "fixture_data": [{"a": 1, "b": None}, {"b": "x", "a": 2.5}],
    "table_name": "sales",
    "expected_result": [{"a": True}],
    "supported_methods": ["polars", "sql", "pandas", "pyspark"],
    "starter_code": CODES,
    "reference_solutions": CODES,
}


@pytest.mark.parametrize(
    ("changes", "broken"),
    [
        ({}, []),
        ({"fixture_data": []}, ["fixture_data"]),
        ({"fixture_data": [{}]}, ["fixture_data"]),
        ({"fixture_data": [{"a": 1}, {"b": 1}]}, ["fixture_data"]),
        ({"fixture_data": [{"a": [1]}]}, ["fixture_data"]),
        ({"fixture_data": [{"": 1}]}, ["fixture_data"]),
        ({"expected_result": [1]}, ["expected_result"]),
        ({"schema_sql": "CREATE VIEW sales"}, ["create_table"]),
        ({"table_name": "other"}, ["table_in_schema"]),
        ({"supported_methods": ["sql", "pandas", "pyspark"]}, ["supported_methods"]),
        ({"supported_methods": ["sql", "sql", "pandas", "pyspark"]}, ["supported_methods"]),
        ({"starter_code": {**CODES, "r": "x"}}, ["starter_code"]),
        ({"reference_solutions": {**CODES, "sql": " "}}, ["reference_solutions"]),
    ],
)
def test_analysis_question(spark, changes, broken):
    def check(value):
        return V.analysis_question(value, F.lit("Easy"))

    assert violations(spark, changed(ANALYSIS, **changes), check) == broken


ASSESSMENT = {
    "estimated_percentage_correct": 82,
    "identified_mistakes": ["off by one"],
    "explanation": "fine",
    "suggested_correction": "",
    "corrected_code": None,
}


@pytest.mark.parametrize(
    ("changes", "broken"),
    [
        ({}, []),
        ({"corrected_code": "x"}, []),
        ({"corrected_code": "x" * 12_001}, ["corrected_code"]),
        ({"corrected_code": 1}, ["corrected_code"]),
        ({"estimated_percentage_correct": 101}, ["percent"]),
        ({"estimated_percentage_correct": True}, ["percent"]),
        ({"estimated_percentage_correct": "80"}, ["percent"]),
        ({"identified_mistakes": ["m"] * 21}, ["mistakes"]),
        ({"identified_mistakes": [""]}, ["mistakes"]),
        ({"identified_mistakes": ["m" * 1001]}, ["mistakes"]),
        ({"identified_mistakes": []}, []),
        ({"explanation": ""}, ["explanation"]),
        ({"explanation": "e" * 8001}, ["explanation"]),
        ({"suggested_correction": "s" * 4001}, ["suggestion"]),
        ({"extra": 1}, ["members"]),
    ],
)
def test_assessment(spark, changes, broken):
    assert violations(spark, changed(ASSESSMENT, **changes), V.assessment) == broken


SOLUTION = {"title": "Loop", "code": "# add", "explanation": "e", "theory": "t", "complexity": None}
TEACHING = {"multiple_approaches_meaningful": True, "availability_note": None, "solutions": [SOLUTION]}


@pytest.mark.parametrize(
    ("changes", "question_type", "broken"),
    [
        ({}, "algorithm", []),
        ({}, "data_analysis", []),
        ({"solutions": [SOLUTION, {**SOLUTION, "title": "Map"}]}, "algorithm", []),
        ({"solutions": [SOLUTION, {**SOLUTION, "title": "Map"}]}, "data_analysis", ["count"]),
        ({"solutions": [SOLUTION, {**SOLUTION, "title": "LOOP"}]}, "algorithm", ["titles"]),
        ({"solutions": []}, "algorithm", ["count"]),
        ({"solutions": [], "availability_note": "none"}, "algorithm", []),
        ({"solutions": [{**SOLUTION, "code": "add"}]}, "algorithm", ["comments"]),
        ({"solutions": [{**SOLUTION, "theory": ""}]}, "algorithm", ["solutions"]),
        ({"multiple_approaches_meaningful": "yes"}, "algorithm", ["meaningful"]),
    ],
)
def test_teaching_solutions(spark, changes, question_type, broken):
    def check(value):
        return V.teaching_solutions(value, F.lit("python"), F.lit(question_type))

    assert violations(spark, changed(TEACHING, **changes), check) == broken


ITEM = {
    "domain": "ai",
    "topic": "rag",
    "answer_format": "theory",
    "prompt_style": "direct",
    "difficulty": "Medium",
    "prompt": "Why?",
    "reference_answer": "Because",
    "rubric": ["clear"],
    "method": None,
    "options": [],
    "correct_option": None,
    "tags": [],
}
FOUR = [{"id": i, "text": i * 2} for i in "abcd"]


@pytest.mark.parametrize(
    ("changes", "answer_format", "broken"),
    [
        ({}, "theory", []),
        ({"rubric": []}, "theory", ["rubric"]),
        ({"tags": [" "]}, "theory", ["tags"]),
        ({"answer_format": "coding"}, "coding", ["method"]),
        ({"answer_format": "coding", "method": "sql"}, "coding", []),
        ({"answer_format": "mcq", "options": FOUR, "correct_option": "c"}, "mcq", []),
        ({"answer_format": "mcq", "options": FOUR, "correct_option": "z"}, "mcq", ["options"]),
        ({"answer_format": "mcq", "options": FOUR[:3], "correct_option": "a"}, "mcq", ["options"]),
        ({}, "mcq", ["answer_format", "options"]),
        ({"domain": " "}, "theory", ["domain"]),
    ],
)
def test_interview_item(spark, changes, answer_format, broken):
    def check(value):
        return V.interview_item(value, F.lit("Medium"), F.lit(answer_format), F.lit("direct"))

    assert violations(spark, changed(ITEM, **changes), check) == broken


def test_scores_plans_and_reports(spark):
    assert violations(spark, {"score": 70, "feedback": "ok"}, V.answer_score) == []
    assert violations(spark, {"score": False, "feedback": 1}, V.answer_score) == ["score", "feedback"]
    plan = {"topics": ["a"], "formats": ["mcq"], "languages": []}
    assert violations(spark, plan, V.interview_plan) == []
    assert violations(spark, {**plan, "formats": ["essay"], "topics": []}, V.interview_plan) == [
        "topics",
        "formats",
    ]
    report = {"overall_score": 1.5, "summary": "s", "strengths": [], "gaps": [], "recommendations": []}
    assert violations(spark, report, V.final_report) == []
    assert violations(spark, {**report, "gaps": "x"}, V.final_report) == ["lists"]


def test_choice_sets(spark):
    def question(qid, **changes):
        return {
            "question_id": qid,
            "prompt": "p",
            "options": FOUR,
            "correct_option_id": "a",
            "explanation": "e",
            **changes,
        }

    replies = {
        "good": [question("1"), question("2")],
        "missing": [question("1")],
        "foreign": [question("1"), question("9")],
        "twice": [question("1"), question("1")],
        "same text": [question("1"), question("2", options=[*FOUR[:3], {"id": "d", "text": "AA"}])],
    }
    rows = [(k, json.dumps({"status": "ok", "questions": v})) for k, v in replies.items()]
    rows += [("not json", "nope"), ("bad status", json.dumps({"status": "no", "questions": replies["good"]}))]
    expected = [(k, q) for k, _ in rows for q in ("1", "2")]
    verdicts = V.choice_sets(
        spark.createDataFrame(rows, "quiz_id string, reply string"),
        spark.createDataFrame(expected, "quiz_id string, question_id string"),
    )
    got = {r.quiz_id: r.violations for r in verdicts.collect()}
    assert got == {
        "good": [],
        "missing": ["missing"],
        "foreign": ["missing", "unexpected"],
        "twice": ["missing", "repeated"],
        "same text": ["broken"],
        "not json": ["members", "status", "questions", "missing"],
        "bad status": ["status"],
    }


def test_accepted_and_rejected_partition_the_input(spark):
    rows = [(json.dumps(changed(ASSESSMENT, estimated_percentage_correct=p)),) for p in (10, 200, 30)]
    checked = V.checked(spark.createDataFrame(rows, "reply string"), "reply", V.assessment)
    assert (V.accepted(checked).count(), V.rejected(checked).count()) == (2, 1)


def test_submission_and_settings(spark):
    def names(column):
        return spark.range(1).select(column.alias("v")).first().v

    methods = F.array(F.lit("sql"))
    assert names(V.submission(F.lit("x"), F.lit("sql"), methods)) == []
    assert names(V.submission(F.lit(" "), F.lit("r"), methods)) == ["blank", "unsupported_method"]
    assert names(V.submission(F.repeat(F.lit("x"), 12_001), F.lit("sql"), methods)) == ["too_long"]
    assert names(V.quiz_settings(F.lit(10), F.lit(0))) == []
    assert names(V.quiz_settings(F.lit(11), F.lit(12))) == ["total_items", "coding_items"]
    assert names(V.generation_request(F.lit("algorithm"), F.lit("Easy"), F.lit("sql"), F.lit("t"))) == ["method"]


def test_table_checks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, ref int")
    parents = spark.createDataFrame([(1,)], "id int")
    assert {(r.rule, r.breaches) for r in V.enum_breaches(rows, {"k": ("a",)}).collect()} == {("k", 1)}
    assert [(r.k, r.n) for r in V.duplicate_keys(rows, ["k"]).collect()] == [("a", 2)]
    assert [(r.ref, r.rows) for r in V.orphans(rows, "ref", parents, "id").collect()] == [(2, 1)]


def test_table_report_counts_breaches(spark):
    tables = {
        "questions": spark.createDataFrame(
            [("q1", "algorithm", "Easy", "s1"), ("q2", "essay", "Easy", "s9")],
            "id string, question_type string, difficulty string, source_id string",
        ),
        "question_sources": spark.createDataFrame(
            [("s1", "d", "k", None), ("s2", "d", "k", None)],
            "id string, dataset_name string, source_key string, import_run_id string",
        ),
    }
    got = {(r.check, r.table, r["columns"]): r.breaches for r in V.table_report(tables).collect()}
    assert got == {
        ("enumeration", "questions", "question_type"): 1,
        ("enumeration", "questions", "difficulty"): 0,
        ("unique", "question_sources", "dataset_name,source_key"): 1,
        ("reference", "questions", "source_id"): 1,
    }
