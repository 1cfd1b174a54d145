"""Progress, catalog, retrieval and practice on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from drillmark.functions.payload import nested_rows
from drillmark.plans import backfill, catalog, practice, progress, retrieval


def at(day):
    return datetime.datetime(2024, 1, day)


# --- Progress ----------------------------------------------------------------


@pytest.fixture(scope="module")
def learner(spark):
    questions = spark.createDataFrame(
        [("q1", "Alpha", "algorithm", "Easy"), ("q2", "Beta", "data_analysis", "Hard")],
        "id string, title string, question_type string, difficulty string",
    )
    attempts = spark.createDataFrame(
        [
            ("a1", "q1", "python", "completed", 79.0, 7.9, at(1)),
            ("a2", "q1", "java", "completed", 80.0, 8.0, at(2)),
            ("a3", "q2", "sql", "completed", 90.0, 9.0, at(3)),
            ("a4", "q2", "sql", "error", None, None, at(3)),
        ],
        "id string, question_id string, method string, assessment_status string, "
        "percentage_correct double, marks double, attempted_at timestamp",
    )
    return attempts, questions


def test_progress_summary_filters(learner):
    def numbers(**filters):
        row = progress.progress_summary(*learner, **filters).first()
        return row.total_attempts, row.attempted_questions, row.solved_questions, row.assessed_questions

    assert numbers() == (4, 2, 2, 2)
    assert numbers(method="sql") == (2, 1, 1, 1)
    assert numbers(question_type="algorithm", difficulty="Easy", method="python") == (1, 1, 0, 1)
    assert numbers(method="cpp") == (0, 0, 0, 0)


def test_attempt_lists(learner):
    assert [r.id for r in progress.recent_attempts(*learner).collect()] == ["a4", "a3", "a2", "a1"]
    assert [r.id for r in progress.attempt_history(*learner).collect()] == ["a2", "a1", "a4", "a3"]
    assert [r.id for r in progress.question_attempts(learner[0], "q1").collect()] == ["a2", "a1"]
    assert progress.marks_table(*learner).count() == 3
    flags = {r.title: (r.attempts, r.solved) for r in progress.question_flags(*learner).collect()}
    assert flags == {"Alpha": (2, True), "Beta": (2, True)}


def test_quiz_progress(spark):
    quizzes = spark.createDataFrame(
        [("z1", "completed", "Easy", True), ("z2", "completed", "Hard", False), ("z3", "preparing", "Easy", None)],
        "id string, status string, difficulty string, passed boolean",
    )
    row = progress.quiz_progress(quizzes).first()
    assert (row.total_attempts, row.completed_attempts, row.passed_attempts) == (3, 2, 1)
    assert progress.quiz_progress(quizzes, difficulty="Hard").first().passed_attempts == 0


def test_views_link_only_to_their_question(spark, learner):
    views = spark.createDataFrame(
        [("v1", "q1", "a1"), ("v2", "q1", "a3"), ("v3", "q2", None)],
        "id string, question_id string, attempt_id string",
    )
    linked = progress.link_views(views, learner[0])
    assert {(r.id, r.attempt_id) for r in linked.collect()} == {("v1", "a1"), ("v2", None), ("v3", None)}
    viewed = {r.id for r in progress.flag_viewed(learner[0], linked).filter("solution_viewed").collect()}
    assert viewed == {"a1"}


def test_viewed_methods_keep_first_seen_order(spark):
    rows = [("v", m, at(d), d) for d, m in ((1, "sql"), (2, "pandas"), (3, "sql"), (4, "polars"))]
    events = spark.createDataFrame(rows, "view_id string, method string, viewed_at timestamp, event_id int")
    assert progress.viewed_methods(events).first().methods_viewed == ["sql", "pandas", "polars"]


# --- Catalog -----------------------------------------------------------------


@pytest.fixture(scope="module")
def questions(spark):
    rows = [
        ("1", "B", "algorithm", "Easy", ["python"], ["graph"], False, True),
        ("2", "A", "algorithm", "Easy", ["python"], ["sort"], False, True),
        ("3", "C", "algorithm", "Easy", ["python"], ["graph"], True, True),
        ("4", "D", "algorithm", "Easy", ["java"], ["graph"], False, True),
        ("5", "E", "algorithm", "Very Hard", ["python"], None, False, True),
        ("6", "F", "algorithm", "Beginner", ["python"], ["heap"], False, False),
        ("7", "G", "algorithm", "Beginner", ["python"], [None, "tree"], False, True),
    ]
    return spark.createDataFrame(
        rows,
        "id string, title string, question_type string, difficulty string, supported_methods array<string>, "
        "tags array<string>, is_ai_generated boolean, is_complete boolean",
    )


def test_picker_and_facets(questions):
    def page(topic="general"):
        return [r.id for r in catalog.picker_page(questions, "algorithm", "Easy", "python", topic).collect()]

    assert page() == ["2", "1"] and page("graph") == ["1"] and page("none") == []
    topics = catalog.available_topics(questions, "algorithm", "Easy", "python").collect()
    assert [r.topic for r in topics] == ["graph", "sort"]
    levels = catalog.available_difficulties(questions, "algorithm", "python").collect()
    assert [r.difficulty for r in levels] == ["Beginner", "Easy", "Very Hard"]
    assert catalog.curated_count(questions, "algorithm", "Very Hard", "python", "graph").first().n == 0
    assert catalog.by_id(questions, "4").first().title == "D"


def test_pending_datasets(spark, questions):
    configured = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset_name string")
    runs = spark.createDataFrame(
        [("a", "r1", at(1), "completed"), ("a", "r2", at(2), "failed"), ("b", "r3", at(1), "completed")],
        "dataset_name string, id string, started_at timestamp, status string",
    )
    none = runs.limit(0)

    def pending(log, rows):
        return sorted(r.dataset_name for r in catalog.pending_datasets(log, configured, rows).collect())

    assert pending(runs, questions) == ["a", "c"]
    assert pending(none, questions) == []
    assert pending(none, questions.limit(0)) == ["a", "b", "c"]


def test_learning_modes(questions):
    def modes(method):
        return catalog.learning_modes(questions, "algorithm", method, ("dataset", "ai_generated")).first()[0]

    assert modes("java") == ["dataset", "ai_generated"] and modes("sql") == ["ai_generated"]


def test_examples_fall_back_to_cases(spark):
    asked = spark.createDataFrame([("q", None), ("r", "[1]")], "id string, examples string")
    cases = spark.createDataFrame(
        [("q", str(i), i == 4) for i in range(5)] + [("r", "9", True)],
        "question_id string, id string, is_example boolean",
    )
    rows = catalog.examples_of(asked, cases).orderBy("example_no").collect()
    assert [r.id for r in rows] == ["4", "0", "1"]


# --- Retrieval ---------------------------------------------------------------


def test_context_is_packed_within_its_budget(spark):
    rows = [(str(i), "s1", f"T{i}", "data_analysis", "Hard", "x" * 900, ["tag"], False, i != 0) for i in range(5)]
    rows.append(("g", "s1", "A", "data_analysis", "Easy", "window topic", ["tag"], True, True))
    rows.append(("t", "s1", "Z", "data_analysis", "Easy", "a Window here", ["tag"], False, True))
    corpus = spark.createDataFrame(
        rows,
        "id string, source_id string, title string, question_type string, difficulty string, "
        "problem_statement string, tags array<string>, is_ai_generated boolean, is_complete boolean",
    )
    sources = spark.createDataFrame([("s1", "set")], "id string, dataset_name string")
    assets = spark.createDataFrame(
        [("0", "b", "schema", "late"), ("0", "a", "schema", "CREATE TABLE t")],
        "question_id string, id string, asset_type string, content string",
    )
    solutions = spark.createDataFrame(
        [("0", "a", "sql", "SELECT 1")], "question_id string, id string, method string, code string"
    )
    requests = [retrieval.Request("data_analysis", "Hard", "window"), retrieval.Request("algorithm", "Hard")]
    top = retrieval.top_references_batch(corpus, sources, requests)
    ranked = [(r.request_no, r.question_id, r.score) for r in top.orderBy("request_no", "place").collect()]
    assert ranked == [(1, "t", 4), (1, "0", 2), (1, "1", 2)]
    single = retrieval.top_references(corpus, sources, requests[0]).collect()
    assert [r.question_id for r in single] == ["t", "0", "1"]
    assert len(single[1].problem_statement) == 600 and single[1].problem_statement.endswith("…")
    full = retrieval.with_first_assets(top, assets, solutions)
    assert full.filter("question_id = '0'").first().schema_sql == "CREATE TABLE t"
    wide = retrieval.pack_references(full)
    import json

    document = retrieval.packed_context(wide).first().context
    entries = json.loads(document)
    assert [e["title"] for e in entries] == ["Z", "T0", "T1"]
    assert set(entries[0]) == {"title", "difficulty", "problem_statement", "tags"}
    # The running length is that of the spaced serialisation of the list.
    assert wide.orderBy(F.desc("place")).first().running_chars == len(json.dumps(entries, ensure_ascii=False))
    assert retrieval.pack_references(full, budget=200).count() == 1
    flags = {r.request_no: (r.few_references, r.topic_missing) for r in retrieval.needs_research(
        retrieval.request_frame(spark, requests), top).collect()}
    assert flags == {1: (False, False), 2: (True, False)}


def test_web_references(spark):
    reply = (
        '{"data": {"web": [{"title": " T ", "url": "http://a", "markdown": "m"}, {"url": "ftp://b"},'
        ' {"url": "https://c", "description": "", "content": "body"}]}}'
    )
    df = spark.createDataFrame([(reply,)], "r string")
    rows = df.select(F.inline(retrieval.clean_references(nested_rows(F.col("r"))))).collect()
    assert [(r.title, r.url, r.excerpt) for r in rows] == [("T", "http://a", "m"), ("https://c", "https://c", "body")]


# --- Practice ----------------------------------------------------------------


def test_quiz_scoring(spark):
    items = spark.createDataFrame(
        [
            ("z1", "coding", None, None, "code", 80.0, "pending", None),
            ("z1", "mcq", "b", "b", None, None, "pending", None),
            ("z2", "coding", None, None, "code", None, "pending", None),
            ("z2", "coding", None, None, " ", 55.0, "pending", None),
            ("z3", "mcq", "a", "b", None, None, "scored", 61.0),
        ],
        "quiz_id string, answer_format string, selected_option_id string, correct_option_id string, "
        "answer_text string, reviewed_percent double, item_status string, percentage_correct double",
    )
    scored = practice.score_items(items)
    assert sorted(r.percentage_correct for r in scored.filter("quiz_id <> 'z2'").collect()) == [61.0, 80.0, 100.0]
    quizzes = spark.createDataFrame([("z1",), ("z2",), ("z3",), ("z4",)], "quiz_id string")
    got = {r.quiz_id: (r.status, r.percentage_correct, r.passed) for r in practice.score_quizzes(quizzes, scored).collect()}
    assert got == {
        "z1": ("completed", 90.0, True),
        "z2": ("evaluation_error", None, None),
        "z3": ("completed", 61.0, False),
        "z4": ("preparing", None, None),
    }


def test_quiz_assembly_and_shortage(spark, questions):
    requests = spark.createDataFrame(
        [
            ("ok", "algorithm", "Easy", "python", "general", 2, 1),
            ("short", "algorithm", "Easy", "python", "graph", 2, 1),
            ("none", "algorithm", "Easy", "cpp", "general", 1, 0),
        ],
        "quiz_id string, question_type string, difficulty string, method string, topic string, "
        "total_items int, coding_items int",
    )
    items = practice.assemble_quizzes(requests, questions, "s").orderBy("position").collect()
    assert [(r.quiz_id, r.position, r.answer_format) for r in items] == [("ok", 1, "coding"), ("ok", 2, "mcq")]
    assert {r.question_id for r in items} == {"1", "2"}
    short = {(r.quiz_id, r.available) for r in practice.shortages(requests, questions).collect()}
    assert short == {("short", 1), ("none", 0)}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        ("s", i, f"i{i}", f"p{i}", "theory", None, f"a{i}", None, 10.0 * i, ([f"g{i}"], "next"), "scored")
        for i in range(1, 5)
    ]
    rows.append(("s", 5, "i5", "p5", "mcq", None, None, None, None, None, "pending"))
    rows.append(("t", 1, "i1", "p", "theory", None, None, None, None, None, "pending"))
    return spark.createDataFrame(
        rows,
        "session_id string, position int, item_id string, prompt string, answer_format string, method string, "
        "answer_text string, selected_option string, score double, "
        "feedback struct<gaps: array<string>, next_focus: string>, status string",
    )


def test_last_three_scored_turns(turns):
    row = practice.adaptive_context(turns).first()
    assert [t.position for t in row.recent_scored_turns] == [2, 3, 4]
    assert row.recent_scored_turns[0].gaps == ["g2"] and row.recent_scored_turns[2].answer == "a4"
    pending = {r.session_id: r.position for r in practice.pending_items(turns).collect()}
    assert pending == {"s": 5, "t": 1}


def test_skip_and_close(spark, turns):
    skipped = practice.skip_pending(turns)
    assert {(r.status, r.score) for r in skipped.filter("position = 5").collect()} == {("skipped", 0.0)}
    sessions = spark.createDataFrame([("s",), ("t",)], "session_id string")
    closed = {r.session_id: r for r in practice.close_sessions(sessions, skipped).collect()}
    assert closed["s"].overall_score == 25.0 and closed["s"].scored_turns == 4
    assert closed["t"].overall_score == 0.0 and closed["t"].summary == "No answers were submitted."


def test_answers_touch_pending_turns_only(spark, turns):
    answers = spark.createDataFrame(
        [("s", "i5", "b", None, at(1)), ("s", "i1", "late", 99.0, at(1)), ("t", "i1", "  ", 50.0, at(1))],
        "session_id string, item_id string, answer string, assessed_score double, answered_at timestamp",
    )
    full = turns.withColumns({"correct_option": F.lit("b"), "answered_at": F.lit(None).cast("timestamp")})
    got = {(r.session_id, r.position): r for r in practice.submit_answers(full, answers).collect()}
    assert (got["s", 5].status, got["s", 5].score, got["s", 5].selected_option) == ("scored", 100.0, "b")
    assert got["s", 1].score == 10.0 and got["t", 1].status == "pending"


def test_session_plan(spark):
    session = spark.createDataFrame(
        [("s", ["theory", "coding"], [], ["java"], "senior", "mixed")],
        "session_id string, formats array<string>, topics array<string>, languages array<string>, "
        "level string, source_mode string",
    )
    rows = practice.plan_sessions(session, 3).orderBy("position").collect()
    assert [(r.answer_format, r.method, r.use_local) for r in rows] == [
        ("theory", None, True),
        ("coding", "java", False),
        ("theory", None, True),
    ]
    assert rows[0].topic == "AI engineering" and rows[0].difficulty == "Hard"


def test_attempt_lifecycle(spark):
    rows = [
        ("a", 1, "pending", "code", None, None),
        ("a", 2, "error", None, None, "x" * 3000),
        ("a", 3, "completed", "changed", 70.0, None),
        ("b", 1, "pending", "other", None, None),
        ("b", 2, "error", None, None, "x" * 3000),
    ]
    events = spark.createDataFrame(
        rows,
        "attempt_id string, seq int, status string, submitted_code string, percentage_correct double, error string",
    )
    got = {r.attempt_id: r for r in practice.attempt_states(events).collect()}
    assert (got["a"].submitted_code, got["a"].percentage_correct, got["a"].error_details) == ("code", 70.0, None)
    assert got["b"].status == "error" and len(got["b"].error_details) == 2000


def test_backfills(spark):
    attempts = spark.createDataFrame(
        [("1", None, "failed"), ("2", None, None), ("3", "completed", "passed")],
        "id string, assessment_status string, test_result string",
    )
    got = {r.id: r.assessment_status for r in backfill.legacy_status(attempts).collect()}
    assert got == {"1": "legacy_failed", "2": None, "3": "completed"}
    versions = spark.createDataFrame([], "version int")
    assert backfill.schema_version(versions).first().version == 0
