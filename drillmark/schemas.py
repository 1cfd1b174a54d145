"""Fixed vocabulary of the data model and the table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: enumerations and limits of the data model -----------------

ALGORITHM_METHODS = ("python", "javascript/typescript", "java", "cpp")
DATA_ANALYSIS_METHODS = ("sql", "pandas", "pyspark", "polars")
METHODS_BY_TYPE = {
    "algorithm": ALGORITHM_METHODS,
    "data_analysis": DATA_ANALYSIS_METHODS,
}
ALL_METHODS = ALGORITHM_METHODS + DATA_ANALYSIS_METHODS

METHOD_LABELS = {
    "python": "Python",
    "javascript/typescript": "JavaScript/TypeScript",
    "java": "Java",
    "cpp": "C++",
    "sql": "SQL",
    "pandas": "Pandas",
    "pyspark": "PySpark",
    "polars": "Polars",
}
SYNTAX_LANGUAGES = {
    "python": "python",
    "javascript/typescript": "javascript",
    "java": "java",
    "cpp": "cpp",
    "sql": "sql",
    "pandas": "python",
    "pyspark": "python",
    "polars": "python",
}
COMMENT_TOKENS = {
    "python": ("#", "'''", '"""'),
    "javascript/typescript": ("//", "/*"),
    "java": ("//", "/*"),
    "cpp": ("//", "/*"),
    "sql": ("--", "/*"),
    "pandas": ("#", "'''", '"""'),
    "pyspark": ("#", "'''", '"""'),
    "polars": ("#", "'''", '"""'),
}

# Canonical order of the difficulty scale, easiest first.
DIFFICULTIES = ("Beginner", "Easy", "Medium", "Hard", "Very Hard")

ANSWER_FORMATS = ("theory", "coding", "mcq")
PROMPT_STYLES = ("direct", "scenario")
ASSET_TYPES = ("schema", "fixture_data", "expected_result", "starter_code")
REQUIRED_ANALYSIS_ASSETS = ("schema", "fixture_data", "expected_result")
SOURCE_MODES = ("local", "ai", "mixed")
INTERVIEW_TYPES = ("tech", "jd")
INTERVIEW_MINUTES = (30, 45, 60, 90)
GENERATION_ORIGINS = ("ai", "web")
LEGACY_TEST_RESULTS = ("passed", "failed", "error", "timeout", "pending")
UNFINISHED_QUIZ_STATUSES = (
    "preparing",
    "preparation_error",
    "in_progress",
    "evaluating",
    "evaluation_error",
)
QUIZ_STATUSES = UNFINISHED_QUIZ_STATUSES + ("completed",)
SESSION_LEVELS = {"junior": "Easy", "senior": "Hard", "staff": "Very Hard"}
ANY_TOPIC = "general"
NO_ANSWER = "Unanswered"
EMPTY_SESSION_SUMMARY = "No answers were submitted."
EMPTY_SESSION_GAPS = ("No assessed answers",)
EMPTY_SESSION_ADVICE = ("Start another interview and submit answers.",)

SOLVED_PERCENT = 80.0
MAX_QUIZ_ITEMS = 10
MAX_TOPIC_CHARS = 100
MAX_SUBMISSION_CHARS = 12_000
MAX_ERROR_CHARS = 2_000
MAX_REFERENCES = 3
# Texts, list entries, object keys and their characters in a bounded context.
MAX_BOUNDED_CHARS = 12_000
MAX_BOUNDED_ITEMS = 20
MAX_BOUNDED_KEYS = 30
MAX_BOUNDED_KEY_CHARS = 120
MAX_CONTEXT_CHARS = 6_000
MAX_ARCHIVE_MEMBER_BYTES = 2_000_000

# --- Table schemas -----------------------------------------------------------

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DBL, _BOOL, _TS = T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE = _struct(
    dataset_name=_STR,
    source_key=_STR,
    source_file=_STR,
    original_id=_STR,
    source_revision=_STR,
    source_record_index=_LONG,
    license=_STR,
    attribution=_STR,
    import_run_id=_STR,
    legacy_original_id=_STR,
)
ASSET = _struct(asset_type=_STR, content=_STR, method=_STR, content_type=_STR)
SOLUTION = _struct(method=_STR, code=_STR, language=_STR)
TEST_CASE = _struct(input_data=_STR, expected_output=_STR, is_example=_BOOL)

NORMALISED_QUESTION = _struct(
    title=_STR,
    question_type=_STR,
    difficulty=_STR,
    problem_statement=_STR,
    constraints=_STR,
    examples=_STR,
    supported_methods=T.ArrayType(_STR),
    tags=T.ArrayType(_STR),
    source=SOURCE,
    assets=T.ArrayType(ASSET),
    solutions=T.ArrayType(SOLUTION),
    test_cases=T.ArrayType(TEST_CASE),
    is_complete=_BOOL,
)
_TURN = dict(
    session_id=_STR,
    position=_LONG,
    item_id=_STR,
    prompt=_STR,
    options=T.ArrayType(_struct(id=_STR, text=_STR)),
    correct_option=_STR,
    answer_text=_STR,
    selected_option=_STR,
    score=_DBL,
    feedback=_struct(
        strengths=T.ArrayType(_STR), gaps=T.ArrayType(_STR), feedback=_STR, next_focus=_STR
    ),
    web_sources=T.ArrayType(_STR),
    status=_STR,
    answered_at=_TS,
)

TABLES = {
    "import_runs": _struct(
        id=_STR,
        dataset_name=_STR,
        started_at=_TS,
        completed_at=_TS,
        records_imported=_LONG,
        records_skipped=_LONG,
        status=_STR,
        error_message=_STR,
    ),
    "question_sources": _struct(
        id=_STR,
        dataset_name=_STR,
        original_id=_STR,
        source_key=_STR,
        source_file=_STR,
        source_revision=_STR,
        source_record_index=_LONG,
        license=_STR,
        attribution=_STR,
        import_run_id=_STR,
    ),
    "questions": _struct(
        id=_STR,
        title=_STR,
        difficulty=_STR,
        problem_statement=_STR,
        constraints=_STR,
        examples=_STR,
        supported_methods=T.ArrayType(_STR),
        tags=T.ArrayType(_STR),
        source_id=_STR,
        is_ai_generated=_BOOL,
        is_complete=_BOOL,
        question_type=_STR,
    ),
    "question_assets": _struct(
        id=_STR, question_id=_STR, asset_type=_STR, method=_STR, content=_STR, content_type=_STR
    ),
    "reference_solutions": _struct(
        id=_STR, question_id=_STR, method=_STR, code=_STR, language=_STR, is_from_dataset=_BOOL
    ),
    "question_test_cases": _struct(
        id=_STR, question_id=_STR, input_data=_STR, expected_output=_STR, is_example=_BOOL
    ),
    "ai_generated_questions": _struct(
        question_id=_STR,
        provider=_STR,
        model_id=_STR,
        prompt_version=_STR,
        generation_metadata=_STR,
    ),
    "interview_items": _struct(
        id=_STR,
        source_id=_STR,
        domain=_STR,
        topic=_STR,
        answer_format=_STR,
        prompt_style=_STR,
        difficulty=_STR,
        prompt=_STR,
        reference_answer=_STR,
        rubric=T.ArrayType(_STR),
        method=_STR,
        options=T.ArrayType(_struct(id=_STR, text=_STR)),
        correct_option=_STR,
        tags=T.ArrayType(_STR),
        content_hash=_STR,
        is_complete=_BOOL,
    ),
    "interview_item_generation": _struct(
        interview_item_id=_STR,
        origin=_STR,
        provider=_STR,
        model_id=_STR,
        prompt_version=_STR,
        web_sources=_STR,
    ),
    "attempts": _struct(
        id=_STR,
        question_id=_STR,
        attempted_at=_TS,
        method=_STR,
        submitted_code=_STR,
        assessment_status=_STR,
        percentage_correct=_DBL,
        marks=_DBL,
        ai_feedback=_STR,
        error_details=_STR,
        provider=_STR,
        model_id=_STR,
    ),
    "quiz_attempts": _struct(
        id=_STR,
        started_at=_TS,
        completed_at=_TS,
        status=_STR,
        question_source=_STR,
        question_type=_STR,
        difficulty=_STR,
        topic=_STR,
        method=_STR,
        total_items=_INT,
        coding_items=_INT,
        mcq_items=_INT,
        percentage_correct=_DBL,
        passed=_BOOL,
    ),
    "quiz_items": _struct(
        quiz_id=_STR,
        item_id=_STR,
        position=_INT,
        question_id=_STR,
        answer_format=_STR,
        method=_STR,
        prompt_snapshot=_STR,
        options=T.ArrayType(_struct(id=_STR, text=_STR)),
        correct_option_id=_STR,
        explanation=_STR,
        answer_text=_STR,
        selected_option_id=_STR,
        item_status=_STR,
        percentage_correct=_DBL,
        provider=_STR,
        model_id=_STR,
        error_details=_STR,
    ),
    "solution_views": _struct(
        id=_STR,
        question_id=_STR,
        attempt_id=_STR,
        viewed_at=_TS,
        methods_viewed=T.ArrayType(_STR),
    ),
    "ai_question_sessions": _struct(
        session_id=_STR,
        started_at=_TS,
        completed_at=_TS,
        status=_STR,
        source_mode=_STR,
        domain=_STR,
        topic=_STR,
        difficulty=_STR,
        answer_format=_STR,
        prompt_style=_STR,
        method=_STR,
        web_enabled=_BOOL,
        provider=_STR,
        model_id=_STR,
    ),
    "ai_question_items": _struct(**_TURN),
    "interview_sessions": _struct(
        session_id=_STR,
        interview_type=_STR,
        duration_minutes=_INT,
        source_mode=_STR,
        level=_STR,
        topics=T.ArrayType(_STR),
        formats=T.ArrayType(_STR),
        languages=T.ArrayType(_STR),
        web_enabled=_BOOL,
        provider=_STR,
        model_id=_STR,
        status=_STR,
        started_at=_TS,
        deadline_at=_TS,
        completed_at=_TS,
        overall_score=_DBL,
        report=_struct(
            summary=_STR,
            strengths=T.ArrayType(_STR),
            gaps=T.ArrayType(_STR),
            recommendations=T.ArrayType(_STR),
        ),
        error_details=_STR,
    ),
    "interview_turns": _struct(**_TURN, answer_format=_STR, method=_STR),
    "schema_versions": _struct(version=_INT, applied_at=_TS, description=_STR),
}
