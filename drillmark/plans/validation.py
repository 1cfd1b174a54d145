"""Batch validation: each check gives a list of violations per row.

Structured replies come in as a text column.  The text is parsed once into a
VARIANT; member types are tested on it, so a number never passes as a text nor
a boolean as a number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.payload import (
    entries,
    field,
    keys_of,
    kind,
    list_field,
    number_field,
    parse_strict,
    text_field,
    texts_field,
    unfence,
)
from drillmark.functions.scoring import has_comment
from drillmark.functions.text import has_text, strip
from drillmark.operators.barrier import once

# --- Fixed values: members and limits of the structured replies ---------------

ALGORITHM_REQUIRED = (
    "question_type",
    "title",
    "problem_statement",
    "examples",
    "constraints",
    "difficulty",
    "tags",
    "starter_code",
    "test_cases",
)
ALGORITHM_OPTIONAL = ("reference_solution",)
ANALYSIS_REQUIRED = (
    "question_type",
    "title",
    "problem_statement",
    "difficulty",
    "tags",
    "schema_sql",
    "fixture_data",
    "table_name",
    "expected_result",
    "supported_methods",
    "starter_code",
    "reference_solutions",
)
CHOICE_MEMBERS = ("question_id", "prompt", "options", "correct_option_id", "explanation")
ITEM_MEMBERS = (
    "domain",
    "topic",
    "answer_format",
    "prompt_style",
    "difficulty",
    "prompt",
    "reference_answer",
    "rubric",
    "method",
    "options",
    "correct_option",
    "tags",
)
ASSESSMENT_MEMBERS = (
    "estimated_percentage_correct",
    "identified_mistakes",
    "explanation",
    "suggested_correction",
    "corrected_code",
)
TEACHING_MEMBERS = ("multiple_approaches_meaningful", "availability_note", "solutions")
SOLUTION_MEMBERS = ("title", "code", "explanation", "theory", "complexity")

MAX_MISTAKES = 20
MAX_MISTAKE_CHARS = 1_000
MAX_EXPLANATION_CHARS = 8_000
MAX_SUGGESTION_CHARS = 4_000
MAX_CORRECTED_CODE_CHARS = 12_000
MAX_TITLE_CHARS = 120
MAX_CODE_CHARS = 12_000
MAX_THEORY_CHARS = 4_000
MAX_NOTE_CHARS = 1_000


# --- Building blocks ---------------------------------------------------------


def violations(**rules: Column) -> Column:
    """Names of the rules that fail; a rule that cannot be decided fails."""
    broken = [
        F.when(F.coalesce(holds, F.lit(False)), F.lit(None)).otherwise(F.lit(name))
        for name, holds in rules.items()
    ]
    # Not a filter with a lambda: that would take all rules out of code generation.
    return F.array_except(F.array(*broken), F.array(F.lit(None).cast("string")))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _texts(value: Column, *names: str) -> Column:
    """Every named member is a non-blank text."""
    return _all(*[has_text(text_field(value, name)) for name in names])


def _members(value: Column, required, optional=()) -> Column:
    """All required members are there and none beyond the allowed ones."""
    keys = keys_of(value)  # read once: listing the members copies them
    others = F.array_except(keys, F.array(*[F.lit(k) for k in optional])) if optional else keys
    return others == F.array(*[F.lit(k) for k in sorted(required)])


def sound_count(entries_: Column, sound) -> Column:
    """Number of list entries, null when the list is absent or an entry is not sound.

    The list expression is costly and stands here only once.
    """
    return F.aggregate(entries_, F.lit(0), lambda n, entry: n + F.when(sound(entry), 1))


def _text_list(value: Column, name: str, minimum: int = 0) -> Column:
    """The member is a list of non-blank texts of at least ``minimum`` entries."""
    return sound_count(texts_field(value, name), has_text) >= minimum


def _objects(value: Column, name: str, *members: str) -> Column:
    """The member is a non-empty list of objects that have the named members."""
    wanted = F.array(*[F.lit(m) for m in members])

    def complete(row: Column) -> Column:
        return F.size(F.array_except(wanted, keys_of(row))) == 0

    return sound_count(list_field(value, name), complete) > 0


def _is_object(value: Column) -> Column:
    return kind(value).startswith("OBJECT")


def consistent_rows(rows: Column) -> Column:
    """V3: objects with the same, non-empty column names and scalar cells."""
    keys = F.transform(rows, keys_of)
    scalar = F.forall(
        rows,
        lambda r: F.coalesce(
            F.forall(F.map_values(entries(r)), lambda c: ~kind(c).rlike("^(ARRAY|OBJECT)")),
            F.lit(False),
        ),
    )
    named = F.forall(
        keys, lambda k: F.coalesce((F.size(k) > 0) & ~F.array_contains(k, ""), F.lit(False))
    )
    return (F.size(rows) > 0) & named & (F.size(F.array_distinct(keys)) == 1) & scalar


def method_map(value: Column) -> Column:
    """V4: exactly the four analysis methods, each with non-blank code."""
    wanted = F.array(*[F.lit(m) for m in sorted(S.DATA_ANALYSIS_METHODS)])
    return (keys_of(value) == wanted) & _texts(value, *S.DATA_ANALYSIS_METHODS)


def _common_question(value: Column, question_type: str, expected: Column) -> dict[str, Column]:
    return {
        "requested_difficulty": expected.isin(*S.DIFFICULTIES),
        "question_type": text_field(value, "question_type") == question_type,
        "difficulty": text_field(value, "difficulty") == expected,
        "title": _texts(value, "title"),
        "problem_statement": _texts(value, "problem_statement"),
        "tags": _text_list(value, "tags", 1),
    }


# --- Checks of structured replies --------------------------------------------


def algorithm_question(value: Column, expected: Column) -> Column:
    """V1."""
    examples = list_field(value, "examples")

    def complete(example: Column) -> Column:
        keys = keys_of(example)
        return F.array_contains(keys, "input") & (
            F.array_contains(keys, "output") | F.array_contains(keys, "expected_output")
        )

    reference = field(value, "reference_solution")
    return violations(
        object=_is_object(value),
        members=_members(value, ALGORITHM_REQUIRED, ALGORITHM_OPTIONAL),
        **_common_question(value, "algorithm", expected),
        constraints=_texts(value, "constraints"),
        starter_code=_texts(value, "starter_code"),
        examples=sound_count(examples, complete) > 0,
        test_cases=_objects(value, "test_cases", "input", "expected_output"),
        reference_solution=reference.isNull() | _texts(value, "reference_solution"),
    )


def analysis_question(value: Column, expected: Column) -> Column:
    """V2, V3, V4."""
    schema_sql, table = text_field(value, "schema_sql"), text_field(value, "table_name")
    methods = texts_field(value, "supported_methods")
    wanted = F.array(*[F.lit(m) for m in sorted(S.DATA_ANALYSIS_METHODS)])
    return violations(
        object=_is_object(value),
        members=_members(value, ANALYSIS_REQUIRED),
        **_common_question(value, "data_analysis", expected),
        schema_sql=_texts(value, "schema_sql"),
        table_name=_texts(value, "table_name"),
        create_table=F.contains(F.lower(schema_sql), F.lit("create table")),
        table_in_schema=F.contains(F.lower(schema_sql), F.lower(table)),
        fixture_data=consistent_rows(list_field(value, "fixture_data")),
        expected_result=consistent_rows(list_field(value, "expected_result")),
        supported_methods=F.array_sort(methods) == wanted,
        starter_code=method_map(field(value, "starter_code")),
        reference_solutions=method_map(field(value, "reference_solutions")),
    )


def _four_options(options: Column, exact: bool) -> Column:
    """Four options with distinct ids, non-blank texts; ``exact`` allows no other members."""

    def sound(option: Column) -> Column:
        named = text_field(option, "id").isNotNull() & _texts(option, "text")
        if exact:
            named = named & _texts(option, "id") & _members(option, ("id", "text"))
        return named

    distinct = F.size(F.array_distinct(_option_ids(options))) == 4
    return (sound_count(options, sound) == 4) & distinct


def _option_ids(options: Column) -> Column:
    return F.transform(options, lambda o: text_field(o, "id"))


def choice_question(question: Column) -> Column:
    """One question of a choice set."""
    options = list_field(question, "options")
    texts = F.transform(options, lambda o: F.lower(text_field(o, "text")))
    return violations(
        members=_members(question, CHOICE_MEMBERS),
        options=_four_options(options, exact=True),
        option_texts=F.size(F.array_distinct(texts)) == 4,
        correct_option=F.array_contains(_option_ids(options), text_field(question, "correct_option_id")),
        prompt=_texts(question, "prompt"),
        explanation=_texts(question, "explanation"),
    )


def choice_sets(replies: DataFrame, expected: DataFrame, text: str = "reply") -> DataFrame:
    """Verdict per quiz of a generated choice set.

    ``expected`` lists (quiz_id, question_id).  Generated and expected ids meet
    in a full outer join: an id on one side only, or twice, is a violation.
    """
    value = F.col("_value")
    parsed = once(replies, "_value", parse_strict(strip(F.col(text)))).select(
        "quiz_id",
        violations(
            members=_members(value, ("status", "questions")),
            status=text_field(value, "status") == "ok",
            questions=list_field(value, "questions").isNotNull(),
        ).alias("reply_violations"),
        list_field(value, "questions").alias("questions"),
    )
    offered = parsed.select("quiz_id", F.explode_outer("questions").alias("question")).filter(
        F.col("question").isNotNull()
    ).select(
        "quiz_id",
        text_field(F.col("question"), "question_id").alias("question_id"),
        choice_question(F.col("question")).alias("question_violations"),
    )
    counted = offered.groupBy("quiz_id", "question_id").agg(
        F.count("*").alias("times"),
        F.count_if(F.size("question_violations") > 0).alias("broken"),
    )
    wanted = expected.select("quiz_id", "question_id").distinct().withColumn("wanted", F.lit(True))
    matched = counted.join(wanted, ["quiz_id", "question_id"], "full_outer")
    per_quiz = matched.groupBy("quiz_id").agg(
        F.count_if(F.col("times").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("unexpected"),
        F.count_if(F.col("times") > 1).alias("repeated"),
        F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"),
    )
    counts = ("missing", "unexpected", "repeated", "broken")
    flaws = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in counts]))
    return (
        parsed.drop("questions")
        .join(per_quiz, "quiz_id", "left")
        .select(
            "quiz_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            F.concat("reply_violations", flaws).alias("violations"),
        )
    )


def interview_item(value: Column, difficulty: Column, answer_format: Column, style: Column) -> Column:
    """V6."""
    options = list_field(value, "options")
    sound_options = _four_options(options, exact=False) & F.array_contains(
        _option_ids(options), text_field(value, "correct_option")
    )
    return violations(
        members=_members(value, ITEM_MEMBERS),
        difficulty=(text_field(value, "difficulty") == difficulty) & difficulty.isin(*S.DIFFICULTIES),
        answer_format=(text_field(value, "answer_format") == answer_format)
        & answer_format.isin(*S.ANSWER_FORMATS),
        prompt_style=(text_field(value, "prompt_style") == style) & style.isin(*S.PROMPT_STYLES),
        domain=_texts(value, "domain"),
        topic=_texts(value, "topic"),
        prompt=_texts(value, "prompt"),
        reference_answer=_texts(value, "reference_answer"),
        rubric=_text_list(value, "rubric", 1),
        tags=_text_list(value, "tags"),
        method=(answer_format != "coding") | text_field(value, "method").isNotNull(),
        options=(answer_format != "mcq") | F.coalesce(sound_options, F.lit(False)),
    )


def assessment(value: Column) -> Column:
    """V7."""
    mistakes = texts_field(value, "identified_mistakes")
    explanation = text_field(value, "explanation")
    code = text_field(value, "corrected_code")
    no_code = kind(field(value, "corrected_code")) == "VOID"
    return violations(
        members=_members(value, ASSESSMENT_MEMBERS),
        mistakes=sound_count(mistakes, lambda m: has_text(m) & (F.length(m) <= MAX_MISTAKE_CHARS))
        <= MAX_MISTAKES,
        explanation=has_text(explanation) & (F.length(explanation) <= MAX_EXPLANATION_CHARS),
        suggestion=F.length(text_field(value, "suggested_correction")) <= MAX_SUGGESTION_CHARS,
        corrected_code=no_code | (F.length(code) <= MAX_CORRECTED_CODE_CHARS),
        percent=number_field(value, "estimated_percentage_correct").between(0, 100),
    )


def teaching_solutions(value: Column, method: Column, question_type: Column) -> Column:
    """V8, T41."""
    solutions = list_field(value, "solutions")
    note = text_field(value, "availability_note")
    no_note = kind(field(value, "availability_note")) == "VOID"
    titles = F.transform(solutions, lambda s: F.lower(strip(text_field(s, "title"))))

    def bounded(solution: Column, name: str, limit: int, nullable: bool = False) -> Column:
        text = text_field(solution, name)
        holds = has_text(text) & (F.length(text) <= limit)
        return (holds | (kind(field(solution, name)) == "VOID")) if nullable else holds

    def sound(solution: Column) -> Column:
        return (
            _members(solution, SOLUTION_MEMBERS)
            & bounded(solution, "title", MAX_TITLE_CHARS)
            & bounded(solution, "code", MAX_CODE_CHARS)
            & bounded(solution, "explanation", MAX_THEORY_CHARS)
            & bounded(solution, "theory", MAX_THEORY_CHARS)
            & bounded(solution, "complexity", MAX_NOTE_CHARS, nullable=True)
        )

    most = F.when(question_type == "algorithm", 3).otherwise(1)
    return violations(
        members=_members(value, TEACHING_MEMBERS),
        meaningful=kind(field(value, "multiple_approaches_meaningful")) == "BOOLEAN",
        note=no_note | (has_text(note) & (F.length(note) <= MAX_NOTE_CHARS)),
        count=(F.size(solutions) <= most)
        & ((F.size(solutions) > 0) | has_text(note)),
        solutions=sound_count(solutions, sound).isNotNull(),
        titles=F.size(F.array_distinct(titles)) == F.size(solutions),
        comments=F.forall(solutions, lambda s: has_comment(text_field(s, "code"), method)),
    )


def answer_score(value: Column) -> Column:
    """V9."""
    return violations(
        object=_is_object(value),
        score=number_field(value, "score").between(0, 100),
        feedback=text_field(value, "feedback").isNotNull(),
    )


def interview_plan(value: Column) -> Column:
    """V9."""
    formats = texts_field(value, "formats")
    return violations(
        object=_is_object(value),
        topics=F.size(list_field(value, "topics")) > 0,
        formats=sound_count(formats, lambda f: f.isin(*S.ANSWER_FORMATS)) > 0,
        languages=_text_list(value, "languages"),
    )


def final_report(value: Column) -> Column:
    """V9."""
    lists = [list_field(value, n).isNotNull() for n in ("strengths", "gaps", "recommendations")]
    return violations(
        object=_is_object(value),
        overall_score=number_field(value, "overall_score").between(0, 100),
        summary=text_field(value, "summary").isNotNull(),
        lists=_all(*lists),
    )


def checked(df: DataFrame, text: str, check, unwrap=unfence) -> DataFrame:
    """Parse a reply column once and add its ``violations``.

    ``check`` maps the parsed VARIANT column to a violation list.  Question
    replies (V1, V2) take ``unfence``, the others ``unfence_json``.
    """
    parsed = once(df, "_value", parse_strict(unwrap(F.col(text))))
    found = F.when(F.col("_value").isNull(), F.array(F.lit("malformed_json"))).otherwise(
        check(F.col("_value"))
    )
    return once(parsed, "violations", found).drop("_value")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") == 0)


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame) -> DataFrame:
    """Rows per violated rule."""
    return (
        df.select(F.explode_outer("violations").alias("violation"))
        .filter(F.col("violation").isNotNull())
        .groupBy("violation")
        .agg(F.count("*").alias("n"))
    )


# --- Checks of submissions, settings and tables ------------------------------


def submission(code: Column, method: Column, supported: Column) -> Column:
    """V10."""
    return violations(
        blank=has_text(code),
        too_long=F.length(code) <= S.MAX_SUBMISSION_CHARS,
        unsupported_method=F.array_contains(supported, method),
    )


def quiz_settings(total: Column, coding: Column) -> Column:
    """V15."""
    return violations(
        total_items=total.between(1, S.MAX_QUIZ_ITEMS),
        coding_items=coding.between(0, total),
    )


def generation_request(question_type: Column, difficulty: Column, method: Column, topic: Column) -> Column:
    """Selections of a generation request."""
    methods = lookup_methods(question_type)
    return violations(
        question_type=question_type.isin(*S.METHODS_BY_TYPE),
        difficulty=difficulty.isin(*S.DIFFICULTIES),
        method=F.array_contains(methods, method),
        topic=F.length(topic) <= S.MAX_TOPIC_CHARS,
    )


def lookup_methods(question_type: Column) -> Column:
    return (
        F.when(question_type == "algorithm", F.array(*map(F.lit, S.ALGORITHM_METHODS)))
        .when(question_type == "data_analysis", F.array(*map(F.lit, S.DATA_ANALYSIS_METHODS)))
    )


def method_rule(question_type: Column, supported: Column) -> Column:
    """A curated question offers all methods of its type, in order."""
    wanted = lookup_methods(question_type)
    return wanted.isNull() | F.coalesce(supported == wanted, F.lit(False))


# Enumerated columns of the tables.
ENUMERATIONS = {
    ("questions", "question_type"): tuple(S.METHODS_BY_TYPE),
    ("questions", "difficulty"): S.DIFFICULTIES,
    ("interview_items", "answer_format"): S.ANSWER_FORMATS,
    ("interview_items", "prompt_style"): S.PROMPT_STYLES,
    ("interview_items", "difficulty"): S.DIFFICULTIES,
    ("question_assets", "asset_type"): S.ASSET_TYPES,
    ("attempts", "test_result"): S.LEGACY_TEST_RESULTS,
    ("interview_item_generation", "origin"): S.GENERATION_ORIGINS,
    ("ai_question_sessions", "source_mode"): S.SOURCE_MODES,
    ("interview_sessions", "interview_type"): S.INTERVIEW_TYPES,
    ("interview_sessions", "duration_minutes"): S.INTERVIEW_MINUTES,
    ("interview_sessions", "source_mode"): S.SOURCE_MODES,
}


def enum_breaches(df: DataFrame, allowed: dict[str, tuple]) -> DataFrame:
    """Per column, rows whose value is outside its enumeration (null passes)."""
    counts = df.agg(
        *[F.count_if(~F.col(c).isin(*values)).alias(c) for c, values in allowed.items()]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("rule"), F.col(c).alias("breaches")) for c in allowed]
    )
    return counts.select(F.inline(pairs))


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent.

    The child is cut to one row per reference first, with its row count, so a
    reference shared by very many rows is looked up once.
    """
    references = (
        child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    )
    return references.join(parent.select(F.col(key).alias(column)), column, "left_anti")


# Keys that occur once, and references between the tables.
UNIQUE_KEYS = (
    ("question_sources", ("dataset_name", "source_key")),
    ("interview_items", ("content_hash",)),
    ("quiz_items", ("quiz_id", "position")),
    ("quiz_items", ("quiz_id", "question_id")),
    ("ai_question_items", ("session_id", "position")),
    ("interview_turns", ("session_id", "position")),
)
REFERENCES = (
    ("question_sources", "import_run_id", "import_runs", "id"),
    ("questions", "source_id", "question_sources", "id"),
    ("interview_items", "source_id", "question_sources", "id"),
    ("question_assets", "question_id", "questions", "id"),
    ("reference_solutions", "question_id", "questions", "id"),
    ("question_test_cases", "question_id", "questions", "id"),
    ("ai_generated_questions", "question_id", "questions", "id"),
    ("attempts", "question_id", "questions", "id"),
    ("solution_views", "question_id", "questions", "id"),
    ("solution_views", "attempt_id", "attempts", "id"),
    ("quiz_items", "quiz_id", "quiz_attempts", "id"),
    ("quiz_items", "question_id", "questions", "id"),
    ("interview_item_generation", "interview_item_id", "interview_items", "id"),
    ("ai_question_items", "interview_item_id", "interview_items", "id"),
    ("interview_turns", "interview_item_id", "interview_items", "id"),
)


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Breaches of every rule whose tables are given.

    One row per rule: (check, table, columns, breaches); repeated keys count
    once each, orphans count their rows.
    """
    parts = []

    def add(counts: DataFrame, check: str, table: str, columns: str) -> None:
        parts.append(
            counts.select(
                F.lit(check).alias("check"),
                F.lit(table).alias("table"),
                F.lit(columns).alias("columns"),
                F.coalesce("breaches", F.lit(0)).cast("long").alias("breaches"),
            )
        )

    for (table, column), values in ENUMERATIONS.items():
        if table in tables and column in tables[table].columns:
            add(enum_breaches(tables[table], {column: values}), "enumeration", table, column)
    for table, key in UNIQUE_KEYS:
        if table in tables:
            repeated = duplicate_keys(tables[table], key).agg(F.count("*").alias("breaches"))
            add(repeated, "unique", table, ",".join(key))
    for table, column, parent, key in REFERENCES:
        if table in tables and parent in tables:
            lost = orphans(tables[table], column, tables[parent], key)
            add(lost.agg(F.sum("rows").alias("breaches")), "reference", table, column)
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
