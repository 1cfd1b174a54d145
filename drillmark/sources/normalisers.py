"""Raw question records to the normalised question row.

A raw frame has ``source_file`` (path below the data root), ``record_index``,
``source_revision`` and a VARIANT ``record``.  The result has the columns of
``schemas.NORMALISED_QUESTION``.  Records without identity or statement come
out with a blank ``problem_statement``; the import counts them as skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.payload import as_text, field, kind, list_field
from drillmark.functions.scoring import lookup
from drillmark.functions.text import (
    first_filled,
    heading_title,
    is_blank,
    non_empty,
    slug_title,
    source_key,
    sql_title,
)
from drillmark.sources.archives import decode_archives
from drillmark.sources.literals import json_or_literal
from drillmark.sources.specs import QuestionCorpus

# Difficulty words of each source (any other word means Medium).
DIFFICULTY_BY_SOURCE = {
    "leetcode": {"easy": "Easy", "medium": "Medium", "hard": "Hard"},
    "apps": {"introductory": "Easy", "interview": "Medium", "competition": "Hard"},
    "taco": {
        "beginner": "Beginner",
        "easy": "Easy",
        "medium": "Medium",
        "hard": "Hard",
        "very hard": "Very Hard",
    },
    "codecontests": {
        "beginner": "Beginner",
        "easy": "Easy",
        "medium": "Medium",
        "hard": "Hard",
        "very_hard": "Very Hard",
        "very hard": "Very Hard",
    },
}

# How many cases and solutions of a record are stored at most; None stores all.
# What a document shows of them is limited where it is shown.
MAX_CASES: int | None = None
MAX_ARCHIVE_CASES: int | None = None
MAX_SOLUTIONS: int | None = None

_RECORD = "record"


def member(name: str) -> Column:
    """A record member as text: strings as they are, other values as JSON."""
    return F.try_variant_get(F.col(_RECORD), f"$.{name}", "string")


def native(name: str) -> Column:
    """A record member as VARIANT, decoded when it is JSON held in a string."""
    value = field(F.col(_RECORD), name)
    text = as_text(value)
    return F.when(text.isNotNull(), F.try_parse_json(text)).otherwise(value)


def _text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def difficulty_of(source: str, word: Column) -> Column:
    """T5."""
    return lookup(F.lower(F.coalesce(word, F.lit("medium"))), DIFFICULTY_BY_SOURCE[source], F.lit("Medium"))


def _empty(kind_: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind_}>")


_ASSETS = S.ASSET.simpleString()
_SOLUTIONS = S.SOLUTION.simpleString()
_CASES = S.TEST_CASE.simpleString()


def asset_list(asset_type: str, content: Column, method: str | None, content_type: str) -> Column:
    """One asset when there is content, none otherwise."""
    one = F.array(
        F.struct(
            F.lit(asset_type).alias("asset_type"),
            content.alias("content"),
            F.lit(method).cast("string").alias("method"),
            F.lit(content_type).alias("content_type"),
        )
    )
    return F.when(~F.coalesce(content == "", F.lit(True)), one).otherwise(_empty(_ASSETS))


def solution_list(method: str, codes: Column) -> Column:
    return F.transform(
        codes,
        lambda code: F.struct(
            F.lit(method).alias("method"), code.alias("code"), F.lit(method).alias("language")
        ),
    )


def _first(rows: Column, limit: int | None) -> Column:
    return rows if limit is None else F.slice(rows, 1, limit)


def code_list(value: Column, limit: int | None = MAX_SOLUTIONS) -> Column:
    """Of the entries, or the first ``limit``, those that are non-blank texts."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    codes = F.transform(_first(listed, limit), as_text)
    kept = F.filter(codes, lambda c: ~is_blank(c))
    return F.coalesce(kept, F.array().cast("array<string>"))


def _case(given: Column, wanted: Column) -> Column:
    return F.struct(
        F.coalesce(F.to_json(given), F.lit("null")).alias("input_data"),
        F.coalesce(F.to_json(wanted), F.lit("null")).alias("expected_output"),
        F.lit(False).alias("is_example"),
    )


def zipped_cases(io: Column, limit: int | None) -> Column:
    """Inputs paired with outputs up to the shorter list, and the limit if there is one."""
    inputs, outputs = list_field(io, "inputs"), list_field(io, "outputs")
    pairs = F.arrays_zip(inputs.alias("i"), outputs.alias("o"))
    count = F.least(F.size(inputs), F.size(outputs))
    paired = _first(F.slice(pairs, F.lit(1), count), limit)
    cases = F.transform(paired, lambda p: _case(p["i"], p["o"]))
    return F.coalesce(cases, _empty(_CASES))


def listed_cases(rows: Column, limit: int | None) -> Column:
    """Cases given as ``[{input, output}]``; other entries are left out."""
    objects = F.filter(_first(rows, limit), lambda r: kind(r).startswith("OBJECT"))
    cases = F.transform(objects, lambda r: _case(field(r, "input"), field(r, "output")))
    return F.coalesce(cases, _empty(_CASES))


def text_list(value: Column) -> Column:
    """Array entries as text, an empty array for anything else."""
    texts = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda x: F.try_variant_get(x, "$", "string"),
    )
    return F.coalesce(texts, F.array().cast("array<string>"))


def _question(
    spec: QuestionCorpus,
    run_id: str,
    *,
    identity: list[Column],
    original_id: Column | None,
    legacy_id: Column,
    title: Column,
    difficulty: Column,
    statement: Column,
    tags: Column | None = None,
    assets: Column | None = None,
    solutions: Column | None = None,
    cases: Column | None = None,
    complete: bool = True,
) -> list[Column]:
    """The normalised row of one record as columns."""

    def text(value) -> Column:
        return F.lit(value).cast("string")

    source = F.struct(
        F.lit(spec.name).alias("dataset_name"),
        source_key(F.lit(spec.name), *identity).alias("source_key"),
        F.col("source_file"),
        (text(None) if original_id is None else original_id).alias("original_id"),
        F.col("source_revision"),
        F.col("record_index").cast("long").alias("source_record_index"),
        text(spec.rights.license).alias("license"),
        F.lit(spec.rights.credit).alias("attribution"),
        F.lit(run_id).alias("import_run_id"),
        legacy_id.alias("legacy_original_id"),
    )
    empty_tags = F.array().cast("array<string>")
    return [
        title.alias("title"),
        F.lit(spec.kind).alias("question_type"),
        difficulty.alias("difficulty"),
        statement.alias("problem_statement"),
        text(None).alias("constraints"),
        text(None).alias("examples"),
        F.array(*[F.lit(m) for m in spec.methods]).alias("supported_methods"),
        F.coalesce(tags, empty_tags).alias("tags") if tags is not None else empty_tags.alias("tags"),
        source.alias("source"),
        (_empty(_ASSETS) if assets is None else assets).alias("assets"),
        (_empty(_SOLUTIONS) if solutions is None else solutions).alias("solutions"),
        (_empty(_CASES) if cases is None else cases).alias("test_cases"),
        F.lit(complete).alias("is_complete"),
    ]


def _usable(statement: Column, *needed: Column) -> Column:
    """The statement, blanked when a needed member is missing."""
    ready = statement != ""
    for column in needed:
        ready = ready & F.coalesce(column != "", F.lit(False))
    return F.when(F.coalesce(ready, F.lit(False)), statement).otherwise("")


def coding_lines_a(raw: DataFrame, spec: QuestionCorpus, run_id: str) -> DataFrame:
    """One problem per line, identified by its task id."""
    task = first_filled(member("task_id"), member("question_id"))
    starter, completion = _text_or_empty(member("starter_code")), _text_or_empty(member("completion"))
    codes = F.filter(F.array(completion), lambda c: c != "")
    return raw.select(
        *_question(
            spec,
            run_id,
            identity=[_text_or_empty(task)],
            original_id=task,
            legacy_id=task,
            title=slug_title(_text_or_empty(task)),
            difficulty=difficulty_of("leetcode", member("difficulty")),
            statement=_usable(_text_or_empty(member("problem_description")), task),
            tags=text_list(field(F.col(_RECORD), "tags")),
            assets=asset_list("starter_code", starter, "python", "text"),
            solutions=solution_list("python", codes),
            cases=listed_cases(list_field(F.col(_RECORD), "input_output"), MAX_CASES),
        )
    )


def coding_lines_b(raw: DataFrame, spec: QuestionCorpus, run_id: str) -> DataFrame:
    """Ids repeat between files, so the file is part of the identity."""
    given = F.coalesce(member("problem_id"), member("id"))
    row = F.col("record_index").cast("string")
    shown = F.coalesce(non_empty(given), row)
    return raw.select(
        *_question(
            spec,
            run_id,
            identity=[F.col("source_file"), F.coalesce(given, F.concat(F.lit("row:"), row))],
            original_id=given,
            legacy_id=shown,
            title=F.coalesce(non_empty(member("name")), F.concat(F.lit("APPS Problem "), shown)),
            difficulty=difficulty_of("apps", non_empty(member("difficulty"))),
            statement=_text_or_empty(first_filled(member("question"), member("problem"))),
            tags=text_list(field(F.col(_RECORD), "tags")),
            assets=asset_list("starter_code", _text_or_empty(member("starter_code")), "python", "text"),
            solutions=solution_list("python", code_list(native("solutions"))),
            cases=zipped_cases(native("input_output"), MAX_CASES),
        )
    )


def coding_table(raw: DataFrame, spec: QuestionCorpus, run_id: str) -> DataFrame:
    """Columns may hold JSON or Python literals."""
    decoded = raw.select(
        "*",
        json_or_literal(first_filled(member("tags"), member("raw_tags"))).alias("_tags"),
        json_or_literal(member("input_output")).alias("_io"),
        json_or_literal(member("solutions")).alias("_solutions"),
    )
    url = first_filled(member("url"), member("problem_id"), member("id"))
    word = F.translate(first_filled(member("difficulty"), F.lit("medium")), "_", " ")
    return decoded.select(
        *_question(
            spec,
            run_id,
            identity=[_text_or_empty(url)],
            original_id=url,
            legacy_id=url,
            title=first_filled(member("name"), F.lit("TACO Problem")),
            difficulty=difficulty_of("taco", word),
            statement=_usable(_text_or_empty(member("question")), url),
            tags=text_list(F.col("_tags")),
            assets=asset_list("starter_code", _text_or_empty(member("starter_code")), "python", "text"),
            solutions=solution_list("python", code_list(F.col("_solutions"))),
            cases=zipped_cases(F.col("_io"), MAX_CASES),
        )
    )


def coding_archives(raw: DataFrame, spec: QuestionCorpus, run_id: str) -> DataFrame:
    """(path, task_binary) rows; a broken archive has a blank statement."""
    decoded = decode_archives(raw)
    path = non_empty(F.col("path"))
    statement = _text_or_empty(F.col("instruction"))
    return decoded.select(
        *_question(
            spec,
            run_id,
            identity=[_text_or_empty(path)],
            original_id=path,
            legacy_id=path,
            title=first_filled(heading_title(statement), path),
            difficulty=difficulty_of("codecontests", F.col("difficulty")),
            statement=_usable(statement, path),
            tags=F.col("tags"),
            cases=zipped_cases(F.try_parse_json("tests"), MAX_ARCHIVE_CASES),
        )
    )


def _sql_question(
    spec: QuestionCorpus,
    run_id: str,
    question: Column,
    answer: Column,
    identity: list[Column],
    difficulty: str,
    statement: Column,
    legacy_id: Column,
    schema: Column | None,
) -> list[Column]:
    return _question(
        spec,
        run_id,
        identity=identity,
        original_id=None,
        legacy_id=legacy_id,
        title=sql_title(question),
        difficulty=F.lit(difficulty),
        statement=F.when((question != "") & (answer != ""), statement).otherwise(""),
        assets=None if schema is None else asset_list("schema", schema, None, "sql"),
        solutions=solution_list("sql", F.array(answer)),
        complete=False,
    )


def sql_by_database(raw: DataFrame, spec: QuestionCorpus, run_id: str) -> DataFrame:
    """A question against a named database."""
    question, answer = _text_or_empty(member("question")), _text_or_empty(member("query"))
    database = first_filled(member("db_id"), F.lit("unknown"))
    statement = F.concat(
        F.lit("Database: **"), database, F.lit("**\n\n**Question:** "), question
    )
    legacy = F.concat(database, F.lit("__"), F.substring(question, 1, 50))
    return raw.select(
        *_sql_question(
            spec, run_id, question, answer, [database, question, answer], "Medium", statement, legacy, None
        )
    )


def _sql_with_schema(names: dict[str, tuple[str, ...]], difficulty: str) -> Callable:
    def normalise(raw: DataFrame, spec: QuestionCorpus, run_id: str) -> DataFrame:
        question, schema, answer = (
            _text_or_empty(first_filled(*[member(n) for n in names[part]]))
            for part in ("question", "schema", "answer")
        )
        return raw.select(
            *_sql_question(
                spec,
                run_id,
                question,
                answer,
                [question, schema, answer],
                difficulty,
                question,
                F.col("record_index").cast("string"),
                schema,
            )
        )

    return normalise


# N6, N7.  Fixed values: member names tried in this order.
sql_with_context = _sql_with_schema(
    {
        "question": ("question", "input"),
        "schema": ("context", "schema"),
        "answer": ("answer", "output"),
    },
    "Easy",
)
sql_from_prompt = _sql_with_schema(
    {
        "question": ("autotrain_text", "prompt", "question"),
        "schema": ("context", "schema"),
        "answer": ("answer", "query", "sql"),
    },
    "Medium",
)

NORMALISERS: dict[str, Callable[[DataFrame, QuestionCorpus, str], DataFrame]] = {
    "leetcode": coding_lines_a,
    "apps": coding_lines_b,
    "codecontests": coding_archives,
    "taco": coding_table,
    "spider": sql_by_database,
    "sqlctx": sql_with_context,
    "querypls": sql_from_prompt,
}
