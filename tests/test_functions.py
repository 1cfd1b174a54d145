"""Scalar rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions import payload, scoring, text


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"_": 1}
    schema = ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}"
        for k, v in row.items()
    )
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first().x


def test_source_key_is_the_sha_of_a_json_array(spark):
    parts = ["set", 'a "quoted"\nline', "é/ü"]
    expected = hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()
    key = text.source_key(F.lit(parts[0]), F.lit(parts[1]), F.lit(parts[2]))
    assert one(spark, key) == expected


def test_content_hash_ignores_case_and_spacing(spark):
    a = one(spark, text.content_hash(F.lit("d"), F.lit("  What\u00a0is\n THIS? ")))
    assert a == hashlib.sha256(b"d\0what is this?").hexdigest()
    assert one(spark, text.prompt_hash(F.lit("A  b"))) == hashlib.sha256(b"a b").hexdigest()


@pytest.mark.parametrize("value", ["", " \t\n", "\u00a0\u2003", None])
def test_blank(spark, value):
    assert one(spark, text.is_blank(F.col("v")), v=value) is True


def test_clips(spark):
    assert one(spark, text.clip_ellipsis(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.clip_ellipsis(F.lit("abcd"), 4)) == "abcd"
    assert one(spark, text.clip_marked(F.lit("abcdef"), 4, "!")) == "abcd!"
    assert len(one(spark, text.clip_error(F.repeat(F.lit("x"), 3000)))) == 2000


@pytest.mark.parametrize(
    ("line", "prompt"),
    [
        ("1. **What is a join?**", "What is a join?"),
        ("  - `Explain` windows", "Explain windows"),
        ("**How does sort work?**", "How does sort work?"),
        ("plain text", ""),
        ("## heading", ""),
    ],
)
def test_listed_prompt(spark, line, prompt):
    assert one(spark, text.listed_prompt(F.col("v")), v=line) == prompt


def test_titles(spark):
    assert one(spark, text.slug_title(F.lit("two-SUM  ii"))) == "Two Sum Ii"
    assert one(spark, text.heading_title(F.lit("## # Title \nbody"))) == "Title"
    assert one(spark, text.sql_title(F.repeat(F.lit("q"), 80))) == "SQL: " + "q" * 60


def test_relative_path(spark):
    assert one(spark, text.relative_path(F.lit("file:/r/data/a/b.json"), "/r/data")) == "a/b.json"
    assert one(spark, text.relative_path(F.lit("file:/else/b.json"), "/r/data")) == "b.json"
    assert one(spark, text.file_name(F.lit("C:\\x\\Y.json"))) == "Y.json"


def test_markdown_cleanup(spark):
    link = "[*Text*](http://x/y) `c`"
    assert one(spark, text.plain_markdown(F.lit(link))) == "Text c"
    assert one(spark, text.cited_markdown(F.lit("see [it](u)"))) == "see it (u)"
    assert one(spark, text.bullet_markdown(F.lit("a[^1]  [b](c) "))) == "a b"


def test_unfence_and_strict_parse(spark):
    fenced = '```json\n{"a": 1}\n```'
    assert one(spark, payload.unfence(F.lit(fenced))) == '{"a": 1}'
    assert one(spark, payload.unfence(F.lit('```\n{}```'))) == "{}"
    assert one(spark, payload.unfence_json(F.lit('```JSON\n{}```'))) == "{}"
    assert one(spark, payload.unfence_json(F.lit("```\n{}```"))) == "```\n{}```"
    for bad in ('{"a": NaN}', "{", '{"a": 1, "a": 2}'):
        assert one(spark, payload.parse_strict(F.lit(bad)).isNull()) is True


def test_number_field_rejects_booleans_and_text(spark):
    def number(raw):
        return one(spark, payload.number_field(F.try_parse_json(F.lit(raw)), "n"))

    assert number('{"n": 3}') == 3.0 and number('{"n": 2.5}') == 2.5
    assert number('{"n": true}') is None and number('{"n": "3"}') is None


@pytest.mark.parametrize(
    ("raw", "titles"),
    [
        ('{"success": true, "data": {"web": [{"title": "a", "url": "u"}]}}', ["a"]),
        ('{"results": [{"title": "b"}, 3]}', ["b"]),
        ('[{"title": "c"}]', ["c"]),
        ("not json", ["Web result"]),
        ('{"other": 1}', []),
        ("", []),
        ('{"data": {"results": {"web": {"data": [{"title": "deep"}]}}}}', ["deep"]),
        ('{"data": {"results": []}, "web": {"data": {"web": [{"title": "later"}]}}}', ["later"]),
        ('{"data": [], "results": [{"title": "not reached"}]}', []),
        ('{"data": {"web": {"web": [{"title": "first"}]}, "results": {}}, "results": [{"title": "second"}]}', ["first"]),
    ],
)
def test_nested_rows(spark, raw, titles):
    rows = payload.nested_rows(F.col("v"))
    got = one(spark, F.transform(rows, lambda r: payload.text_field(r, "title")), v=raw)
    assert got == titles


def test_choice_score_needs_a_correct_option(spark):
    none = F.lit(None).cast("string")
    assert one(spark, scoring.choice_score(F.lit("a"), F.lit("a"))) == 100.0
    assert one(spark, scoring.choice_score(F.lit("a"), F.lit("b"))) == 0.0
    assert one(spark, scoring.choice_score(none, none)) == 0.0


def test_round_robin_and_sources(spark):
    formats = F.array(F.lit("theory"), F.lit("coding"), F.lit("mcq"))
    assert [one(spark, scoring.round_robin(formats, F.lit(p))) for p in (1, 2, 3, 4)] == [
        "theory",
        "coding",
        "mcq",
        "theory",
    ]
    assert one(spark, scoring.uses_local(F.lit("mixed"), F.lit(3))) is True
    assert one(spark, scoring.uses_local(F.lit("mixed"), F.lit(2))) is False
    assert one(spark, scoring.uses_local(F.lit("ai"), F.lit(1))) is False


def test_mixed_source_falls_back(spark):
    def pick(dataset, ai, unit):
        return one(spark, scoring.mixed_source(F.lit(dataset), F.lit(ai), F.lit(unit)))

    assert pick(True, True, 0.4) == "ai" and pick(True, True, 0.6) == "dataset"
    assert pick(False, True, 0.9) == "ai" and pick(True, False, 0.1) == "dataset"
    assert pick(False, False, 0.1) is None


def test_template_names_must_match(spark):
    assert one(spark, scoring.render_template("a {{x}} b {{x}}", x=F.lit("1"))) == "a 1 b 1"
    for bad in ({}, {"x": F.lit("1"), "y": F.lit("2")}):
        with pytest.raises(ValueError):
            scoring.render_template("a {{x}}", **bad)


def test_lookups(spark):
    assert one(spark, scoring.level_difficulty(F.lit("STAFF"))) == "Very Hard"
    assert one(spark, scoring.level_difficulty(F.lit("other"))) == "Medium"
    assert one(spark, scoring.syntax_language(F.lit("polars"))) == "python"
    assert one(spark, scoring.method_label(F.lit("cpp"))) == "C++"
    assert one(spark, scoring.difficulty_rank(F.lit("Very Hard"))) == len(S.DIFFICULTIES)
    assert one(spark, scoring.has_comment(F.lit("-- note"), F.lit("sql"))) is True
    assert one(spark, scoring.has_comment(F.lit("# note"), F.lit("sql"))) is False
    none = F.lit(None).cast("string")
    assert one(spark, scoring.starter_code(none, F.lit("sql"), {"sql": "SELECT"})) == "SELECT"
    assert one(spark, scoring.mean_or_zero(F.lit(None).cast("double"))) == 0.0
    assert one(spark, text.topic_or_any(F.lit(" \n"))) == "general"
