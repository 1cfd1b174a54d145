"""Column functions against their Python meaning, on random texts."""

import ast
import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drillmark.functions import text
from drillmark.operators import sections
from drillmark.sources.literals import json_or_literal

LETTERS = st.sampled_from("abZß É9#-*`_[]()\"'\\{}:,?!./")
SPACES = st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000\ufeff")
TEXTS = st.lists(st.text(st.one_of(LETTERS, SPACES), max_size=30), min_size=30, max_size=60)
CHECK = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def evaluate(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, t string").select("no", column.alias("x"))
    return [r.x for r in rows.orderBy("no").collect()]


@CHECK
@given(TEXTS)
def test_strip_and_blank(spark, texts):
    column = F.struct(text.strip(F.col("t")), text.is_blank(F.col("t")))
    got = [tuple(x) for x in evaluate(spark, texts, column)]
    assert got == [(t.strip(), not t.strip()) for t in texts]


@CHECK
@given(TEXTS)
def test_squeeze(spark, texts):
    assert evaluate(spark, texts, text.squeeze(F.col("t"))) == [" ".join(t.split()) for t in texts]


@CHECK
@given(TEXTS)
def test_lines(spark, texts):
    got = evaluate(spark, texts, sections.lines_of(F.col("t")))
    assert got == [t.removeprefix("\ufeff").splitlines() for t in texts]


@CHECK
@given(TEXTS)
def test_source_key(spark, texts):
    got = evaluate(spark, texts, text.source_key(F.lit("set"), F.col("t"), F.lit("x")))

    def wanted(value):
        encoded = json.dumps(["set", value, "x"], ensure_ascii=False)
        # Escapes of control characters are written with upper-case digits.
        for code in range(32):
            encoded = encoded.replace(f"\\u{code:04x}", f"\\u{code:04X}")
        return hashlib.sha256(encoded.encode()).hexdigest()

    assert got == [wanted(t) for t in texts]


@CHECK
@given(TEXTS, st.integers(2, 12))
def test_clip(spark, texts, limit):
    got = evaluate(spark, texts, text.clip_ellipsis(F.col("t"), limit))
    assert got == [t if len(t) <= limit else t[: limit - 1] + "…" for t in texts]


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.text(st.one_of(LETTERS, SPACES), max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("abc", min_size=1), inner, max_size=3),
    max_leaves=6,
)


@CHECK
@given(st.lists(st.lists(VALUES, max_size=3), min_size=20, max_size=30))
def test_literals_and_json_decode_alike(spark, values):
    texts = [repr(v) for v in values] + [json.dumps(v) for v in values]
    got = evaluate(spark, texts, F.to_json(json_or_literal(F.col("t"))))
    assert [json.loads(x) for x in got] == [ast.literal_eval(repr(v)) for v in values] * 2
