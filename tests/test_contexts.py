"""Mixed quizzes against the loop they stand for, bounded values, blueprints."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drillmark.functions.bounded import bounded, bounded_json
from drillmark.functions.scoring import seeded_unit
from drillmark.plans import practice

NESTED = st.recursive(
    st.none() | st.integers(-9, 9) | st.text(max_size=60),
    lambda x: st.lists(x, max_size=24) | st.dictionaries(st.text(max_size=130), x, max_size=34),
    max_leaves=40,
)


def levels(value, limit, depth=0):
    """Every text, list and object with the limit of its level."""
    yield value, limit
    for inner in value if isinstance(value, list) else value.values() if isinstance(value, dict) else ():
        yield from levels(inner, limit // 2, depth + 1)


@settings(max_examples=150, deadline=None)
@given(NESTED, st.integers(0, 200))
def test_bounded_at_every_level(value, limit):
    for inner, most in levels(bounded(value, limit), limit):
        assert not isinstance(inner, str) or len(inner) <= most
        assert not isinstance(inner, list) or len(inner) <= 20
        assert not isinstance(inner, dict) or (len(inner) <= 30 and all(len(k) <= 120 for k in inner))
    small = [["a" * (limit // 4)], {"k": 1}]
    assert bounded(small, limit) == small


def test_depth_six_and_odd_texts(spark):
    deep = "x" * 9000
    for _ in range(6):
        deep = {"k": [deep, 1]}
    rows = [json.dumps(deep), "plain " * 3000, "", None, "[" * 100_000, '"a text"', '{"b": 1, "a": [1.5, null, true]}']
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "n int, t string")
    got = {r.n: r.b for r in table.select("n", bounded_json(F.col("t")).alias("b")).collect()}
    inner = json.loads(got[0])
    for _ in range(6):
        inner = inner["k"][0]
    assert inner == "x" * (12_000 >> 12)
    assert got[1] == rows[1][:12_000] and got[2] == "" and got[3] is None and got[4] == "[" * 12_000
    assert got[5] == '"a text"' and got[6] == '{"b":1,"a":[1.5,null,true]}'


def test_mixed_places_are_those_of_the_loop(spark):
    rng = random.Random(1)
    sizes = [(k, t, c, g) for k, (t, c, g) in enumerate((rng.randint(1, 10), rng.randint(0, 11), rng.randint(0, 11)) for _ in range(300)) if c + g >= t]
    table = spark.createDataFrame(sizes, "quiz_id long, t int, c int, g int")

    def coin(k):
        return seeded_unit(F.concat_ws("-", F.col("quiz_id"), k), "s") < 0.5

    turns = practice.places_of(F.col("t"), F.col("c"), F.col("g"), coin)
    flips = F.transform(F.sequence(F.lit(1), "t"), coin)
    for r in table.select("*", turns.alias("turns"), flips.alias("flips")).collect():
        used = {"dataset": 0, "ai_generated": 0}
        room = {"dataset": r.c, "ai_generated": r.g}
        for k, (turn, heads) in enumerate(zip(r.turns, r.flips), 1):
            side, other = ("ai_generated", "dataset") if heads else ("dataset", "ai_generated")
            side = side if used[side] < room[side] else other
            used[side] += 1
            assert (turn.position, turn.source, turn.draw_no) == (k, side, used[side])


def test_every_session_has_its_blueprint(spark):
    turns = spark.createDataFrame(
        [("s", k, "scored", "p", "theory", None, f"a{k}", None, 50.0, (["g"], "f")) for k in range(1, 6)],
        "session_id string, position int, status string, prompt string, answer_format string, method string, "
        "answer_text string, selected_option string, score double, feedback struct<gaps:array<string>,next_focus:string>",
    )
    sessions = spark.createDataFrame([("s", '{"level": 1}'), ("new", '{"level": 2}')], "session_id string, blueprint string")
    got = {r.session_id: r for r in practice.adaptive_context(turns, sessions=sessions).collect()}
    assert got["s"].blueprint == '{"level": 1}' and [t.position for t in got["s"].recent_scored_turns] == [3, 4, 5]
    assert got["new"].blueprint == '{"level": 2}' and got["new"].recent_scored_turns == []
