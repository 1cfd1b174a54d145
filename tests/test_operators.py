"""Ordered, sampling and section operators, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from drillmark.operators import ordered, sampling, sections
from drillmark.operators.barrier import once
from drillmark.operators.joins import left_join_known


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(7)
    rows = [("hot" if i % 3 == 0 else f"k{i % 41}", random.randint(0, 50), i) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "key string, ts int, id int").repartition(7)


def _expected_positions(rows):
    out = {}
    for key in {r[0] for r in rows}:
        ranked = sorted((ts, i) for k, ts, i in rows if k == key)
        out.update({i: n for n, (_, i) in enumerate(ranked, 1)})
    return out


def test_number_rows_splits_hot_key(skewed):
    rows, df = skewed
    numbered = ordered.number_rows(df, ["key"], ["ts", "id"], F.floor(F.col("ts") / 5), total="n")
    got = {r.id: r.position for r in numbered.collect()}
    assert got == _expected_positions(rows)
    totals = {r.key: r.n for r in numbered.select("key", "n").distinct().collect()}
    assert totals["hot"] == 2000


def test_top_and_first_per_key(skewed):
    rows, df = skewed
    expected = {i for i, n in _expected_positions(rows).items() if n <= 3}
    assert {r.id for r in ordered.top_per_key(df, ["key"], ["ts", "id"], 3).collect()} == expected
    first = {i for i, n in _expected_positions(rows).items() if n == 1}
    assert {r.id for r in ordered.first_per_key(df, ["key"], ["ts", "id"]).collect()} == first


def test_first_per_key_prunes_before_the_shuffle(skewed):
    plan = ordered.first_per_key(skewed[1], ["key"], ["ts", "id"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    below = physical[physical.index("Exchange hashpartitioning(key") :]
    assert "WindowGroupLimit" in below


def test_latest_per_key(skewed):
    rows, df = skewed
    got = {r.key: (r.ts, r.id) for r in ordered.latest_per_key(df, ["key"], ["ts", "id"], ["ts", "id"]).collect()}
    assert got == {k: max((t, i) for kk, t, i in rows if kk == k) for k in {r[0] for r in rows}}


def test_append_positions_continue(spark):
    existing = spark.createDataFrame([("s", 1), ("s", 2)], "session string, id int")
    incoming = spark.createDataFrame([("s", 9), ("s", 5), ("t", 1)], "session string, id int")
    out = ordered.append_positions(existing, incoming, "session", ["id"], F.floor(F.col("id") / 4))
    assert {(r.session, r.id, r.position) for r in out.collect()} == {("s", 5, 3), ("s", 9, 4), ("t", 1, 1)}


def test_seeded_sample_is_reproducible_and_distinct(spark):
    df = spark.range(500)
    first = [r.id for r in sampling.seeded_sample(df, "id", 20, "a").collect()]
    assert first == [r.id for r in sampling.seeded_sample(df.repartition(5), "id", 20, "a").collect()]
    assert len(set(first)) == 20
    assert first != [r.id for r in sampling.seeded_sample(df, "id", 20, "b").collect()]


@pytest.fixture(scope="module")
def pool(spark):
    rows = [("big" if i % 3 else f"g{i % 5}", i) for i in range(900)]
    return rows, spark.createDataFrame(rows, "grp string, item long")


def test_draw_gives_distinct_items_of_the_group(spark, pool):
    rows, df = pool
    requests = spark.createDataFrame(
        [(i, "big" if i % 2 else "g0", i % 10 + 1) for i in range(300)], "request long, grp string, wanted int"
    )
    drawn = sampling.draw(requests, df, ["grp"], "request", "item", "wanted", "s").collect()
    members = {}
    for group, item in rows:
        members.setdefault(group, set()).add(item)
    per_request = {}
    for r in drawn:
        assert r["item"] in members[r.grp]
        per_request.setdefault(r.request, []).append((r.draw_no, r["item"]))
    for i in range(300):
        got = sorted(per_request[i])
        assert [n for n, _ in got] == list(range(1, i % 10 + 2))
        assert len({item for _, item in got}) == len(got)


def test_next_unused_matches_brute_force(spark, pool):
    rows, df = pool
    random.seed(3)
    groups = sorted({g for g, _ in rows})
    sessions = [(s, random.choice(groups)) for s in range(120)]
    items = [i for _, i in rows]
    # Session 0 has seen every item, session 1 all but one of its group.
    used = [(0, i) for i in items]
    left_over = next(i for g, i in rows if g == sessions[1][1])
    used += [(1, i) for i in items if i != left_over]
    used += [(s, random.choice(items)) for s in range(2, 120) for _ in range(40)]
    out = sampling.next_unused(
        spark.createDataFrame(sessions, "session long, grp string"),
        spark.createDataFrame(used, "session long, item long"),
        df,
        ["grp"],
        "session",
        "item",
        "seed",
    )
    got = {r.session: r["item"] for r in out.collect()}
    slots = {
        (r.grp, r["item"]): (r.slot, r.pool_size)
        for r in sampling.shuffled_slots(df, ["grp"], "item", "seed").collect()
    }
    starts = {
        r.session: r.start
        for r in spark.createDataFrame(sessions, "session long, grp string")
        .join(sampling.pool_sizes(df, ["grp"]), "grp")
        .select("session", sampling.start_slot(F.col("session"), F.col("pool_size"), "seed").alias("start"))
        .collect()
    }
    seen = set(used)
    expected = {}
    for session, group in sessions:
        free = [
            ((slots[group, i][0] - starts[session]) % slots[group, i][1], i)
            for g, i in rows
            if g == group and (session, i) not in seen
        ]
        if free:
            expected[session] = min(free)[1]
    assert got == expected
    assert 0 not in got and got[1] == left_over


def test_left_join_known_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10)], "k string, v int")
    got = {(r.id, r.v) for r in left_join_known(left, right, "k", "k").collect()}
    assert got == {(1, 10), (2, None), (3, None)}


def test_once_is_not_copied_into_filters(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("x",)], "text string")
    out = once(df, "v", F.try_parse_json("text")).filter(F.col("v").isNotNull())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert out.count() == 1


@pytest.mark.parametrize(
    "text",
    ["", "one", "a\n", "a\r\nb\rc", "\ufeffa\n\n", "\ufeff\ufeffb", "x\u2028y\u0085z\x0bw\x1ce", "\n"],
)
def test_lines_follow_splitlines(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    rows = sections.numbered_lines(df, "t", []).orderBy("line_no").collect()
    assert [r.line for r in rows] == text.removeprefix("\ufeff").splitlines()
    assert [r.line_no for r in rows] == list(range(len(rows)))


def test_cut_and_last_match(spark):
    text = "intro\n## A\nbody\n  - Answer: one\n  - Answer: two\n## B"
    df = spark.createDataFrame([(text,)], "t string")
    numbered = df.select(sections.with_numbers(F.col("t")).alias("b"))
    pieces = sections.cut(numbered, "b", r"##[^\S\n]+.+", "head")
    answers = pieces.select("head", sections.last_match(F.col("b"), r"\s+- Answer: (.+)").alias("a"))
    assert {(r.head, r.a) for r in answers.collect()} == {(None, None), ("## A", "two"), ("## B", None)}
    lines = sections.explode_lines(pieces, "b").collect()
    assert sorted((r.line_no, r.line) for r in lines) == list(enumerate(text.split("\n")))


@pytest.mark.parametrize("block", [1, 3, 4, 1000])
def test_first_gap_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "_GAP_BLOCK", block)
    random.seed(block)
    taken = {k: set(random.sample(range(14), random.randint(1, 13))) for k in range(60)}
    taken |= {100: set(), 101: set(range(12)), 102: set(range(5)) | {9}, 103: {0}, 104: {4, 5, 6, 7}}
    rows = [(k, None) for k in taken] + [(k, s) for k, steps in taken.items() for s in steps]
    df = spark.createDataFrame(rows, "key int, step long")
    got = {r.key: r.gap for r in sampling.first_gap(df, ["key"], "step").collect()}
    assert got == {k: next(i for i in range(20) if i not in steps) for k, steps in taken.items()}


def test_salted_join(spark):
    large = spark.createDataFrame([(i, "hot" if i % 3 else "rare") for i in range(300)], "id int, k string")
    small = spark.createDataFrame([("hot", 1)], "k string, v int")
    from drillmark.operators.joins import salted_join

    inner = salted_join(large, small, ["k"], F.col("id"))
    assert inner.count() == 200 and inner.columns == ["k", "id", "v"]
    assert salted_join(large, small, ["k"], F.col("id"), "left").filter("v is null").count() == 100


def test_spread_join_splits_frequent_keys_only(spark):
    from drillmark.operators import joins

    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 1500}") for i in range(4500)]
    large = spark.createDataFrame(rows, "id int, k string")
    small = spark.createDataFrame([(f"k{i}", i) for i in range(1500)] + [("hot", -1)], "k string, v int")
    small = small.groupBy("k").agg(F.max("v").alias("v"))
    values = {f"k{i}": i for i in range(1500)} | {"hot": -1}
    for how in ("inner", "left"):
        got = joins.spread_join(large, small, ["k"], F.col("id"), how)
        assert sorted((r.id, r.v) for r in got.collect()) == sorted((i, values[k]) for i, k in rows)
    missing = joins.spread_join(large, small.filter("k <> 'hot'"), ["k"], F.col("id"), "left")
    assert missing.filter("v is null").count() == 1500
