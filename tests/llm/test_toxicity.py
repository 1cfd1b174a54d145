import random

import numpy as np
from corpus import empty
from hypothesis import given, settings
from hypothesis import strategies as st

from drillmark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def maximal(scores):
    """All maximal-scoring segments: the best one, then those left and right of it."""
    best, where = 0.0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sum(scores[a:b]) > best:
                best, where = sum(scores[a:b]), (a, b)
    if where is None:
        return []
    a, b = where
    left = maximal(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in maximal(scores[b:])]
    return [*left, (a, b, best), *right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-40, 40), max_size=14, unique=True))
def test_segments_are_the_maximal_ones(values):
    scores = [v + 0.001 * 2**-k for k, v in enumerate(values)]  # no ties
    found = [(a, b) for a, b, _ in toxicity.segments(scores)]
    assert found == [(a, b) for a, b, _ in maximal(scores)]


def made(spark, n=1500, seed=1):
    rng = random.Random(seed)
    clean = [f"word{k}" for k in range(400)]
    bad = ["vile", "nasty", "grimeful", "grimer", "grimes"]
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(clean, k=rng.randrange(5, 120))
        toxic = k % 8 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "x"))
        labels.append((k, 1, int(toxic)))
    rows += [(n, None, "x"), (n + 1, "", "x"), (None, "vile nasty vile words", "x"), (n + 2, "word1 vile nasty grimest word2", "x")]
    labels += [(n, None, None), (None, 1, 1), (n + 50, 1, 1), (0, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    return table, spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    table = toxicity.scored(docs, labels)
    found = table.withColumn("held", toxicity.held_out(table["id"])).collect()
    held = [(r.score, truth[r.id]) for r in found if r.held and truth.get(r.id) is not None]
    assert len(found) == 1504 and len(held) > 200 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.97
    scores = {r.id: r.score for r in found}
    assert scores[1500] == scores[1501] < 0.5 and scores[1502] >= 0.5 and scores[None] >= 0.5
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.id for r in found if r.score < 0.5}


def test_passages_are_where_the_words_are(spark):
    docs, labels = made(spark, 400)
    model = toxicity.fit(toxicity._narrow(docs, "doc_id", "text"), labels)
    found = [r for r in toxicity.passages(docs, model).collect() if r.id == 402]
    assert [r.passage.split()[0] for r in found] and all("vile" in r.passage for r in found)


def test_no_labels_and_no_rows(spark):
    docs, labels = made(spark, 10)
    nothing = toxicity.scored(docs, labels.limit(0)).collect()
    assert len(nothing) == 14 and all(r.score < 1e-6 for r in nothing)
    assert toxicity.scored(empty(spark), labels).collect() == []
