import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drillmark.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, segment string, anchor int, window string"


def made(n=700, size=8, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    vectors = (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, size))).astype(np.float32)
    vectors[7::20] = vectors[6::20]  # equal vectors
    vectors[n // 2 : n // 2 + n // 3] = vectors[0]  # one vector in a third of the rows
    rows = [(i, int(rng.integers(0, 10)), [float(x) for x in v], "s", 1, "w") for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (1000, 1, None, "s", 1, "w"), (1100, 1, [0.0] * size, "s", 1, "w"), (1200, 1, [nan] * size, "s", 1, "w"), (1300, 1, [1.0] * (size - 1) + [None], "s", 1, "w"),
        (1400, 1, [1.0, 2.0], "s", 1, "w"), (None, 1, [1.0] * size, "s", 1, "w"), (1500, None, [1.0] * size, "s", 1, "w"), (1600, 2, [inf] * size, "s", 1, "w"),
        (1700, 3, [], "s", 1, "w"), (-200, 4, [0.5] * size, "s", 1, "w"), rows[3], rows[100],
    ]
    return rows


def brute(rows):
    size = max(len(r[2]) for r in rows if r[2])
    usable = sorted(
        {
            (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v))
            for i, label, v, *_ in rows
            if None not in (i, label, v) and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
        }
    )
    out = []
    for a, label, v in usable:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, kind == label) for i, kind, w in usable if i != a)
        for minus, positive, _ in [s for s in scored if s[2]][:5]:
            good = [s for s in scored if not s[2] and -30 * minus <= -100 * s[0] <= -90 * minus][:10]
            out += [(a, positive, k, i, -minus, -s) for k, (s, i, _) in enumerate(good, 1)]
    return sorted(out)


def mined(spark, rows):
    found = negatives.mined(negatives.relabelled(spark.createDataFrame(rows, SCHEMA)), F.col("id") % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("segment, leaf, block", [(8192, 256, 65_536), (60, 8, 7)])
def test_against_brute_force(spark, monkeypatch, segment, leaf, block):
    monkeypatch.setattr(negatives, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(negatives, "WINDOW_BLOCK", block)
    monkeypatch.setattr(negatives, "ROUTED", block)
    rows = made()
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_subtrees_are_left_out():
    """On clustered rows most leaves are never compared, and nothing is lost."""
    rng = np.random.default_rng(3)
    centres = 1000 * rng.normal(size=(40, 6))
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + 30 * rng.normal(size=(4000, 6)))
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    longest = float((vectors**2).sum(axis=1).max())
    tree = negatives.grown(negatives.lifted(vectors, longest), ids, negatives.FANOUT, 32)
    of = np.arange(0, 4000, 100)
    every = negatives.scores(vectors[of], vectors)
    low, high = every.max(axis=1) // 2, every.max(axis=1) * 9 // 10
    asked = negatives.Asked(vectors[of], ids[of], labels[of], np.arange(len(of)), low, high, longest, False, 10)
    compared = []
    take = asked.take
    asked.take = lambda some, *rest: (compared.append(len(some) * len(rest[0])), take(some, *rest))
    negatives.search(tree, vectors, ids, labels, asked, np.arange(len(of)))
    assert sum(compared) < 0.5 * len(of) * 4000
    for w, q in enumerate(of):
        good = sorted((-s, i) for i, s in enumerate(every[w]) if labels[i] != labels[q] and low[w] <= s <= high[w])[:10]
        got = [(-s, i) for s, i in zip(asked.score[w], asked.row[w]) if s != negatives.LOWEST]
        assert got == good


def test_few_rows_and_none(spark):
    for rows in (made()[:1], made()[:4], made()[700:703], []):
        assert mined(spark, rows) == (brute(rows) if any(r[2] for r in rows) else [])
    same = [(i, i % 3, [0.5, -0.25], "s", 1, "w") for i in range(0, 900, 50)]
    assert mined(spark, same) == brute(same)
    ties = [(i, i % 3, [0.5 if i % 2 else 0.4, 0.1], "s", 1, "w") for i in range(0, 900, 25)]
    assert mined(spark, ties) == brute(ties)


def test_long_vectors(spark):
    big = [(i, i % 2, [float(i - 300) * 2.0**10, 2.0**10], "s", 1, "w") for i in range(0, 600, 50)]
    assert mined(spark, big) == brute(big)
    with pytest.raises(Exception, match="55 bits"):
        mined(spark, [(i, 1, [1e12, 1.0], "s", 1, "w") for i in range(5)])
