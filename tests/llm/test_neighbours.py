import numpy as np
import pytest
from pyspark.sql import functions as F

from drillmark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, segment string, rank int"


def made(n=700, size=16, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, size)).astype(np.float32)
    vectors[5::50] = vectors[4::50]  # equal vectors
    rows = [(i, [float(x) for x in v], "s", 1) for i, v in enumerate(vectors)]
    rows += [
        (1000, None, "s", 1), (1100, [0.0] * size, "s", 1), (1200, [float("nan")] * size, "s", 1), (1300, [1.0] * (size - 1) + [None], "s", 1),
        (1400, [1.0, 2.0], "s", 1), (None, [1.0] * size, "s", 1), (1500, [float("inf")] * size, "s", 1), rows[3],
    ]
    return rows


@pytest.mark.parametrize("segment_rows, block", [(16_384, 1_024), (100, 2)])
def test_recall_and_order(spark, monkeypatch, segment_rows, block):
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    rows = made()
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    good = np.array([r[1] for r in rows[:700]])
    hits = 0
    for q in range(0, 700, 100):
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(r[1] != q and r[1] < 700 for r in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        distance = np.sqrt(((good - good[q]) ** 2).sum(axis=1))
        assert all(abs(distance[v] - s) < 1e-12 for _, v, s in own)
        distance[q] = np.inf
        hits += len({r[1] for r in own} & set(np.lexsort((np.arange(700), distance))[:10].tolist()))
    assert {r.query_id for r in found} == set(range(0, 700, 100)) and hits >= 0.9 * 70


def test_few_rows_and_none(spark):
    table = spark.createDataFrame(made()[:3], SCHEMA)
    found = neighbours.nearest(table, F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in found) == [1, 2]
    for rows in (made()[:1], made()[700:702], []):
        assert neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


def test_ranges_are_shared_prefixes():
    arrays = np.sort(np.random.default_rng(1).integers(0, 256, (3, 40), dtype=np.uint64), axis=1)
    asked = np.array([[7, 200], [0, 255], [100, 31]], np.uint64)
    for level in range(9):
        low, high = neighbours._ranges(arrays, asked, level, 8)
        for t in range(3):
            for q in range(2):
                want = (arrays[t] >> np.uint64(8 - level)) == (asked[t, q] >> np.uint64(8 - level))
                assert np.flatnonzero(want).tolist() == list(range(low[t, q], high[t, q]))
