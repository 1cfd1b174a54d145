"""The registered queries on the smallest tables, the pipeline, and the package without this folder."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from drillmark.llm import slate  # noqa: E402
from oracle import connect, difference  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_the_operators_and_the_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(slate.ORACLES))
def test_matches_sql(spark, name):
    assert difference(slate.QUERIES[name](spark, SF_DIR), connect(SF_DIR), slate.ORACLES[name]) is None


def test_pipeline(spark):
    """Each stage keeps the columns, only takes rows or text away, and the last packs what is left."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after and set(after) <= set(before) and all(len(t) <= len(before[i]) for i, t in after.items())
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(before)
    key = ("doc_id", "start", "length", "ids_crc32")
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(tuple(r[k] for k in key) for r in whole) == sorted(tuple(r[k] for k in key) for r in packed)


def test_the_rest_works_without_this_subpackage():
    code = "import sys; sys.modules['drillmark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[-2]) > 100
