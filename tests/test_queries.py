"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import __spark_entry__ as entry  # noqa: E402
from drillmark.plans import slate  # noqa: E402
from oracle import connect, difference  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: The queries of the optional operators have tests of their own.
NAMES = sorted(slate.QUERIES)


def test_every_query_has_sql():
    assert set(slate.ORACLES) == set(slate.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row.total_attempts > 0 and row.solved_questions <= row.attempted_questions


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, con, entry.oracle_sql()[name]) is None
