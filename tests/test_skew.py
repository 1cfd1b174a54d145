"""Every registered query on tables where one key holds a third of the rows."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import __spark_entry__ as entry  # noqa: E402
from drillmark.plans import slate  # noqa: E402
from oracle import TABLES, connect, difference  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

# One row in three moves to one order, part, customer, user, conversation or text.
SKEWED = {
    "lineitem": """SELECT * REPLACE (
        CASE WHEN rn % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN rn % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey,
        rn AS l_suppkey)""",
    "orders": "SELECT * REPLACE (CASE WHEN rn % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey)",
    "events": "SELECT * REPLACE (CASE WHEN rn % 3 = 0 THEN 3 ELSE user_id END AS user_id)",
    "conversations": """SELECT * REPLACE (
        CASE WHEN rn % 3 = 0 THEN 1000 ELSE conv_id END AS conv_id,
        CASE WHEN rn % 3 = 0 THEN rn // 3 ELSE turn END AS turn)""",
    "documents": """SELECT * REPLACE (
        CASE WHEN rn % 3 = 0 THEN 'The same  text' ELSE text END AS text,
        CASE WHEN rn % 3 = 0 THEN 'en' ELSE lang END AS lang,
        CASE WHEN rn % 3 = 0 THEN 'src2' ELSE source END AS source,
        CASE WHEN rn % 3 = 0 THEN 14 ELSE n_chars END AS n_chars)""",
    "part": """SELECT * REPLACE (
        CASE WHEN rn % 3 = 0 THEN 'STANDARD' ELSE p_type END AS p_type,
        CASE WHEN rn % 3 = 0 THEN 'red ring' ELSE p_name END AS p_name,
        CASE WHEN rn % 3 = 0 THEN 25 ELSE p_size END AS p_size)""",
}


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = connect(SF_DIR)
    for name in TABLES:
        numbered = f"(SELECT *, row_number() OVER () - 1 AS rn FROM {name})"
        select = f"SELECT * EXCLUDE (rn) FROM ({SKEWED.get(name, 'SELECT *')} FROM {numbered})"
        con.execute(f"COPY ({select}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def con(skewed_dir):
    return connect(skewed_dir)


@pytest.mark.parametrize("name", sorted(slate.QUERIES))
def test_matches_sql(spark, con, skewed_dir, name):
    frame = entry.queries()[name](spark, skewed_dir)
    assert difference(frame, con, entry.oracle_sql()[name]) is None
