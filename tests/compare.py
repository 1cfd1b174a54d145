"""Run queries against their SQL: python tests/compare.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import connect, difference, rows_of_spark  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf_dir: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracles:
                found = difference(frame, con, oracles[name])
                verdict = "ok" if found is None else f"DIFF {found}"
            else:
                verdict = f"rows {len(rows_of_spark(frame)[1])} (no SQL)"
        except Exception as exc:  # report and go on with the next query
            verdict = f"ERROR {type(exc).__name__} {str(exc)[:1500]}"
        bad += verdict.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
