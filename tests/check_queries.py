"""Run registered queries against their SQL: python tests/check_queries.py [folder] [name part ...]"""

from __future__ import annotations

import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import __spark_entry__ as registered  # noqa: E402
from oracle import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), registered.oracle_sql(), 0
    for name, query in registered.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                found = differences(df, con, sqls[name])
            else:
                found, rows = [], df.count()
                print(f"  rows only: {rows}")
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
            if "-v" in parts:
                traceback.print_exc()
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("     ", line[:700], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
