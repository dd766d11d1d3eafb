"""Run queries against their SQL twins: python tests/check_queries.py [sf_dir] [name ...]"""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from emberline.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                diffs, n = compare(df, con, sql[name])
                status = f"ok {n}" if not diffs else "DIFF"
            else:
                diffs, status = [], f"rows={df.count()}"
        except Exception as exc:
            diffs, status = [str(exc)[:1500]], "ERROR"
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        bad += bool(diffs)
        print(f"{status:12} {name} {time.time() - began:.2f}s", flush=True)
        for d in diffs:
            print("     ", d, flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
