"""Command line: python tests/run_check.py [name part ...] compares queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from barsight.session import build_session
from oracle import connect, difference


def main(parts):
    path = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    db = connect(path)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) or p in name for p in parts):
            continue
        start = time.time()
        try:
            got = run(spark, path).toPandas()
            spent = time.time() - start
            if name in sql:
                verdict = difference(got, db.execute(sql[name]).df()) or "ok"
            else:
                verdict = "rows" if len(got) else "rows-EMPTY"
        except Exception as e:
            spent, verdict, got = time.time() - start, "ERROR " + " ".join(str(e).split())[:400], []
        bad += verdict not in ("ok", "rows")
        print(f"{spent:6.1f}s {name:36s} {len(got):6d} {verdict}", flush=True)
    print("bad:", bad)
    spark.stop()


main(sys.argv[1:])
