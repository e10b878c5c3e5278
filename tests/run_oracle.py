"""Run registered queries against their SQL: ``run_oracle.py [sf] [key ...]``."""

import os
import sys
import time

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(here), here]

from conftest import make_spark  # noqa: E402
from oracle import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con = make_spark(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    bad = 0
    for key in keys:
        t = time.time()
        try:
            if key in oracles:
                problems = differences(spark, con, queries[key], oracles[key], sf)
            else:
                n = queries[key](spark, sf).count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {time.time() - t:6.2f}s {key} {problems or ''}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} ok")
