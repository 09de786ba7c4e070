"""python tests/run_parity.py [scale] [name ...]: compare queries with their oracles."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from conftest import session  # noqa: E402
from parity import connect, difference, oracle_rows, spark_rows  # noqa: E402

scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
sf_dir = f"/root/testdata/{scale}"
names = sys.argv[2:] or list(entry.queries())
spark, con, oracles, bad = session(), connect(sf_dir), entry.oracle_sql(), 0
for name in names:
    t = time.time()
    try:
        got = spark_rows(entry.queries()[name](spark, sf_dir))
        took = time.time() - t
        if name not in oracles:
            print(f"rows {name}: {len(got[1])} rows, {took:.1f} s")
            continue
        problem = difference(got, oracle_rows(con, oracles[name]))
    except Exception as error:
        took, problem = time.time() - t, f"{type(error).__name__}: {str(error)[:1200]}"
    bad += problem is not None
    print(f"{'BAD ' if problem else 'ok  '} {name}: {problem or str(len(got[1])) + ' rows'}, {took:.1f} s", flush=True)
print(f"{len(names)} queries, {bad} bad")
