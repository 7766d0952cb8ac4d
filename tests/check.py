"""Command-line check: python tests/check.py [sf] [name-part ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from foliant.session import local_session  # noqa: E402
from tests.compare import TIMES, compare, connect  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
parts = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session()
con = connect(sf_dir)
queries, sqls = entry.queries(), entry.oracle_sql()
bad = []
for name, fn in queries.items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        df = fn(spark, sf_dir)
        diff = compare(df, con, sqls[name]) if name in sqls else [] if df.count() else ["no rows"]
    except Exception as e:  # noqa: BLE001
        diff = [f"{type(e).__name__}: {str(e)[:700]}"]
    flag = "ok  " if not diff else "FAIL"
    print(f"{flag} {name} {time.time() - t:.2f}s sql {TIMES['sql']:.2f}s {'' if name in sqls else '(rows only)'}", flush=True)
    for d in diff:
        print("     ", d[:900], flush=True)
    if diff:
        bad.append(name)
print("failed:", bad)
