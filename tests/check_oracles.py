"""Run every registered query and print how it compares: check_oracles.py [sf_dir] [name ...]."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from flowscope.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session("check", cores="8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name}", flush=True)
        if problem:
            bad += 1
            print("    ", problem, flush=True)
    print(f"{bad} bad")
    spark.stop()
