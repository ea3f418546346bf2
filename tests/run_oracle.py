"""Run registered queries against their oracle SQL (like the driver's gate).

usage: python tests/run_oracle.py [sf_dir] [name-prefix ...]
"""
import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                os.path.dirname(os.path.abspath(__file__))]

from oracle_util import compare, duck  # noqa: E402

from berth.session import build_session  # noqa: E402
import __spark_entry__ as E  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session(cpus=8)
    con = duck(sf)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in orc:
                ok, msg = compare(df, con, orc[name])
            else:
                n = df.count()
                ok, msg = True, f"rows-only: {n} rows"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t:6.1f}s  {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
