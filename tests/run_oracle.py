"""Run every registered query against its oracle: python tests/run_oracle.py [sf_dir] [names...]"""

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as entry  # noqa: E402
from strata.session import local_session  # noqa: E402
from tests.oracle import compare  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session(8, 8)
    qs, sqls = entry.queries(), entry.oracle_sql()
    ok = True
    for name, q in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        if name not in sqls:
            n = q(spark, sf_dir).count()
            print(json.dumps({"name": name, "rows": n, "oracle": None, "sec": round(time.time() - t, 2)}))
            continue
        r = compare(spark, sf_dir, name, q, sqls[name])
        r["sec"] = round(time.time() - t, 2)
        ok &= r["columns_match"] and r["hash_match"] and r["rows"][0] == r["rows"][1]
        print(json.dumps(r, default=str))
    print("ALL OK" if ok else "MISMATCH")
