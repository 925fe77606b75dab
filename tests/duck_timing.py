"""Time every oracle SQL in DuckDB on one scale (single-node comparison point).

    python tests/duck_timing.py /root/testdata/sf0.1
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_harness import duck  # noqa: E402


def main(sf_dir):
    from catalign.queries import all_oracles
    con = duck(sf_dir)
    out = {}
    for name, sql in sorted(all_oracles().items()):
        t0 = time.perf_counter()
        con.execute(sql).to_arrow_table()  # materialise every column, as the Spark bench does
        out[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "total": round(sum(out.values()), 3), "queries": out}))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
