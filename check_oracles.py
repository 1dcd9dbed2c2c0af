"""Run every registered query against its DuckDB oracle (default sf0.01).

usage: python check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import json
import sys

from newslens.plans import all_queries, all_oracles
from newslens.plans.harness import compare, duck
from newslens.session import build_session


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, orc = all_queries(), all_oracles()
    bad = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, name, sf_dir, fn, orc.get(name), con)
        except Exception as e:  # noqa: BLE001 - report and continue
            r = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(json.dumps(r, ensure_ascii=False), flush=True)
    print(json.dumps({"failed": bad}))


if __name__ == "__main__":
    main()
