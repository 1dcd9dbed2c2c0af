"""Headline-query benchmark.

Runs the planned bench set on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is fully executed: all columns of all rows go to Spark's noop sink, so no operator is pruned.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newslens.plans import all_queries  # noqa: E402
from newslens.session import build_session  # noqa: E402

BENCH = ["t2_topics", "f2_text_stats", "d3_dedupe_first", "x11_body", "e4_knn", "g1_edges",
         "g9_communities", "r1_undersample", "r4_smote", "v6_metrics"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, int(cpus)))
    qs = all_queries()
    # warm the JVM and Python workers once so the first query is not charged for it
    run(qs["f1_tokens"](spark, sf_dir))
    times: dict[str, float] = {}
    for name in (only or BENCH):
        t = time.time()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.time() - t, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
