"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is run to completion with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trustlens import get_session  # noqa: E402
from trustlens.session import release  # noqa: E402
from trustlens.plans import catalog  # noqa: E402

HEADLINE = ["scored_batch", "trust_score", "similarity_score", "score_emotion", "score_diversity",
            "linear_head_scores", "tfidf_weights", "aspect_tags", "lexicon_table", "health_kpis"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    # warm-up on the smallest tables (JVM code generation, Python workers); the cache
    # is cleared before every timed query
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    catalog.q_scored_batch(spark, warm).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    times, failed = {}, {}
    for name in names:
        t0 = time.time()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # report and go on: one failure must not hide the other timings
            failed[name] = type(e).__name__
            print(f"{name} failed: {e}", file=sys.stderr)
        release()
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_time", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
