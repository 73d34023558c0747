"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
The session is warmed on sf0.001 first (not timed), as a long-running
service would be.  Tables that queries share are dropped before each query, so
every figure is the query's whole work, the cleaning included.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_listings", "cleaning_step_log", "oof_rule_metrics", "sector_summary"]
OPTIONAL = ["ingest_listings", "oof_features", "market_describe", "rule_residual_band", "rate_estimates",
            "query_validation", "comparables"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("ESTATELENS_MASTER", f"local[{cpus}]")
    os.environ.setdefault("ESTATELENS_SHUFFLE_PARTITIONS", str(max(8, int(cpus))))
    from estatelens.plans.registry import all_queries
    from estatelens.plans.common import forget
    from estatelens.session import get_session, release_tables

    spark = get_session()
    qs = all_queries()
    names = HEADLINE + [n for n in OPTIONAL if n in qs]
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for n in names:
            qs[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        forget()
        release_tables(spark)
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
