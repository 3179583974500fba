"""Times the headline queries and prints one JSON line.

Loading the warehouse from the source tables is timed on its own, cold. Every query
then runs RUNS times over the loaded tables, written to the no-op sink so that all rows
and columns are produced; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

RUNS = 3
HEADLINE = (
    "q01_attrition_trend", "q02_plan_retention_ranked", "q03_arr_at_risk",
    "q04_channel_retention_curve", "q05_arr_running_total", "q06_industry_churn_arr",
    "q07_engagement_quartiles", "q08_cohort_six_month",
    "v01_headline", "v02_by_plan", "v03_by_region", "v04_by_channel",
    "v05_cohort_retention", "v06_watchlist", "v07_engagement_segments",
    "k1_dedup", "k8_clean_all", "l1_header", "l3_profile", "l4_7_rule_violations",
    "s17_upsert_subscribers", "s19_denormalised", "m2_11_features", "m6_engagement_decile",
    "n1_exact_split", "n12_comparison", "a17_fingerprint", "n6_logistic",
)


def main() -> None:
    from checks.queries import all_queries
    from holdfast.session import local_session
    from holdfast.workspace import open_workspace

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "holdfast-bench")
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    start = time.perf_counter()
    workspace = open_workspace(spark, sf_dir)
    for table in ("raw", "deduped", "clean", "fact", "features", "predictions", "documents"):
        getattr(workspace, table)
    times["load_warehouse"] = time.perf_counter() - start

    registered = all_queries()
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = statistics.median(runs)

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
