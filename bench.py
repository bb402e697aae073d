"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. A query is
timed over its whole result, written to a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fareflow.catalog import all_queries
from fareflow.session import local_session

HEADLINE = [
    "vtat_bucket_rates", "ingest_clean", "dup_rows", "daily_rate_rolling", "minute_rate_rolling", "profile_columns",
    "profile_quartiles", "profile_distinct", "hist_by_class", "feat_temporal", "feat_chain", "assoc_nominal",
    "assoc_binary", "assoc_continuous", "assoc_cramers_matrix", "assoc_corr_matrix", "assoc_vif", "assoc_spearman",
    "assoc_mi_binned", "assoc_mi_knn", "assoc_logodds", "assoc_missing_spread", "pivot_spread", "eval_metrics",
    "eval_metrics_exact", "eval_threshold_sweep", "eval_compare", "biz_costs", "report_dataset_overview",
    "report_bivar_cramers_v", "report_model_business_impact", "dash_comparison", "ml_logreg", "ml_gbt_a",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
