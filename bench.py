"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenframe import build_session  # noqa: E402
from lumenframe.plans import catalog  # noqa: E402

HEADLINES = [
    "g01_daily_rollup", "g04_summary_by_type", "g06_dashboard_cards", "g08_user_overview", "g17_request_histogram",
    "g19_request_p95_alerts", "g21_silences", "b01_column_types", "b02_missing_values", "b03_duplicate_rows",
    "b05_numeric_profile", "b08_categorical_profile", "b10_correlation_matrix", "b12_insights",
    "c03_scaled", "c04_distance_scores", "c05_histogram_scores", "c06_neighbour_scores", "c07_isolation_scores", "e02_ks_distances",
    "f01_chunks", "f03_first_writers", "a01_csv_load", "c12_full_ensemble", "f07_search", "f10_search_many", "f14_prompts", "f16_language",
    "h02_classified_columns", "h05_consent_intervals", "h08_access_export", "i03_routes", "i13_heartbeat_gaps",
    "j01_clock_windows", "d03_folds", "d07_linear_contributions", "d09_importance", "d08_tree_additivity",
    "g03_stream_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, {
        "spark.driver.memory": "16g", "spark.sql.files.openCostInBytes": str(256 * 1024)})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = sys.argv[1:] or HEADLINES
    queries["g01_daily_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
