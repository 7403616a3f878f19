"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from marketloom.queries import QUERIES
from marketloom.session import build_session

HEADLINE = (
    "J02_indicator_join", "P03_maturity_cut", "W05_rolling_mean", "W10_rsi", "W14_interpolate_forward", "F01_text_cleaning",
    "F07_cleaning_chain", "F08_boilerplate_cut", "F11_link_extraction", "F25_fixed_batches", "A11_score_distribution", "A16_outliers",
    "A21_distinct_documents", "A22_cleaning_audit", "P12_keyword_filter", "A08_policy_weighted_daily", "W17_decayed_influence",
    "J04_as_of_merge", "T08_best_per_slot", "T09_merged_slots", "A17_weekly_roll_up", "M02_daily_walks", "M06_min_max_scaling",
    "M10_classification_metrics", "M14_threshold_search", "B03_costed_value", "B04_whole_unit_value", "W20_drawdown_episodes",
    "B12_risk_metrics", "B16_benchmark_metrics", "B21_rank_test", "B24_full_matrix", "B25_return_density",
    "I02_checkpointed_scoring", "I05_session_windows", "F10_body_text", "M08_direction_classifier", "M13_error_predictor", "B22_bootstrap_sharpe",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").limit(1).count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
