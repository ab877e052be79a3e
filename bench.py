"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans import load_catalog  # noqa: E402
from ledgerline.plans.registry import run  # noqa: E402
from ledgerline.session import local_session  # noqa: E402

HEADLINE = [
    "c18_validate_panel",
    "c6_prepare_master",
    "r2_long_panel",
    "r4_weeks_factor",
    "j9_annualize",
    "f14_engineered_panel",
    "f15_training_features",
    "f19_estimation_features",
    "f18_adjacent_training",
    "a10_growth_anchor",
    "v1_group_folds",
    "e4_evaluate_benchmark",
    "t4_pick_winner",
    "x2_reliability",
    "x6_similarity_assign",
    "p15_turnover_cascade",
    "f9_recursive_forecast",
    "f11_intervals",
    "f13_summary_2030",
    "g2_gazelle_tiers",
    "g3_intersection_50m",
    "g7_company_profile",
    "e10_fit_final",
]


def timed(spark, key: str, path: str) -> float:
    start = time.perf_counter()
    run(key, spark, path).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "16g")
    load_catalog()
    cold = {key: timed(spark, key, path) for key in HEADLINE}
    warm = {key: timed(spark, key, path) for key in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "cold_total": round(sum(cold.values()), 3),
                "cpus": int(cores),
                "sf": os.path.basename(path).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
