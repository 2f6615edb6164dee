"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_QUERIES an
optional pattern of query names. Every query is run to completion with all its columns
(the noop sink), so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfline.catalog import QUERIES
from shelfline.session import local_session

HEADLINE = [
    "p01_melt_wide_days",
    "p02_pivot_horizon",
    "p05_horizon_extension",
    "p11_trim_before_release",
    "p28_winsorise",
    "j02_price_join",
    "j10_lagged_correlation",
    "j11_series_pairs",
    "a04_hierarchy_roll_up",
    "a12_zero_runs",
    "w01_lags",
    "w03_rolling_mean",
    "w09_lag_then_roll",
    "w10_price_partition_stats",
    "w13_price_change",
    "w15_running_sum_by_store",
    "m01_series_scale",
    "m04_wrmsse",
    "m06_wrmsse_by_level",
    "m07_leaf_sample_weight",
    "e01_label_encode",
    "e04_grouping_encoder",
    "e09_target_encodings",
    "k05_random_folds",
    "k06_stratified_folds",
    "k08_rolling_row_folds",
    "g01_feature_set_1",
    "g03_feature_set_3",
    "g04_feature_set_4",
    "g06_base_grain",
    "g14_recursive_mean_of_lags",
    "g15_alpha_blend",
    "g17_backtest",
    "g20_submission",
    "d01_autocorrelation",
    "d04_decomposition",
    "t01_bag_of_words",
    "t02_tf_idf",
    "t06_latent_components",
    "g08_boosted_trees",
    "g09_poisson_regression",
    "g10_classification",
    "g12_model_per_segment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    pattern = os.environ.get("BENCH_QUERIES")
    names = [n for n in QUERIES if re.search(pattern, n)] if pattern else HEADLINE
    spark = local_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}
        )
    )


if __name__ == "__main__":
    main()
