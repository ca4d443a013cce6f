"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from tidemill.queries import QUERIES  # noqa: E402
from tidemill.session import session  # noqa: E402

HEADLINE = [
    "hier_monthly_rollup", "resample_day_sum", "resample_week_left_sum", "resample_segment_week", "resample_mixed", "ohlc_month", "accumulate_compare",
    "freq_detect_events", "coherence", "level_effects", "envelope", "seasonal_profile_m", "stability_stats", "yoy_matrix", "gap_summary", "missing_pattern",
    "impute_linear", "impute_seasonal", "outlier_consensus", "outlier_cap", "outlier_isof_lof", "intermittency_class", "croston_fc", "tsb_fc", "ccf",
    "event_impact", "granger_proxy", "acf40", "kpss", "ols_trend", "theil_sen", "stl_components", "series_tests", "lag_features", "rolling_features",
    "calendar_features", "prepare_features", "future_frame", "fc_metrics", "fc_combo", "model_forecasts", "recon_bottom_up", "recon_top_down", "recon_override",
    "profile_columns", "schema_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hier_monthly_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
