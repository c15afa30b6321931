"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Pass query names to time others.
"""

from __future__ import annotations

import json
import os
import sys
import time

from terrasift.plans import registry
from terrasift.session import local_session

HEADLINE = [
    # ingestion
    "gps_fixes", "gps_fixes_utm", "route_resample", "station_series_json", "hydrography",
    # row-wise features and scores
    "calendar_features", "moon_night_features", "factor_scores", "habitat_additive", "habitat_ranking",
    # lookups
    "raster_sample", "climate_sample", "precipitation_week", "cloud_cover_daily", "nearest_water", "nearest_road",
    "nearest_station", "station_snow_asof", "clearest_scene", "vegetation_features", "summer_ndvi", "winter_index",
    "weather_source", "result_match", "containing_range", "area_of_observation", "assembled_context",
    # sampling
    "absence_temporally_matched", "absence_seasonal", "absence_unsuitable_season", "strategy_mix", "separation_check", "stratified_split",
    # reports
    "numeric_summary", "rule_report", "issue_list", "readiness_by_dataset", "quality_score", "iqr_outliers",
    "effect_sizes_pooled", "correlation_matrix", "score_auc", "moments", "duplicate_rows", "category_counts",
    # prediction, rasters, training tables
    "prediction_overall", "prediction_factors", "prediction_days", "prediction_hotspots", "slope_aspect", "steep_share_nearby",
    "training_features", "optimised_features", "f1_threshold", "batch_sweep", "resumable_enrichment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    queries = registry.load()
    # one small query starts the JVM's code paths before anything is timed
    queries["habitat_ranking"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "observations": rows,
        "observations_per_second": {
            k: round(rows / seconds[k])
            for k in ("nearest_water", "raster_sample", "assembled_context", "rule_report")
            if k in seconds
        },
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
