"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridspark.session import local_session

HEADLINE = (
    "f04_weak_target",
    "u07_align_total",
    "h01_hotspot_class",
    "h03_hotspot_summary",
    "h08_stability_detail",
    "b02_surface_metrics",
    "b10_error_alignment",
    "b12_band_validation",
    "q01_profile",
    "q10_completeness",
    "g05_area_in_cells",
    "g08_cell_features",
    "g10_knn_access",
    "g12_areal_interpolation",
    "g15_zonal_sum",
    "x01_scan_claims",
    "x05_check_responses",
    "x11_retrieve",
    "t03_ridge_cross_validation",
    "i03_build_surface",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    from suite.load import QUERIES

    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
