"""Column contracts, vocabularies and frozen parameters."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature columns of a cell, in contract order.
GRID_FEATURES = (
    "building_count",
    "building_area",
    "residential_area",
    "commercial_area",
    "retail_area",
    "public_area",
    "road_length",
    "bus_stop_count",
    "park_area",
    "building_with_levels_count",
    "mean_building_levels",
    "total_floor_area",
    "schools_count",
    "hospitals_count",
    "parks_shops_count",
)
MODEL_FEATURES = GRID_FEATURES + ("poi_access_index", "combined_index")
CELL_COLUMNS = ("area_id", "cell_id", "latitude", "longitude") + MODEL_FEATURES
SURFACE_COLUMNS = CELL_COLUMNS + ("surface_value",)

# Columns summed into the combined index.
COMBINED_COLUMNS = (
    "building_count",
    "building_area",
    "residential_area",
    "commercial_area",
    "retail_area",
    "public_area",
    "road_length",
    "bus_stop_count",
    "park_area",
    "total_floor_area",
)

# Weights of the proxy score.
PROXY_WEIGHTS = {
    "total_floor_area": 0.35,
    "building_area": 0.18,
    "residential_area": 0.16,
    "building_count": 0.08,
    "road_length": 0.06,
    "bus_stop_count": 0.04,
    "schools_count": 0.03,
    "hospitals_count": 0.03,
    "parks_shops_count": 0.04,
    "combined_index": 0.03,
}
PROXY_EPSILON = 1e-6

# Interval surface and summary columns, in contract order.
INTERVAL_COLUMNS = (
    "run_id",
    "model_version",
    "area_id",
    "area_slug",
    "cell_id",
    "centroid_latitude",
    "centroid_longitude",
    "official_total",
    "member_count",
    "p10",
    "p50",
    "p90",
    "surface_value",
    "uncertainty_width",
    "relative_uncertainty",
    "model_stability_score",
    "completeness_score",
    "completeness_label",
    "completeness_support",
    "external_agreement_score",
    "internal_support_score",
    "confidence_score",
    "confidence_band",
    "hotspot_rank",
    "hotspot_priority_class",
    "district_support_flag",
)
SUMMARY_COLUMNS = (
    "run_id",
    "model_version",
    "area_id",
    "area_slug",
    "n_cells",
    "official_total",
    "sum_p50",
    "p50_total_gap_abs",
    "member_count",
    "mean_uncertainty_width",
    "median_relative_uncertainty",
    "mean_confidence_score",
    "share_high_confidence",
    "share_medium_confidence",
    "share_low_confidence",
    "hotspot_threshold_p90",
    "n_high_confidence_hotspots",
    "n_low_confidence_hotspots",
    "n_low_value_high_uncertainty",
    "completeness_score",
    "completeness_label",
    "external_agreement_score",
    "district_support_flag",
    "district_interval_coverage_available",
    "district_interval_coverage_rate",
)
BANDS = ("high", "medium", "low")
HOTSPOT_CLASSES = (
    "high_value_high_confidence",
    "high_value_low_confidence",
    "medium_value_high_confidence",
    "low_value_high_uncertainty",
    "not_priority",
)

CELL_SCHEMA = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in MODEL_FEATURES],
    ]
)


def missing_columns(columns, required) -> list[str]:
    have = set(columns)
    return [c for c in required if c not in have]
