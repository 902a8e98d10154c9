"""End-to-end plans: cell table, calibrated surface, interval surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import MODEL_FEATURES
from gridspark.operators import spatial as P
from gridspark.operators.ensemble import predict_members
from gridspark.operators.quality import completeness, qa_flags, validate, validate_interval, validate_surface
from gridspark.operators.scaling import calibrate, calibration_factor, combined_index
from gridspark.operators.training import TrainingConfig, predict_raw
from gridspark.operators.uncertainty import internal_support, interval_summary, interval_surface
from gridspark.scope import AREA, Scope, attach, materialize, stage


def build_cells(areas: DataFrame, objects: DataFrame, size_m: float = P.CELL_SIZE, clip: bool = True, scope: Scope = AREA) -> DataFrame:
    """G22. Areas and map objects to the cell table with 17 features: G01, G08, G10, F02, G11 in one plan.

    Only the number of areas is taken from ``scope``; rows per area are left unmeasured, so scaling runs
    as partial aggregates.
    """
    grid = P.make_grid(areas, size_m, clip)
    # the objects are measured once: neighbours and scaling read the written cells
    featured = materialize(P.centroids(P.cell_features(grid, objects, areas, size_m, scope)))
    placed = materialize(P.knn_access(featured, P.poi_points(objects), scope=scope))
    return P.feature_output(combined_index(placed, scope=scope), areas, scope)


def surface_output(df: DataFrame, model_name: str, total: str = "official_total", scope: Scope = AREA) -> DataFrame:
    """I02. Cells with model name, total, raw prediction, factor and calibrated value."""
    with_factor = calibration_factor(df, "pred", total, scope)
    final = calibrate(stage(with_factor, scope), "pred", total, scope, "surface_value")
    return final.withColumn("model_name", F.lit(model_name)).withColumnRenamed("pred", "raw_value")


def failing_areas(cells: DataFrame, scope: Scope = AREA) -> DataFrame:
    """Areas with validation or QA errors, one row per finding."""
    keys = list(scope.keys)
    issues = validate(cells, scope=scope).where(F.col("level") == "error").select(*keys, F.col("code").alias("issue"))
    flags = qa_flags(cells, scope=scope).where(F.col("severity") == "error").select(*keys, "issue")
    return issues.unionByName(flags)


def _gate(cells: DataFrame, totals: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Cells of sound areas that have a total, and the quarantine rows of the others."""
    keys = list(scope.keys)
    found = failing_areas(cells, scope)
    missing = cells.select(*keys).distinct().join(totals.select(*keys), keys, "left_anti").withColumn("issue", F.lit("no_official_total"))
    quarantine = found.unionByName(missing).distinct()
    bad = quarantine.select(*keys).distinct()
    return attach(cells.join(bad, keys, "left_anti"), totals, scope, "inner"), quarantine


def build_surface(
    cells: DataFrame, totals: DataFrame, model, model_name: str, features: Sequence[str] = MODEL_FEATURES, log_target: bool = True, scope: Scope = AREA
) -> dict[str, DataFrame]:
    """I03. Gate, predict, calibrate, validate, completeness. Failing areas go to ``quarantine``.

    ``cells`` is the table of ``build_cells`` (or a saved one); it feeds several branches, so it is written
    to the checkpoint folder once.
    """
    cells = materialize(cells)
    good, quarantine = _gate(cells, totals, scope)
    raw = predict_raw(model, good, features, log_target)
    surface = surface_output(raw, model_name, scope=scope)
    return {
        "surface": surface,
        "quarantine": quarantine,
        "issues": validate_surface(surface, scope),
        "completeness": completeness(cells, scope),
    }


def build_interval_surface(
    cells: DataFrame, totals: DataFrame, models: dict, config: TrainingConfig, run_id: str = "run", district: DataFrame | None = None, scope: Scope = AREA
) -> dict[str, DataFrame]:
    """I04. Gate, member predictions, intervals, confidence, hotspots, summary and issues."""
    cells = materialize(cells)
    good, quarantine = _gate(cells, totals, scope)
    members = materialize(predict_members(models, good, config).select(*scope.keys, "cell_id", "latitude", "longitude", "member_id", "pred"))
    areas = totals.join(completeness(cells, scope).select(*scope.keys, "completeness_score", "completeness_label"), list(scope.keys))
    context = internal_support(areas, district, scope)
    surface = materialize(interval_surface(members, context, run_id, scope=scope, n_members=len(models)))
    return {
        "surface": surface,
        "summary": interval_summary(surface, scope),
        "quarantine": quarantine,
        "issues": validate_interval(surface, scope),
    }
