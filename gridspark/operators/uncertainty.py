"""Ensemble intervals, confidence scores and bands, per-area interval summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.contracts import INTERVAL_COLUMNS, SUMMARY_COLUMNS
from gridspark.functions.scalars import clip, display_name, norm_name, slug
from gridspark.operators.hotspots import hotspot_class
from gridspark.operators.scaling import calibrate
from gridspark.scope import AREA, Scope, attach, group_agg, quantiles, stage, with_group, with_quantiles, with_rank

SEED_STEP = 1009
QUANTILES = (0.10, 0.50, 0.90)
RELATIVE_EPSILON = 1e-6
DOWNGRADE_LABELS = ("moderate", "weak")


def member_seeds(spark: SparkSession, base: int, n: int) -> DataFrame:
    """U01. One row per ensemble member with its seed."""
    if n <= 0:
        raise ValueError("an ensemble needs at least one member")
    return spark.range(n).select(
        F.format_string("member_%02d", (F.col("id") + 1).cast("int")).alias("member_id"),
        (F.lit(base) + F.lit(SEED_STEP) * F.col("id")).alias("seed"),
    )


def bootstrap(df: DataFrame, seed: Column, scope: Scope = AREA, extra_keys: Sequence[str] = ()) -> DataFrame:
    """U02. Exactly n draws with replacement per group, as a multiplicity per source row.

    Every row is numbered inside its group; draw i picks row ``pmod(hash(seed, group, i), n) + 1``.
    Draws are counted per picked number *before* the join, so the join is one to one and no group is
    collected. ``seed`` may be a column, e.g. one seed per member. Returns rows with ``draws`` >= 1.
    """
    keys = [*scope.keys, *extra_keys]
    inner = scope.finer(*extra_keys)
    numbered = with_rank(df.withColumn("_seed", seed), inner, [(c, True) for c in scope.row_id], "_i", "row")
    sized = with_group(numbered, inner, {"_n": F.count(F.lit(1))})
    picks = (
        sized.select(*keys, (F.pmod(F.xxhash64("_seed", *keys, "_i"), F.col("_n")) + 1).alias("_i"))
        .groupBy(*keys, "_i")
        .agg(F.count(F.lit(1)).alias("draws"))
    )
    return numbered.join(picks, [*keys, "_i"]).drop("_i", "_seed")


def calibrate_members(members: DataFrame, total: str = "official_total", scope: Scope = AREA, n_members: int | None = None) -> DataFrame:
    """U05. Rescale every member so that it sums to the group's total."""
    return calibrate(members, "pred", total, scope.finer("member_id", factor=n_members), out="pred_calibrated")


def summarize_members(members: DataFrame, value: str = "pred_calibrated", scope: Scope = AREA, keep: Sequence[str] = ()) -> DataFrame:
    """U06. p10 / p50 / p90 over members of each cell; a cell has few members, so the aggregate is small."""
    qs = F.percentile(F.col(value), F.array(*[F.lit(q) for q in QUANTILES]))
    per_cell = members.groupBy(*scope.keys, *scope.row_id, *keep).agg(
        qs.alias("_q"), F.count(F.lit(1)).alias("member_count")
    )
    return per_cell.select(
        *scope.keys,
        *scope.row_id,
        *keep,
        "member_count",
        F.col("_q")[0].alias("p10"),
        F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p90"),
    ).withColumns(
        {
            "uncertainty_width": F.col("p90") - F.col("p10"),
            "relative_uncertainty": (F.col("p90") - F.col("p10")) / F.greatest(F.col("p50"), F.lit(RELATIVE_EPSILON)),
            "surface_value": F.col("p50"),
        }
    )


def align_to_total(df: DataFrame, total: str = "official_total", scope: Scope = AREA) -> DataFrame:
    """U07. Rescale the interval so that p50 sums to the total; unchanged when a total is not positive."""
    joined = with_group(df, scope, {"_sum": F.sum(F.coalesce("p50", F.lit(0.0)))})
    ok = (F.col(total) > 0) & (F.col("_sum") > 0)
    factor = F.when(ok, F.try_divide(F.col(total).cast("double"), F.col("_sum"))).otherwise(F.lit(1.0))
    scaled = joined.withColumns(
        {
            c: F.when(ok, F.coalesce(F.col(c), F.lit(0.0)) * factor).otherwise(F.col(c))
            for c in ("p10", "p50", "p90", "uncertainty_width")
        }
    )
    relative = F.when(
        ok, F.col("uncertainty_width") / F.greatest(F.col("p50"), F.lit(RELATIVE_EPSILON))
    ).otherwise(F.col("relative_uncertainty"))
    return scaled.withColumns({"relative_uncertainty": relative, "surface_value": F.col("p50")}).drop("_sum")


def stability(df: DataFrame, scope: Scope = AREA, epsilon: float = 1e-6) -> DataFrame:
    """U08. One minus relative uncertainty over its q90 inside the scope (area, or fold in validation)."""
    relative = F.coalesce(F.col("relative_uncertainty"), F.lit(float("inf")))
    joined = with_quantiles(df, scope, {"_q90": (relative, 0.90)})
    ratio = clip(relative / F.greatest(F.col("_q90"), F.lit(epsilon)), 0.0, 1.0)
    return joined.withColumn("model_stability_score", 1.0 - ratio).drop("_q90")


def confidence(df: DataFrame) -> DataFrame:
    """U09. Weighted score of stability, completeness, external and internal support."""
    part = lambda c: clip(F.col(c).cast("double"), 0.0, 1.0)
    score = (
        0.40 * F.coalesce(F.col("model_stability_score"), F.lit(0.0))
        + 0.25 * part("completeness_support")
        + 0.20 * part("external_agreement_score")
        + 0.15 * part("internal_support_score")
    )
    return df.withColumn("confidence_score", clip(score, 0.0, 1.0))


def band(score: Column) -> Column:
    """U10. high from 0.70, low under 0.40."""
    v = F.coalesce(score, F.lit(0.0))
    return F.when(v >= 0.70, "high").when(v < 0.40, "low").otherwise("medium")


def band_by_rank(df: DataFrame, label: str | None = "completeness_label", scope: Scope = AREA, out: str = "rank_band") -> DataFrame:
    """U11. Bands by thirds of the average percent rank, one step down where completeness is poor."""
    valued = df.withColumn("_rel", F.coalesce(F.col("relative_uncertainty"), F.lit(float("inf"))))
    ranked = with_rank(valued, scope, [("_rel", True)], "_rank", "average")
    pct = F.col("_rank") / F.col("_n")
    plain = F.when(pct <= 1.0 / 3.0, "high").when(pct > 2.0 / 3.0, "low").otherwise("medium")
    final = plain
    if label is not None:
        poor = F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))).isin(*DOWNGRADE_LABELS)
        final = F.when(poor, F.when(plain == "high", "medium").otherwise("low")).otherwise(plain)
    return with_group(ranked, scope, {"_n": F.count(F.lit(1))}).withColumn(out, final).drop("_rel", "_rank", "_n")


def internal_support(areas: DataFrame, district: DataFrame | None, scope: Scope = AREA) -> DataFrame:
    """U12. Support score and flag from district benchmark correlations; areas without one get 0.50."""
    if district is None:
        score, found = F.lit(None).cast("double"), F.lit(False)
        joined = areas
    else:
        boundary = F.when(F.coalesce(F.col("boundary_warning_count"), F.lit(0)) == 0, 1.0).otherwise(0.5)
        part = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
        scored = district.select(
            *scope.keys, clip(0.45 * part("pearson_r") + 0.35 * part("spearman_r") + 0.20 * boundary, 0.0, 1.0).alias("_s")
        )
        joined = attach(areas, scored, scope)
        score, found = F.col("_s"), F.col("_s").isNotNull()
    return joined.withColumns(
        {
            "internal_support_score": F.coalesce(score, F.lit(0.50)),
            "district_support_flag": F.when(~found, "not_available").when(score >= 0.60, "strong").otherwise("mixed"),
            "district_interval_coverage_available": F.lit(False),
            "district_interval_coverage_rate": F.lit(None).cast("double"),
        }
    ).drop("_s")


def interval_surface(
    members: DataFrame,
    context: DataFrame,
    run_id: str = "run",
    model_version: str = "rf500m_uncertainty",
    scope: Scope = AREA,
    n_members: int | None = None,
) -> DataFrame:
    """U05 to U10 and H01: the 26-column interval surface from raw member predictions.

    ``members`` has ``area_id, cell_id, latitude, longitude, member_id, pred``; ``context`` one row per
    area with ``area_name, official_total, completeness_score, completeness_label,
    internal_support_score, district_support_flag``.
    """
    place = ("latitude", "longitude")
    totals = context.select(*scope.keys, "official_total")
    with_totals = attach(members, totals, scope)
    calibrated = calibrate_members(with_totals, scope=scope, n_members=n_members)
    summary = summarize_members(calibrated, scope=scope, keep=place)
    aligned = align_to_total(stage(attach(summary, context, scope), scope), scope=scope)
    supported = stability(stage(aligned, scope), scope).withColumns(
        {
            "completeness_support": clip(F.col("completeness_score") / 100.0, 0.0, 1.0),
            "external_agreement_score": F.lit(0.50),
        }
    )
    banded = confidence(supported).withColumn("confidence_band", band(F.col("confidence_score")))
    return hotspot_class(stage(banded, scope), scope).select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_version).alias("model_version"),
        *scope.keys,
        slug(display_name(F.col("area_name"))).alias("area_slug"),
        "cell_id",
        F.col("latitude").alias("centroid_latitude"),
        F.col("longitude").alias("centroid_longitude"),
        *[c for c in INTERVAL_COLUMNS if c not in ("run_id", "model_version", "area_id", "area_slug", "cell_id", "centroid_latitude", "centroid_longitude")],
    )


def interval_summary(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """U13. One 25-column row per area from the interval surface."""
    share = lambda b: F.avg(F.when(F.col("confidence_band") == b, 1.0).otherwise(0.0))
    n_class = lambda c: F.count_if(F.col("hotspot_priority_class") == c)
    constant = (
        "run_id",
        "model_version",
        "area_slug",
        "official_total",
        "member_count",
        "completeness_score",
        "completeness_label",
        "external_agreement_score",
        "district_support_flag",
    )
    agg = group_agg(
        df,
        scope,
        F.count(F.lit(1)).alias("n_cells"),
        *[F.max(c).alias(c) for c in constant],
        F.sum("p50").alias("sum_p50"),
        F.avg("uncertainty_width").alias("mean_uncertainty_width"),
        F.avg("confidence_score").alias("mean_confidence_score"),
        share("high").alias("share_high_confidence"),
        share("medium").alias("share_medium_confidence"),
        share("low").alias("share_low_confidence"),
        n_class("high_value_high_confidence").alias("n_high_confidence_hotspots"),
        n_class("high_value_low_confidence").alias("n_low_confidence_hotspots"),
        n_class("low_value_high_uncertainty").alias("n_low_value_high_uncertainty"),
    )
    qs = quantiles(
        df, scope, {"median_relative_uncertainty": ("relative_uncertainty", 0.5), "hotspot_threshold_p90": ("p50", 0.9)}
    )
    return (
        agg.join(qs, list(scope.keys), "left")
        .withColumns(
            {
                "p50_total_gap_abs": F.abs(F.col("sum_p50") - F.col("official_total")),
                "district_interval_coverage_available": F.lit(False),
                "district_interval_coverage_rate": F.lit(None).cast("double"),
            }
        )
        .select(*SUMMARY_COLUMNS)
    )
