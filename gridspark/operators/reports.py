"""Report tables over finished results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.quality import validate_cases
from gridspark.operators.spatial import COMPONENT_MEANS, component_summary
from gridspark.scope import AREA, Scope


def _support_note() -> Column:
    return (
        F.when(
            (F.lower("completeness_label") == "good") & (F.col("share_high_confidence") >= 0.15),
            "Strongest support case with comparatively better completeness and a meaningful high-confidence share.",
        )
        .when(
            F.col("share_low_confidence") >= 0.25,
            "Confidence burden is heavier here; treat the surface as a bounded screening layer that requires stronger local verification.",
        )
        .otherwise("Intermediate support case: useful for screening and interpretation, but not for aggressive uncertainty claims.")
    )


def _coverage_note() -> Column:
    c, p = F.col("coverage_p10_p90"), F.col("protocol")
    say = lambda text: F.concat(p, F.lit(text))
    return (
        F.when(c.isNull(), "Coverage was not available from the frozen evidence stack.")
        .when(c >= 0.65, say(" coverage is moderate for a proxy-target setting, but still bounded by weak supervision."))
        .when(c >= 0.50, say(" coverage is usable but mixed; the interval layer should be described cautiously."))
        .otherwise(say(" coverage is weak in held-out proxy terms and should not be oversold."))
    )


def _alignment_note() -> Column:
    w = F.col("spearman_error_vs_uncertainty_width")
    return (
        F.when(w >= 0.70, "Uncertainty width tracks proxy-target error positively, but relative uncertainty and confidence ordering remain mixed.")
        .when(w >= 0.50, "Width/error alignment is present, but the broader confidence story remains mixed.")
        .when(
            (F.col("spearman_error_vs_relative_uncertainty") > 0) | (F.col("spearman_error_vs_confidence_score") < 0),
            "Some bounded error-alignment signal is present, but it is not strong enough for a simple confidence-as-error claim.",
        )
        .otherwise("Error-alignment evidence is mixed and should be carried as a limitation.")
    )


def _hotspot_note(name: Column) -> Column:
    high, low = F.col("n_high_value_high_confidence"), F.col("n_high_value_low_confidence")
    say = lambda text: F.concat(name, F.lit(text))
    return (
        F.when((high > 0) & (high >= low), say(" is the strongest hotspot-screening case because stable high-confidence priority cells are present."))
        .when(low > 0, say(" has potentially important hotspots, but they remain review-oriented because low-confidence priority cells are present."))
        .when(F.col("n_low_value_high_uncertainty") > 0, say(" is caution-heavy in the hotspot layer and should be used conservatively."))
        .otherwise(say(" has limited hotspot-priority support in the current evidence package."))
    )


def _band_note() -> Column:
    b = F.col("confidence_band")
    return (
        F.when(b == "high", "High-confidence cells show the lowest uncertainty burden and are the best screening candidates.")
        .when(b == "medium", "Medium-confidence cells dominate the practical baseline and should be interpreted as bounded screening support.")
        .otherwise("Low-confidence cells are review-oriented and should not be treated as firm operational targets.")
    )


def report_tables(
    summary: DataFrame,
    coverage: DataFrame,
    alignment: DataFrame,
    hotspots: DataFrame,
    bands: DataFrame,
    limitations: DataFrame,
    stability: DataFrame,
    areas: DataFrame | None = None,
    scope: Scope = AREA,
) -> dict[str, DataFrame]:
    """R01. Seven report tables: projection, optional area filter (a semi join), rule-based note."""
    keys = list(scope.keys)
    only = lambda df: df if areas is None else df.join(areas.select(*keys).distinct(), keys, "left_semi")
    note = lambda df, c: df.drop("interpretation_note").withColumn("interpretation_note", c)
    cols = {
        "coverage": ("n_cells", "official_total", "sum_p50", "median_relative_uncertainty", "share_high_confidence", "share_medium_confidence", "share_low_confidence", "completeness_score", "completeness_label", "interpretation_note"),
        "interval_coverage": ("protocol", "n_cells", "coverage_p10_p90", "below_p10_share", "above_p90_share", "median_relative_uncertainty", "interpretation_note"),
        "error_alignment": (
            "protocol",
            "n_cells",
            "spearman_error_vs_uncertainty_width",
            "pearson_error_vs_uncertainty_width",
            "spearman_error_vs_relative_uncertainty",
            "spearman_error_vs_confidence_score",
            "mean_error_high_confidence",
            "mean_error_medium_confidence",
            "mean_error_low_confidence",
            "interpretation_note",
        ),
        "hotspots": (
            "n_priority_cells",
            "n_high_value_high_confidence",
            "n_high_value_low_confidence",
            "n_medium_value_high_confidence",
            "n_low_value_high_uncertainty",
            "mean_confidence_priority_cells",
            "median_relative_uncertainty_priority_cells",
            "interpretation_note",
        ),
        "bands": ("confidence_band", "n_cells", "share_cells", "median_relative_uncertainty", "mean_uncertainty_width", "mean_error_if_available", "share_hotspot_priority_cells", "interpretation_note"),
        "stability": ("hotspot_priority_class", "n_cells", "mean_stability_metric", "median_relative_uncertainty", "mean_confidence_score", "interpretation_note"),
    }
    return {
        "coverage": note(summary, _support_note()).select(*keys, *cols["coverage"]),
        "interval_coverage": note(only(coverage), _coverage_note()).select(*keys, *cols["interval_coverage"]),
        "error_alignment": note(only(alignment), _alignment_note()).select(*keys, *cols["error_alignment"]),
        "hotspots": note(hotspots, _hotspot_note(F.col("area_slug"))).select(*keys, *cols["hotspots"]),
        "bands": note(bands, _band_note()).select(*keys, *cols["bands"]),
        "limitations": limitations,
        "stability": stability.select(*keys, *cols["stability"]),
    }


def _or_missing(rows: DataFrame, layer: str, where: str, found: str, limit: str) -> DataFrame:
    """Rows, or one literal "missing" row when there are none."""
    spark = rows.sparkSession
    blank = spark.createDataFrame(
        [(layer, where, "missing", found, limit)], "evidence_layer string, scope string, status string, available_result string, limitation string"
    )
    any_row = rows.select("evidence_layer").limit(1)
    return rows.unionByName(blank.join(F.broadcast(any_row), "evidence_layer", "left_anti"))


def limitation_rows(district: DataFrame, external: DataFrame, key: str = "area_id") -> DataFrame:
    """R02. Limitation rows of the district and external layers, each with a "missing" row when empty."""
    d = district.select(
        F.lit("district_interval_coverage").alias("evidence_layer"),
        F.col(key).cast("string").alias("scope"),
        F.lit("partial").alias("status"),
        F.format_string("compared=%d; mean_absolute_error_p50=%.1f", F.col("n_districts_compared").cast("long"), F.col("mean_absolute_error_p50")).alias("available_result"),
        F.lit("District interval coverage stays blocked without the cell-to-district mapping.").alias("limitation"),
    )
    e = external.select(
        F.lit("external_disagreement_alignment").alias("evidence_layer"),
        F.concat_ws(" / ", F.col(key).cast("string"), "benchmark_product").alias("scope"),
        F.lit("mixed").alias("status"),
        F.format_string("spearman(disagreement, uncertainty)=%.3f", "spearman_disagreement_vs_uncertainty").alias("available_result"),
        F.lit("Disagreement alignment is mixed and does not show that uncertainty rises with disagreement.").alias("limitation"),
    )
    return _or_missing(d, "district_interval_coverage", "benchmark areas", "no district summary found", "District interval coverage could not be summarized.").unionByName(
        _or_missing(e, "external_disagreement_alignment", "benchmark areas", "no external alignment summary found", "External disagreement alignment could not be summarized.")
    )


def headline(runs: DataFrame, sizes: DataFrame, completeness: DataFrame, benchmarks: DataFrame, ablation: DataFrame) -> DataFrame:
    """R03. One row of headline picks, each a single ``max_by`` / ``min_by``."""
    best = lambda c: F.max_by("benchmark_name", F.struct(F.col(c), F.col("benchmark_name")))
    parts = [
        runs.agg(F.min_by(F.struct("model_name", "validation_protocol"), F.struct("mean_calibrated_rmse", -F.col("mean_calibrated_r2"))).alias("_b")).select(
            F.col("_b.model_name").alias("best_model"), F.col("_b.validation_protocol").alias("best_protocol")
        ),
        sizes.agg(F.min_by("cell_size_m", F.struct("benchmark_score", "cell_size_m")).alias("best_cell_size_m")),
        completeness.agg(
            F.max_by("area_id", F.struct("completeness_score", -F.col("area_id"))).alias("most_complete_area"),
            F.min_by("area_id", F.struct("completeness_score", "area_id")).alias("least_complete_area"),
            F.avg("completeness_score").alias("mean_completeness"),
        ),
        benchmarks.agg(
            best("pearson_r").alias("best_pearson"),
            best("spearman_r").alias("best_spearman"),
            best("top_decile_overlap").alias("best_top_decile"),
            best("hotspot_iou").alias("best_iou"),
        ),
        ablation.where("is_selected_non_full_winner").agg(F.max("ablation_name").alias("strongest_ablation")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    return out


def status_counts(registry: DataFrame) -> DataFrame:
    """R04."""
    return registry.groupBy("status_label").agg(F.count(F.lit(1)).alias("areas"))


def case_metrics(cases: DataFrame, members: DataFrame, full: DataFrame, built: DataFrame, completeness: DataFrame, value: str = "surface_value") -> DataFrame:
    """R05. Curated cases joined to their member cells in two surfaces, aggregated per case.

    ``members`` is the long table of ``component_summary``; a registry with ``|``-joined ids is split first.
    """
    keys = ["area_id", "source_component_id"]
    cells = members.join(full.select("area_id", "cell_id", value, *[c for c in COMPONENT_MEANS if c in full.columns]), ["area_id", "cell_id"])
    both = cells.join(built.select("area_id", "cell_id", F.col(value).alias("_built")), ["area_id", "cell_id"], "left")
    per = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.sum(value).alias("total_value_full"),
        F.avg(value).alias("mean_value_full"),
        F.avg("_built").alias("mean_value_built_form"),
        *[F.avg(c).alias(f"{c}_mean") for c in COMPONENT_MEANS if c in full.columns],
    )
    return cases.join(per, keys).join(completeness.select("area_id", "completeness_score", "completeness_label"), "area_id", "left")


def split_members(registry: DataFrame, ids: str = "zone_ids") -> DataFrame:
    return registry.select("area_id", "source_component_id", F.explode(F.split(ids, r"\|")).alias("cell_id"))


def eval_tables(questions: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R06. Category, language and category x language counts by one cube; renamed evaluation columns."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    counts = questions.select(unknown("category"), unknown("language")).cube("category", "language").agg(F.count(F.lit(1)).alias("questions"))
    # Reader-facing names of the evaluation columns.
    names: Mapping[str, str] = {
        "config": "configuration",
        "question_count": "cases",
        "claim_boundary_violation_rate": "claim_boundary_intervention_rate",
        "critical_violation_rate": "critical_intervention_rate",
        "evidence_usage_rate": "evidence_usage_rate",
        "grounding_score_mean": "grounding_score_mean",
        "fallback_used_rate": "fallback_rate",
        "cache_hit_rate": "cache_hit_rate",
        "missing_artifact_rate": "missing_artifact_rate",
        "answer_completeness_score_mean": "completeness_mean",
        "limitation_awareness_score_mean": "limitation_awareness_mean",
        "unsafe_phrase_count_after_total": "unsafe_phrases_after",
    }
    return counts, summary.select(*[F.col(c).alias(n) for c, n in names.items() if c in summary.columns])


def qualitative(surface: DataFrame, built: DataFrame, registry: DataFrame, areas: DataFrame, completeness: DataFrame, value: str = "surface_value", scope: Scope = AREA) -> dict[str, DataFrame]:
    """R07. Components of both zones, validated curated cases, and their metrics."""
    summary = members = None
    for zone in ("hotspot", "coldspot"):
        s, m = component_summary(surface, zone, value, scope)
        summary = s if summary is None else summary.unionByName(s)
        members = m if members is None else members.unionByName(m)
    named = summary.join(areas.select("area_id", "area_slug"), "area_id")
    issues = validate_cases(registry, named, areas)
    cases = registry.join(named.select("area_id", "area_slug", "source_component_id"), ["area_slug", "source_component_id"])
    return {"candidates": summary, "members": members, "issues": issues, "cases": case_metrics(cases, members, surface, built, completeness, value)}
