"""Hotspot classes, tables, explanations and stability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import BANDS, HOTSPOT_CLASSES
from gridspark.functions.scalars import clip
from gridspark.scope import AREA, Scope, group_agg, quantiles, top_k, with_quantiles, with_rank

# Texts per hotspot class.
PLANNING_TEXT = {
    "high_value_high_confidence": "Strong planning-screening candidate.",
    "high_value_low_confidence": "Potentially important but requires local verification.",
    "medium_value_high_confidence": "Stable secondary candidate.",
    "low_value_high_uncertainty": "Caution zone; avoid strong conclusions without additional evidence.",
    "not_priority": "Not a hotspot priority cell.",
}
VERIFICATION_TEXT = {
    "high_value_high_confidence": "Optional local verification before operational use.",
    "high_value_low_confidence": "Local verification recommended before strong interpretation.",
    "medium_value_high_confidence": "Use as a secondary screening signal; verify if operationally important.",
    "low_value_high_uncertainty": "Additional evidence required; avoid definitive prioritization.",
    "not_priority": "No hotspot-specific verification needed from this layer.",
}
CAUTION_CLASSES = ("high_value_low_confidence", "low_value_high_uncertainty")
STABLE_CLASSES = ("high_value_high_confidence", "medium_value_high_confidence")
STABILITY_SHIFT = {
    "high_value_high_confidence": 0.05,
    "medium_value_high_confidence": 0.03,
    "high_value_low_confidence": -0.08,
    "low_value_high_uncertainty": -0.12,
}

def _lookup(table: Mapping[str, object], key: Column, default: object) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(default))


def _value_class(value: Column, band: Column, hot: Column, upper: Column, middle: Column) -> Column:
    high = value >= hot
    medium = (value >= upper) & (value < hot)
    low = value < middle
    return (
        F.when(low & (band == "low"), "low_value_high_uncertainty")
        .when(medium & (band == "high"), "medium_value_high_confidence")
        .when(high & (band == "low"), "high_value_low_confidence")
        .when(high & (band == "high"), "high_value_high_confidence")
        .otherwise("not_priority")
    )


def hotspot_class(df: DataFrame, scope: Scope = AREA, value: str = "p50", hot_quantile: float = 0.90) -> DataFrame:
    """H01. Dense rank (descending) and priority class from value tier and confidence band."""
    clean = df.withColumn("_value", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    cut = with_quantiles(clean, scope, {"_hot": ("_value", hot_quantile), "_upper": ("_value", 0.75), "_middle": ("_value", 0.50)})
    ranked = with_rank(cut, scope, [("_value", False)], "hotspot_rank", "dense")
    band = F.lower(F.col("confidence_band"))
    return (
        ranked.withColumn(
            "hotspot_priority_class",
            _value_class(F.col("_value"), band, F.col("_hot"), F.col("_upper"), F.col("_middle")),
        )
        .withColumn("hotspot_threshold", F.col("_hot"))
        .drop("_value", "_hot", "_upper", "_middle")
    )


def hotspots(df: DataFrame, q: float = 0.90, scope: Scope = AREA, value: str = "p50") -> DataFrame:
    """H02 table: cells at or above the q quantile (the maximum is always among them)."""
    classed = hotspot_class(df.drop("hotspot_rank", "hotspot_priority_class"), scope, value, q)
    return classed.withColumn("hotspot_quantile", F.lit(q)).where(
        F.coalesce(F.col(value), F.lit(0.0)) >= F.col("hotspot_threshold")
    )


def hotspot_digest(df: DataFrame, q: float = 0.90, scope: Scope = AREA, value: str = "p50") -> DataFrame:
    """H02 summary: nine fields per group."""
    classed = hotspot_class(df.drop("hotspot_rank", "hotspot_priority_class"), scope, value, q)
    v = F.coalesce(F.col(value), F.lit(0.0))
    is_class = lambda c: F.col("hotspot_priority_class") == c
    total = lambda c: F.coalesce(F.sum(F.when(is_class(c), v)), F.lit(0.0))
    return group_agg(
        classed,
        scope,
        F.lit(q).alias("hotspot_quantile"),
        F.max("hotspot_threshold").alias("hotspot_threshold"),
        F.count_if(v >= F.col("hotspot_threshold")).alias("hotspot_cell_count"),
        F.count_if(is_class("high_value_high_confidence")).alias("high_priority_count"),
        F.count_if(is_class("high_value_low_confidence")).alias("review_required_count"),
        F.count_if(is_class("medium_value_high_confidence")).alias("medium_value_high_confidence_count"),
        F.count_if(is_class("low_value_high_uncertainty")).alias("low_value_high_uncertainty_count"),
        total("high_value_high_confidence").alias("high_priority_value_sum"),
        total("high_value_low_confidence").alias("review_required_value_sum"),
    )


def _city_note(name: Column) -> Column:
    high, low = F.col("n_high_value_high_confidence"), F.col("n_high_value_low_confidence")
    return (
        F.when(
            (high > 0) & (high >= low),
            F.concat(name, F.lit(" has a stronger high-confidence hotspot signal for planning-screening, while remaining bounded by proxy-surface uncertainty.")),
        )
        .when(
            low > 0,
            F.concat(name, F.lit(" contains high-value hotspot candidates, but the current confidence layer indicates that local verification is needed before strong interpretation.")),
        )
        .when(
            F.col("n_low_value_high_uncertainty") > 0,
            F.concat(name, F.lit(" is caution-heavy in the hotspot layer; many cells should be treated as preliminary screening signals only.")),
        )
        .otherwise(F.concat(name, F.lit(" has limited priority hotspot signal under the current thresholds.")))
    )


def hotspot_summary(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """H03. One row per area: class counts, shares, means and medians over priority cells, note."""
    cls = F.col("hotspot_priority_class")
    priority = cls != "not_priority"
    count = lambda c: F.count_if(cls == c)
    over = lambda c: F.coalesce(F.avg(F.when(priority, F.col(c))), F.lit(0.0))
    constant = {
        "completeness_score": 0.0,
        "completeness_label": "unknown",
        "external_agreement_score": 0.5,
        "internal_support_score": 0.5,
        "district_support_flag": "not_available",
    }
    agg = group_agg(
        df,
        scope,
        F.max("run_id").alias("run_id"),
        F.max("area_slug").alias("area_slug"),
        F.count(F.lit(1)).alias("n_cells"),
        F.coalesce(F.max("official_total"), F.lit(0.0)).alias("official_total"),
        F.count_if(priority).alias("n_priority_cells"),
        *[count(c).alias(f"n_{c}") for c in HOTSPOT_CLASSES if c != "not_priority"],
        over("p50").alias("mean_p50_priority_cells"),
        over("confidence_score").alias("mean_confidence_priority_cells"),
        *[F.coalesce(F.max(c), F.lit(d)).alias(c) for c, d in constant.items()],
    )
    qs = quantiles(
        df,
        scope,
        {
            "hotspot_threshold_p90": ("p50", 0.9),
            "_med_p50": (F.when(priority, F.col("p50")), 0.5),
            "_med_rel": (F.when(priority, F.col("relative_uncertainty")), 0.5),
        },
    )
    share = lambda c: F.try_divide(F.col(c), F.col("n_cells"))
    return (
        agg.join(qs, list(scope.keys), "left")
        .withColumns(
            {
                "share_priority_cells": share("n_priority_cells"),
                "share_high_value_high_confidence": share("n_high_value_high_confidence"),
                "share_high_value_low_confidence": share("n_high_value_low_confidence"),
                "share_low_value_high_uncertainty": share("n_low_value_high_uncertainty"),
                "median_p50_priority_cells": F.coalesce("_med_p50", F.lit(0.0)),
                "median_relative_uncertainty_priority_cells": F.coalesce("_med_rel", F.lit(0.0)),
                "interpretation_note": _city_note(F.col("area_slug")),
            }
        )
        .drop("_med_p50", "_med_rel")
    )


def top_hotspots(df: DataFrame, n: int = 25, scope: Scope = AREA) -> DataFrame:
    """H04. First n priority cells per area by rank, then cell id, with two mapped texts."""
    priority = df.where(F.col("hotspot_priority_class") != "not_priority")
    cls = F.col("hotspot_priority_class")
    return top_k(priority, scope, [("hotspot_rank", True)], n, "position").select(
        "run_id",
        *scope.keys,
        "area_slug",
        "position",
        "hotspot_rank",
        "cell_id",
        "centroid_latitude",
        "centroid_longitude",
        "p10",
        "p50",
        "p90",
        "uncertainty_width",
        "relative_uncertainty",
        "confidence_score",
        "confidence_band",
        "hotspot_priority_class",
        _lookup(PLANNING_TEXT, cls, PLANNING_TEXT["not_priority"]).alias("planning_interpretation"),
        _lookup(VERIFICATION_TEXT, cls, VERIFICATION_TEXT["not_priority"]).alias("verification_need"),
    )


_LIST_COLUMNS = (
    "run_id",
    "area_id",
    "area_slug",
    "cell_id",
    "hotspot_rank",
    "p50",
    "p10",
    "p90",
    "relative_uncertainty",
    "confidence_score",
    "confidence_band",
    "hotspot_priority_class",
)


def _reasons(default: str, *rules: tuple[Column, str]) -> Column:
    text = F.concat_ws("; ", *[F.when(cond, F.lit(label)) for cond, label in rules])
    return F.when(text == "", F.lit(default)).otherwise(text)


def caution(df: DataFrame) -> DataFrame:
    """H05. Cells to treat with care, with reasons and action."""
    cls = F.col("hotspot_priority_class")
    reason = _reasons(
        "caution indicated by priority class",
        (cls == "high_value_low_confidence", "high estimated value but low confidence"),
        (cls == "low_value_high_uncertainty", "low-value cell with high uncertainty"),
        (F.col("confidence_band") == "low", "low confidence score"),
        (F.coalesce("relative_uncertainty", F.lit(0.0)) >= 0.5, "wide prediction interval"),
        (F.col("completeness_label").isin("moderate", "weak"), "moderate or weak map support"),
    )
    action = (
        F.when(cls == "high_value_low_confidence", "local verification recommended before strong planning interpretation")
        .when(cls == "low_value_high_uncertainty", "use only for preliminary screening and avoid definitive prioritization")
        .otherwise("compare with administrative or field data if operationally important")
    )
    return df.where(cls.isin(*CAUTION_CLASSES)).select(
        *_LIST_COLUMNS, reason.alias("caution_reason"), action.alias("recommended_action")
    )


def stable(df: DataFrame) -> DataFrame:
    """H06. Stable priority cells, with reasons and use case."""
    cls = F.col("hotspot_priority_class")
    reason = _reasons(
        "stable according to confidence framework",
        (F.col("confidence_band") == "high", "high confidence score"),
        (F.coalesce("relative_uncertainty", F.lit(0.0)) <= 0.25, "narrower uncertainty interval"),
        (F.col("completeness_label") == "good", "strong map completeness context"),
        (cls == "high_value_high_confidence", "high p50 with acceptable uncertainty"),
    )
    use = F.when(
        cls == "high_value_high_confidence", "service-planning screening; infrastructure prioritization screening"
    ).otherwise("urban density review; field verification prioritization")
    return df.where(cls.isin(*STABLE_CLASSES)).select(
        *_LIST_COLUMNS, reason.alias("stability_reason"), use.alias("planning_use_case")
    )


def stability_detail(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """H08 detail: stability metric of priority cells; the q90 scales are over priority cells of the area."""
    cls = F.col("hotspot_priority_class")
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    priority = df.where(cls != "not_priority")
    scaled = with_quantiles(
        priority, scope, {"_w90": (num("uncertainty_width"), 0.9), "_r90": (num("relative_uncertainty"), 0.9)}
    )
    norm = lambda c, q: 1.0 - F.least(num(c) / F.greatest(F.col(q), F.lit(1e-6)), F.lit(1.0))
    metric = clip(
        0.60 * num("confidence_score")
        + 0.25 * norm("relative_uncertainty", "_r90")
        + 0.15 * norm("uncertainty_width", "_w90")
        + _lookup(STABILITY_SHIFT, cls, 0.0),
        0.0,
        1.0,
    )
    m = F.col("stability_metric")
    return (
        scaled.withColumn("stability_metric", metric)
        .select(
            *scope.keys,
            "cell_id",
            F.coalesce(F.col("hotspot_rank"), F.lit(0)).cast("long").alias("hotspot_rank"),
            "hotspot_priority_class",
            num("p50").alias("p50"),
            num("relative_uncertainty").alias("relative_uncertainty"),
            num("confidence_score").alias("confidence_score"),
            "stability_metric",
            F.lit("proxy_from_confidence_and_interval_behavior").alias("stability_type"),
            F.when(m >= 0.67, "high").when(m < 0.40, "low").otherwise("medium").alias("stability_band"),
            F.when(
                m >= 0.67,
                "Priority cell shows relatively stable hotspot behavior within the bounded confidence framework.",
            )
            .otherwise("Priority cell should be treated cautiously because the bounded stability proxy remains moderate or low.")
            .alias("interpretation_note"),
        )
    )


def stability_summary(detail: DataFrame, scope: Scope = AREA) -> DataFrame:
    """H08 summary per area and class."""
    fine = scope.finer("hotspot_priority_class", factor=len(HOTSPOT_CLASSES))
    agg = group_agg(
        detail,
        fine,
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("stability_metric").alias("mean_stability_metric"),
        F.avg("confidence_score").alias("mean_confidence_score"),
    )
    qs = quantiles(
        detail,
        fine,
        {"median_stability_metric": ("stability_metric", 0.5), "median_relative_uncertainty": ("relative_uncertainty", 0.5)},
    )
    note = F.when(
        F.col("hotspot_priority_class").isin(*STABLE_CLASSES),
        "Stable hotspot classes retain stronger confidence/stability behavior than caution classes.",
    ).otherwise("Caution-oriented hotspot classes remain less stable and should not be treated as firm planning targets.")
    return agg.join(qs, list(fine.keys), "left").withColumn("interpretation_note", note)


def class_matrix(df: DataFrame, column: str = "hotspot_priority_class", scope: Scope = AREA) -> DataFrame:
    """H09. Area by class (or band) counts, zero-filled; pivot values are fixed."""
    values = list(BANDS if column == "confidence_band" else HOTSPOT_CLASSES)
    return df.groupBy(*scope.keys).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def zone_mask(df: DataFrame, zone: str, value: str = "surface_value", scope: Scope = AREA, hot: float = 0.90, cold: float = 0.10) -> DataFrame:
    """H10. Hot or cold flag by the area's quantile, with the threshold used."""
    if zone not in ("hotspot", "coldspot"):
        raise ValueError(f"unknown zone type: {zone}")
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    joined = with_quantiles(df, scope, {"selection_threshold": (v, hot if zone == "hotspot" else cold)})
    hit = v >= F.col("selection_threshold") if zone == "hotspot" else v <= F.col("selection_threshold")
    return joined.withColumn("zone_type", F.lit(zone)).withColumn("in_zone", hit)
