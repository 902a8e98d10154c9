"""Data quality: profiles, flags, validators, completeness, curated cases and question banks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.contracts import (
    BANDS,
    CELL_COLUMNS,
    HOTSPOT_CLASSES,
    INTERVAL_COLUMNS,
    MODEL_FEATURES,
    SURFACE_COLUMNS,
    missing_columns,
)
from gridspark.functions.scalars import clip, to_bool, to_num, to_num_of
from gridspark.scope import AREA, Scope, attach, group_agg, materialize, quantiles, with_rank

CRITICAL_ZERO_COLUMNS = ("road_length", "poi_access_index")
SPARSE_SHARE = 0.98


def sanitize(df: DataFrame, cols: Sequence[str] = MODEL_FEATURES, coordinates: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """Q09. Drop empty rows and rows without coordinates; features to number, null to 0, clipped at 0."""
    out = df.dropna(how="all")
    coords = [c for c in coordinates if c in df.columns]
    if coords:
        out = out.dropna(subset=coords)
    present = [c for c in cols if c in df.columns]
    return out.withColumns({c: clip(F.coalesce(to_num_of(df, c), F.lit(0.0))) for c in present})


def _long(df: DataFrame, cols: Sequence[str], scope: Scope) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column"), to_num_of(df, c).alias("value")) for c in cols])
    return df.select(*scope.keys, F.explode(items).alias("_e")).select(*scope.keys, "_e.*")


def profile(df: DataFrame, cols: Sequence[str] = MODEL_FEATURES, scope: Scope = AREA) -> DataFrame:
    """Q01. Count, mean, median, p95, max, zero share and distinct count per area and feature."""
    present = [c for c in cols if c in df.columns]
    long = _long(df, present, scope)
    fine = scope.finer("column", factor=len(present))
    v = F.col("value")
    agg = group_agg(
        long,
        fine,
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))).alias("zero_share"),
        F.count_if(v < 0).alias("negative_count"),
        F.min(v).alias("min"),
    )
    distinct = long.where(v.isNotNull()).groupBy(*fine.keys, "value").agg(F.lit(1).alias("_o"))
    uniques = distinct.groupBy(*fine.keys).agg(F.count(F.lit(1)).alias("unique_count"))
    qs = quantiles(long, fine, {"median": ("value", 0.5), "p95": ("value", 0.95)})
    keys = list(fine.keys)
    return (
        agg.join(uniques, keys, "left")
        .join(qs, keys, "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("long"))
    )


def _row_facts(df: DataFrame, scope: Scope) -> DataFrame:
    """Row count, missing coordinates and duplicate ids per group; the id count is pre-aggregated."""
    has = lambda c: c in df.columns
    null_count = lambda c: F.count_if(F.col(c).isNull()) if has(c) else F.count(F.lit(1))
    facts = group_agg(
        df,
        scope,
        F.count(F.lit(1)).alias("row_count"),
        null_count("latitude").alias("null_latitude"),
        null_count("longitude").alias("null_longitude"),
    )
    if not has("cell_id"):
        return facts.withColumn("duplicate_ids", F.col("row_count"))
    per_id = df.groupBy(*scope.keys, "cell_id").agg(F.count(F.lit(1)).alias("_m"))
    dup = per_id.groupBy(*scope.keys).agg(F.sum(F.col("_m") - 1).alias("duplicate_ids"))
    return facts.join(dup, list(scope.keys), "left").withColumn("duplicate_ids", F.coalesce("duplicate_ids", F.lit(0)))


def _flag(cond: Column, severity: str, column: Column, issue: str, details: Column) -> Column:
    row = F.struct(
        F.lit(severity).alias("severity"), column.alias("column"), F.lit(issue).alias("issue"), details.alias("details")
    )
    return F.when(cond, row)


def qa_flags(df: DataFrame, cols: Sequence[str] = MODEL_FEATURES, scope: Scope = AREA, profiles: DataFrame | None = None) -> DataFrame:
    """Q02. Error and warning rows from the profile and the row facts."""
    profiles = profiles if profiles is not None else profile(df, cols, scope)
    facts = _row_facts(df, scope)
    joined = attach(profiles, facts, scope)
    column = F.col("column")
    feature_rules = F.array_compact(
        F.array(
            _flag(F.col("negative_count") > 0, "error", column, "negative_values", F.format_string("Found %d negative values.", "negative_count")),
            _flag(
                (F.col("unique_count") <= 1) & (F.col("row_count") > 1),
                "warning",
                column,
                "constant_feature",
                F.lit("Feature has one unique numeric value across the area."),
            ),
            _flag(F.col("zero_share") >= SPARSE_SHARE, "warning", column, "extreme_zero_share", F.format_string("Zero share is %.3f.", "zero_share")),
            _flag(
                column.isin(*CRITICAL_ZERO_COLUMNS) & (F.col("unique_count") == 1) & (F.col("max") == 0.0),
                "error",
                column,
                "zero_critical_feature",
                F.lit("Critical feature collapsed to zero across the whole area."),
            ),
        )
    )
    area_rules = F.array_compact(
        F.array(
            _flag(
                (F.col("null_latitude") > 0) | (F.col("null_longitude") > 0),
                "error",
                F.lit("latitude/longitude"),
                "missing_coordinates",
                F.format_string("latitude null=%d, longitude null=%d.", "null_latitude", "null_longitude"),
            ),
            _flag(F.col("duplicate_ids") > 0, "error", F.lit("cell_id"), "duplicate_cell_ids", F.format_string("Found %d duplicated cell ids.", "duplicate_ids")),
            *[
                _flag(F.lit(True), "error", F.lit(c), "missing_feature_column", F.lit("Column is absent from the feature dataset."))
                for c in missing_columns(df.columns, cols)
            ],
        )
    )
    keys = list(scope.keys)
    return joined.select(*keys, F.inline(feature_rules)).unionByName(facts.select(*keys, F.inline(area_rules)))


def qa_summary(df: DataFrame, cols: Sequence[str] = MODEL_FEATURES, scope: Scope = AREA, profiles: DataFrame | None = None) -> DataFrame:
    """Q03. One QA row per area."""
    profiles = profiles if profiles is not None else profile(df, cols, scope)
    facts = _row_facts(df, scope)
    shown = ("building_area", "road_length", "total_floor_area")
    zero = lambda c: F.max(F.when(F.col("column") == c, F.col("zero_share")))
    counts = attach(profiles, facts.select(*scope.keys, "row_count"), scope).groupBy(*scope.keys).agg(
        F.sum("negative_count").alias("negative_feature_values"),
        F.count_if((F.col("unique_count") <= 1) & (F.col("row_count") > 1)).alias("constant_feature_count"),
        F.count_if(F.col("zero_share") >= SPARSE_SHARE).alias("high_zero_share_feature_count"),
        *[zero(c).alias(f"{c}_zero_share") for c in shown],
    )
    return facts.join(counts, list(scope.keys), "left").withColumn(
        "missing_feature_columns", F.lit(len(missing_columns(df.columns, cols))).cast("long")
    )


def qa_digest(summary: DataFrame, flags: DataFrame, profiles: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Q04. One row: areas, rows, errors, warnings, areas with errors, medians of key columns over areas."""
    areas = summary.agg(F.count(F.lit(1)).alias("areas"), F.sum("row_count").alias("total_rows"))
    counts = flags.agg(
        F.count_if(F.col("severity") == "error").alias("qa_errors"),
        F.count_if(F.col("severity") == "warning").alias("qa_warnings"),
        F.count_distinct(F.when(F.col("severity") == "error", F.col("area_id"))).alias("areas_with_errors"),
    )
    wanted = {}
    for c in key_columns:
        for stat in ("median", "p95", "max"):
            wanted[f"{c}_{stat}"] = (F.when(F.col("column") == c, F.col(stat)), 0.5)
    one = Scope(keys=(), row_id=("area_id", "column"), groups=1)
    meds = quantiles(profiles, one, wanted)
    return areas.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(meds))


def _issue(cond: Column, level: str, code: str, message: Column | str, rows: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        cond,
        F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"), rows.cast("long").alias("affected_rows")),
    )


def validate(
    df: DataFrame,
    required: Sequence[str] = CELL_COLUMNS,
    non_negative: Sequence[str] = MODEL_FEATURES,
    value_column: str | None = None,
    coordinates: tuple[str, str] = ("latitude", "longitude"),
    id_column: str = "cell_id",
    scope: Scope = AREA,
    extra: Sequence[tuple[Column, str, str, str]] = (),
) -> DataFrame:
    """Q05. Issue rows per area from one aggregate of ``count_if`` and a per-id count.

    ``extra`` holds ``(bad-row condition, level, code, message)`` rules checked in the same pass.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    keys = list(scope.keys)
    data = [c for c in df.columns if c not in keys]
    checks: list[tuple[str, Column, str, str, str]] = []
    empty = F.forall(F.array(*[F.col(c).isNull() for c in data]), lambda v: v)
    checks.append(("empty", empty, "warning", "empty_rows", "Dataset contains fully empty rows."))
    coords = [c for c in coordinates if c in df.columns]
    if coords:
        missing = F.exists(F.array(*[F.col(c).isNull() for c in coords]), lambda v: v)
        checks.append(("coords", missing, "error", "missing_coordinates", f"Rows with missing {coordinates[0]}/{coordinates[1]} were found."))
    if id_column in df.columns:
        checks.append(("id", F.col(id_column).isNull(), "error", "missing_cell_id", f"Rows with missing {id_column} were found."))
    for c in non_negative:
        if c in numeric:
            checks.append((f"neg_{c}", F.col(c) < 0, "error", "negative_values", f"Column '{c}' contains negative values."))
    if value_column is not None and value_column in df.columns:
        bad = F.coalesce(to_num(F.col(value_column)), F.lit(0.0)) <= 0
        checks.append(("value", bad, "warning", "non_positive_value", f"{value_column} contains zero or negative values."))
    for i, (cond, level, code, message) in enumerate(extra):
        checks.append((f"x{i}", cond, level, code, message))
    counts = df.groupBy(*keys).agg(*[F.count_if(cond).alias(f"_{n}") for n, cond, *_ in checks])
    rules = [_issue(F.col(f"_{n}") > 0, level, code, message, F.col(f"_{n}")) for n, _, level, code, message in checks]
    if id_column in df.columns:
        per_id = df.where(F.col(id_column).isNotNull()).groupBy(*keys, id_column).agg(F.count(F.lit(1)).alias("_m"))
        dup = per_id.groupBy(*keys).agg(F.sum(F.col("_m") - 1).alias("_dup"))
        counts = counts.join(dup, keys, "left") if keys else counts.crossJoin(F.broadcast(dup))
        rules.append(_issue(F.col("_dup") > 0, "error", "duplicate_cell_id", f"Duplicate {id_column} values were found.", F.col("_dup")))
    lost = missing_columns(df.columns, required)
    if lost:
        rules.append(_issue(F.lit(True), "error", "missing_columns", "Missing required columns: " + ", ".join(lost), F.lit(0)))
    return counts.select(*keys, F.inline(F.array_compact(F.array(*rules))))


def validate_surface(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """Q05 for a calibrated surface."""
    return validate(df, SURFACE_COLUMNS, MODEL_FEATURES, "surface_value", scope=scope)


# Columns of the interval surface that may not be negative.
INTERVAL_NON_NEGATIVE = (
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
    "completeness_support",
    "external_agreement_score",
    "internal_support_score",
    "confidence_score",
    "hotspot_rank",
)


def validate_interval(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """Q06. Q05 plus final = p50, vocabularies, and band agreeing with the score."""
    have = set(df.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("null"))
    extra = []
    if {"surface_value", "p50"} <= have:
        gap = F.coalesce(F.abs(F.col("surface_value") - F.col("p50")) > 1e-9, F.lit(False))
        extra.append((gap, "error", "invalid_final_alias", "surface_value must equal p50 for every row."))
    if "confidence_band" in have:
        extra.append((~text("confidence_band").isin(*BANDS), "error", "invalid_confidence_band", "confidence_band must be one of: high, medium, low."))
    if {"confidence_score", "confidence_band"} <= have:
        score = F.coalesce(F.col("confidence_score"), F.lit(-1.0))
        expected = F.when(score >= 0.70, "high").when(score < 0.40, "low").otherwise("medium")
        extra.append((expected != text("confidence_band"), "error", "confidence_band_mismatch", "confidence_band does not match the confidence_score thresholds."))
    if "hotspot_priority_class" in have:
        extra.append((~text("hotspot_priority_class").isin(*HOTSPOT_CLASSES), "error", "invalid_hotspot_priority_class", "hotspot_priority_class is outside the vocabulary."))
    return validate(df, INTERVAL_COLUMNS, INTERVAL_NON_NEGATIVE, "surface_value", ("centroid_latitude", "centroid_longitude"), "cell_id", scope, extra)


# Columns that the consistency checks of a ranked surface read.
CHECKED = (
    "p10",
    "p50",
    "p90",
    "uncertainty_width",
    "confidence_score",
    "confidence_band",
    "hotspot_priority_class",
    "official_total",
    "hotspot_rank",
)


def _consistency(df: DataFrame, scope: Scope, total_tolerance: float, tolerance: float, ranked: bool, finite: bool) -> DataFrame:
    bad = lambda c: F.coalesce(c, F.lit(True))
    p10, p50, p90 = F.col("p10"), F.col("p50"), F.col("p90")
    score = F.col("confidence_score")
    checks = {
        "quantile_order": bad((p10 > p50) | (p50 > p90)),
        "interval_width": bad(F.abs(F.col("uncertainty_width") - (p90 - p10)) > tolerance),
        "confidence_range": bad(~score.between(0, 1)),
        "confidence_band": ~F.coalesce(F.col("confidence_band"), F.lit("null")).isin(*BANDS),
        "priority_class": ~F.coalesce(F.col("hotspot_priority_class"), F.lit("null")).isin(*HOTSPOT_CLASSES),
    }
    if finite:
        rel = F.col("relative_uncertainty")
        checks["finite_relative"] = bad(F.isnan(rel) | (F.abs(rel) == float("inf")))
    # ranks and values of neighbours meet in a join: both sides must read the same doubles
    work = materialize(df.select(*scope.keys, *CHECKED)) if ranked else df
    aggs = [F.count_if(c).alias(n) for n, c in checks.items()]
    gap = F.abs(F.sum("p50") - F.max("official_total"))
    limit = F.greatest(F.lit(total_tolerance), F.max("official_total") * 1e-9)
    aggs.append((gap > limit).cast("long").alias("total_gap"))
    if ranked:
        # rows sorted by rank must not rise in p50: compare the value range of neighbouring ranks
        aggs.append((F.count_if(F.col("hotspot_rank") == 1) < 1).cast("long").alias("rank_start"))
        per_rank = work.groupBy(*scope.keys, "hotspot_rank").agg(F.max("p50").alias("_hi"), F.min("p50").alias("_lo"))
        # ranks are dense, so the next rank is rank + 1: a self equi-join instead of one sorted group
        ahead = per_rank.select(*scope.keys, (F.col("hotspot_rank") - 1).alias("hotspot_rank"), F.col("_hi").alias("_next"))
        order = (
            per_rank.join(ahead, [*scope.keys, "hotspot_rank"], "left")
            .groupBy(*scope.keys)
            .agg(F.count_if(F.col("_next") > F.col("_lo")).alias("rank_order"))
        )
    out = group_agg(work, scope, *aggs)
    names = [*checks, "total_gap"]
    if ranked:
        out = out.join(order, list(scope.keys), "left")
        names += ["rank_start", "rank_order"]
    items = F.array_compact(
        F.array(*[F.when(F.col(n) > 0, F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("affected_rows"))) for n in names])
    )
    return out.select(*scope.keys, F.inline(items))


def validate_ranked(df: DataFrame, scope: Scope = AREA, tolerance: float = 1e-6) -> DataFrame:
    """Q07. Failed consistency checks per area of a ranked interval surface."""
    return _consistency(df, scope, 1e-4, tolerance, ranked=True, finite=False)


def validate_package(df: DataFrame, scope: Scope = AREA, tolerance: float = 1e-6) -> DataFrame:
    """Q08. Q06 errors and consistency checks with finite relative uncertainty and a looser total."""
    issues = validate_interval(df, scope).where(F.col("level") == "error")
    return _consistency(df, scope, 1e-3, tolerance, ranked=False, finite=True).unionByName(
        issues.select(*scope.keys, F.col("code").alias("check"), "affected_rows")
    )


# Features behind each completeness zero share, and the layer that backs it.
COMPLETENESS_FEATURES = {
    "building": ("building_area", "buildings"),
    "road": ("road_length", "roads"),
    "poi": ("poi_access_index", None),
    "total_floor_area": ("total_floor_area", None),
    "bus_stop": ("bus_stop_count", "bus_stops"),
    "park": ("park_area", "parks"),
    "schools": ("schools_count", "schools"),
    "hospitals": ("hospitals_count", "hospitals"),
    "retail": ("retail_area", "shops"),
}
OPTIONAL_PARTS = ("bus_stop", "park", "schools", "hospitals", "retail")


def completeness_label(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 55, "moderate").otherwise("weak")


def completeness(
    cells: DataFrame,
    scope: Scope = AREA,
    layers: DataFrame | None = None,
    warnings: DataFrame | None = None,
) -> DataFrame:
    """Q10. Map completeness 0 to 100 per area, with sub-scores, from one aggregate.

    ``layers`` (optional) has one row per area and a boolean per layer name; without it a layer counts as
    present when any cell shows it. ``warnings`` (optional) has ``layer_warning_count`` and
    ``qa_warning_count`` per area. Outputs round half to even.
    """
    def zero_share(c):
        if c not in cells.columns:
            return F.lit(1.0)
        v = to_num(F.col(c))
        return F.coalesce(F.avg(F.when(v.isNotNull(), (v <= 0).cast("double"))), F.lit(1.0))

    agg = group_agg(cells, scope, *[zero_share(c).alias(f"_z_{n}") for n, (c, _) in COMPLETENESS_FEATURES.items()])
    if layers is not None:
        agg = attach(agg, layers, scope)
    if warnings is not None:
        agg = attach(agg, warnings, scope)
    n_layer = F.coalesce(F.col("layer_warning_count"), F.lit(0)) if warnings is not None else F.lit(0)
    n_qa = F.coalesce(F.col("qa_warning_count"), F.lit(0)) if warnings is not None else F.lit(0)
    presence = {n: clip(1.0 - F.col(f"_z_{n}"), 0.0, 1.0) for n in COMPLETENESS_FEATURES}

    def backed(n):
        layer = COMPLETENESS_FEATURES[n][1]
        if layers is None:
            return F.when(presence[n] > 0, 1.0).otherwise(0.0)
        return F.when(F.coalesce(F.col(layer), F.lit(False)), 1.0).otherwise(0.0)

    half = lambda n: 0.5 * presence[n] + 0.5 * backed(n)
    critical = (half("building") + half("road") + presence["poi"]) / 3.0
    optional = sum((half(n) for n in OPTIONAL_PARTS[1:]), half(OPTIONAL_PARTS[0])) / 5.0
    density = (presence["building"] + presence["road"] + presence["total_floor_area"]) / 3.0
    warn = F.greatest(F.lit(0.0), 1.0 - 0.15 * n_layer - 0.03 * n_qa)
    score = 100.0 * (0.45 * critical + 0.20 * optional + 0.25 * density + 0.10 * warn)
    positive = lambda c: (c > 0).cast("long")
    return agg.withColumns({"_c": critical, "_o": optional, "_d": density, "_w": warn, "_s": score}).select(
        *scope.keys,
        F.bround("_s", 3).alias("completeness_score"),
        completeness_label(F.col("_s")).alias("completeness_label"),
        F.bround("_c", 3).alias("critical_coverage_score"),
        F.bround("_o", 3).alias("optional_coverage_score"),
        F.bround("_d", 3).alias("density_quality_score"),
        F.bround("_w", 3).alias("warning_quality_score"),
        n_layer.cast("long").alias("layer_warning_count"),
        n_qa.cast("long").alias("qa_warning_count"),
        *[F.bround(f"_z_{n}", 6).alias(f"{n}_zero_share") for n in COMPLETENESS_FEATURES],
        (positive(backed("building")) + positive(backed("road")) + positive(presence["poi"])).alias("critical_nonempty_layers"),
        sum((positive(backed(n)) for n in OPTIONAL_PARTS[1:]), positive(backed(OPTIONAL_PARTS[0]))).alias("optional_nonempty_layers"),
    )


def completeness_batch(cells: DataFrame, scope: Scope = AREA) -> DataFrame:
    """Q11. Completeness of every area, ranked. One row per area, so the order is a small global sort."""
    return completeness(cells, scope).orderBy(F.desc("completeness_score"), *scope.keys)


# Case ids a curated report must use per zone type.
CASE_IDS = {"hotspot": ("H1", "H2"), "coldspot": ("L1", "L2")}
CASE_TEXT = ("case_title", "interpretation_label", "narrative_summary")


def validate_cases(
    registry: DataFrame,
    candidates: DataFrame,
    areas: DataFrame,
    case_ids: Mapping[str, Sequence[str]] = CASE_IDS,
) -> DataFrame:
    """Q14. Issue rows of a curated case registry: counts, id sets, duplicates, texts, known components."""
    clean = registry.withColumns(
        {
            "area_slug": F.lower(F.trim("area_slug")),
            "zone_type": F.lower(F.trim("zone_type")),
            **{c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("case_id", "source_component_id", *CASE_TEXT)},
            "include_in_report": to_bool(F.col("include_in_report"), extra=("y",)),
        }
    )
    known = areas.select(F.col("area_slug")).distinct()
    issue = lambda df, code, detail: df.select("area_slug", F.lit(code).alias("issue"), detail.alias("details"))
    used = clean.where("include_in_report")
    out = issue(clean.join(known, "area_slug", "left_anti").distinct(), "unsupported_area", F.col("area_slug"))
    out = out.unionByName(issue(clean.where(~F.col("zone_type").isin(*case_ids)), "invalid_zone_type", F.col("zone_type")))
    per = used.groupBy("area_slug").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("zone_type") == z).alias(f"n_{z}") for z in case_ids],
    )
    expected = sum(len(v) for v in case_ids.values())
    counts = known.join(per, "area_slug", "left").na.fill(0)
    out = out.unionByName(issue(counts.where(F.col("n") != expected), "wrong_case_count", F.col("n").cast("string")))
    for zone, ids in case_ids.items():
        out = out.unionByName(issue(counts.where(F.col(f"n_{zone}") != len(ids)), f"wrong_{zone}_count", F.col(f"n_{zone}").cast("string")))
        odd = used.where((F.col("zone_type") == zone) & ~F.col("case_id").isin(*ids))
        out = out.unionByName(issue(odd, "unexpected_case_id", F.col("case_id")))
        seen = used.where((F.col("zone_type") == zone) & F.col("case_id").isin(*ids)).select("area_slug", "case_id").distinct()
        wanted = known.withColumn("case_id", F.explode(F.array(*[F.lit(i) for i in ids])))
        out = out.unionByName(issue(wanted.join(seen, ["area_slug", "case_id"], "left_anti"), "missing_case_id", F.col("case_id")))
    dup = used.groupBy("area_slug", "source_component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(issue(dup, "duplicate_component", F.col("source_component_id")))
    blank = F.exists(F.array(*[F.col(c) == "" for c in CASE_TEXT]), lambda v: v)
    out = out.unionByName(issue(used.where(blank), "missing_text", F.col("case_id")))
    lost = used.join(candidates.select("area_slug", "source_component_id").distinct(), ["area_slug", "source_component_id"], "left_anti")
    return out.unionByName(issue(lost, "unknown_component", F.col("source_component_id")))


# Columns and languages of a question bank.
QUESTION_COLUMNS = (
    "question_id",
    "category",
    "city",
    "mode",
    "language",
    "question",
    "expected_risk_level",
    "expected_evidence_type",
    "must_mention",
    "forbidden_claim_trigger",
    "notes",
)
QUESTION_LANGUAGES = ("en", "ru")


def validate_questions(q: DataFrame) -> DataFrame:
    """Q15. Issue rows of a question bank: missing columns, blank or duplicate ids, blank text, language."""
    lost = missing_columns(q.columns, QUESTION_COLUMNS)
    spark = q.sparkSession
    if lost:
        return spark.createDataFrame([("missing_columns", ", ".join(lost), 0)], "issue string, details string, affected_rows long")
    qid = F.trim(F.coalesce("question_id", F.lit("")))
    dup = q.where(qid != "").groupBy(qid.alias("details")).agg(F.count(F.lit(1)).alias("affected_rows")).where("affected_rows > 1")
    rows = q.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(qid == "", F.struct(F.lit("blank_question_id").alias("issue"), F.lit("").alias("details"))),
                    F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.struct(F.lit("blank_question").alias("issue"), qid.alias("details"))),
                    F.when(
                        ~F.lower(F.trim(F.coalesce("language", F.lit("")))).isin(*QUESTION_LANGUAGES),
                        F.struct(F.lit("invalid_language").alias("issue"), qid.alias("details")),
                    ),
                )
            )
        )
    ).withColumn("affected_rows", F.lit(1).cast("long"))
    return rows.unionByName(dup.select(F.lit("duplicate_question_id").alias("issue"), "details", "affected_rows"))


def question_counts(q: DataFrame) -> DataFrame:
    """Q15 counts by category and by language, one grouping-sets aggregate."""
    by = q.select(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("language", F.lit("")).alias("language"))
    sets = by.groupingSets([[F.col("category")], [F.col("language")]], F.col("category"), F.col("language"))
    counted = sets.agg(F.grouping("category").alias("_g"), F.count(F.lit(1)).alias("questions"))
    return counted.select(
        F.when(F.col("_g") == 0, "category").otherwise("language").alias("kind"),
        F.coalesce("category", "language").alias("value"),
        "questions",
    )
