"""Hotspot table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import hotspots as H
from suite import views as V
from suite.registry import pick, query, r, rnd, rs

_CLS = "hotspot_priority_class"


@query(
    "h02_hotspots",
    V.with_views("iv", extra={"t": "select *, quantile_cont(p50, 0.8) over (partition by area_id) th from iv"})
    + f"select area_id, cell_id, hotspot_rank, {rs('p50')}, {r('th', 'hotspot_threshold')} from t where p50 >= th",
)
def h02(spark, sf):
    scope = V.scope_of(spark, sf)
    df = H.hotspots(V.interval(spark, sf, scope), 0.8, scope)
    return pick(df, ["area_id", "cell_id", "hotspot_rank"], ["p50", "hotspot_threshold"])


_H02 = """select *, case when p50 < mid and confidence_band = 'low' then 'lv' when p50 >= upp and p50 < hot and confidence_band = 'high' then 'mv'
 when p50 >= hot and confidence_band = 'low' then 'hl' when p50 >= hot and confidence_band = 'high' then 'hh' else 'no' end cls from
 (select *, quantile_cont(p50, 0.8) over (partition by area_id) hot, quantile_cont(p50, 0.75) over (partition by area_id) upp, median(p50) over (partition by area_id) mid from iv)"""


@query(
    "h02_hotspot_digest",
    V.with_views("iv", extra={"t": _H02})
    + f"select area_id, {r('max(hot)', 'hotspot_threshold')}, count(*) filter (p50 >= hot) hotspot_cell_count, count(*) filter (cls = 'hh') high_priority_count, "
    f"count(*) filter (cls = 'hl') review_required_count, count(*) filter (cls = 'mv') medium_value_high_confidence_count, count(*) filter (cls = 'lv') low_value_high_uncertainty_count, "
    f"{r('''coalesce(sum(p50) filter (cls = 'hh'), 0)''', 'high_priority_value_sum')}, {r('''coalesce(sum(p50) filter (cls = 'hl'), 0)''', 'review_required_value_sum')} from t group by area_id",
)
def h02d(spark, sf):
    scope = V.scope_of(spark, sf)
    df = H.hotspot_digest(V.interval(spark, sf, scope), 0.8, scope)
    return pick(
        df,
        ["area_id", "hotspot_cell_count", "high_priority_count", "review_required_count", "medium_value_high_confidence_count", "low_value_high_uncertainty_count"],
        ["hotspot_threshold", "high_priority_value_sum", "review_required_value_sum"],
    )


_P = f"{_CLS} <> 'not_priority'"


@query(
    "h03_hotspot_summary",
    V.with_views("iv")
    + "select area_id, area_slug, count(*) n_cells, "
    f"count(*) filter ({_P}) n_priority_cells, count(*) filter ({_CLS} = 'high_value_high_confidence') n_high_value_high_confidence, "
    f"{r(f'quantile_cont(p50, 0.9)', 'hotspot_threshold_p90')}, {r(f'count(*) filter ({_P})::double / count(*)', 'share_priority_cells')}, "
    f"{r(f'coalesce(avg(p50) filter ({_P}), 0)', 'mean_p50_priority_cells')}, {r(f'coalesce(median(p50) filter ({_P}), 0)', 'median_p50_priority_cells')}, "
    f"{r(f'coalesce(avg(confidence_score) filter ({_P}), 0)', 'mean_confidence_priority_cells')}, "
    f"{r(f'coalesce(median(relative_uncertainty) filter ({_P}), 0)', 'median_relative_uncertainty_priority_cells')}, "
    f"case when count(*) filter ({_CLS} = 'high_value_high_confidence') > 0 and count(*) filter ({_CLS} = 'high_value_high_confidence') >= count(*) filter ({_CLS} = 'high_value_low_confidence') then 'strong' "
    f"when count(*) filter ({_CLS} = 'high_value_low_confidence') > 0 then 'verify' when count(*) filter ({_CLS} = 'low_value_high_uncertainty') > 0 then 'caution' else 'limited' end note_kind "
    "from iv group by 1, 2",
)
def h03(spark, sf):
    scope = V.scope_of(spark, sf)
    note = F.col("interpretation_note")
    kind = (
        F.when(note.contains("stronger high-confidence"), "strong")
        .when(note.contains("local verification is needed"), "verify")
        .when(note.contains("caution-heavy"), "caution")
        .otherwise("limited")
    )
    df = H.hotspot_summary(V.interval(spark, sf, scope), scope).withColumn("note_kind", kind)
    return pick(
        df,
        ["area_id", "area_slug", "n_cells", "n_priority_cells", "n_high_value_high_confidence", "note_kind"],
        ["hotspot_threshold_p90", "share_priority_cells", "mean_p50_priority_cells", "median_p50_priority_cells", "mean_confidence_priority_cells", "median_relative_uncertainty_priority_cells"],
    )


@query(
    "h04_top_hotspots",
    V.with_views("iv", extra={"t": f"select *, row_number() over (partition by area_id order by hotspot_rank, cell_id) position from iv where {_P}"})
    + f"select area_id, cell_id, position, hotspot_rank, {_CLS}, {rs('p50')}, case {_CLS} when 'high_value_high_confidence' then 'Strong planning-screening candidate.' "
    "when 'high_value_low_confidence' then 'Potentially important but requires local verification.' when 'medium_value_high_confidence' then 'Stable secondary candidate.' "
    "else 'Caution zone; avoid strong conclusions without additional evidence.' end planning_interpretation from t where position <= 5",
)
def h04(spark, sf):
    scope = V.scope_of(spark, sf)
    df = H.top_hotspots(V.interval(spark, sf, scope), 5, scope)
    return pick(df, ["area_id", "cell_id", "position", "hotspot_rank", _CLS, "planning_interpretation"], ["p50"])


@query(
    "h05_caution",
    V.with_views("iv")
    + f"select area_id, cell_id, hotspot_rank, {_CLS}, concat_ws('; ', case when {_CLS} = 'high_value_low_confidence' then 'high estimated value but low confidence' end, "
    f"case when {_CLS} = 'low_value_high_uncertainty' then 'low-value cell with high uncertainty' end, case when confidence_band = 'low' then 'low confidence score' end, "
    "case when relative_uncertainty >= 0.5 then 'wide prediction interval' end, case when completeness_label in ('moderate', 'weak') then 'moderate or weak map support' end) caution_reason, "
    f"case {_CLS} when 'high_value_low_confidence' then 'local verification recommended before strong planning interpretation' else 'use only for preliminary screening and avoid definitive prioritization' end recommended_action "
    f"from iv where {_CLS} in ('high_value_low_confidence', 'low_value_high_uncertainty')",
)
def h05(spark, sf):
    return H.caution(V.interval(spark, sf, V.scope_of(spark, sf))).select(
        "area_id", "cell_id", "hotspot_rank", _CLS, "caution_reason", "recommended_action"
    )


@query(
    "h06_stable",
    V.with_views("iv")
    + f"select area_id, cell_id, hotspot_rank, {_CLS}, concat_ws('; ', case when confidence_band = 'high' then 'high confidence score' end, "
    "case when relative_uncertainty <= 0.25 then 'narrower uncertainty interval' end, case when completeness_label = 'good' then 'strong map completeness context' end, "
    f"case when {_CLS} = 'high_value_high_confidence' then 'high p50 with acceptable uncertainty' end) stability_reason "
    f"from iv where {_CLS} in ('high_value_high_confidence', 'medium_value_high_confidence')",
)
def h06(spark, sf):
    return H.stable(V.interval(spark, sf, V.scope_of(spark, sf))).select("area_id", "cell_id", "hotspot_rank", _CLS, "stability_reason")


@query(
    "h07_hotspot_package",
    V.with_views("iv", extra={"t": f"select *, row_number() over (partition by area_id order by hotspot_rank, cell_id) position from iv where {_P}"})
    + "select 'summary' part, count(distinct area_id) n from iv union all select 'top', count(*) from t where position <= 25 "
    f"union all select 'caution', count(*) from iv where {_CLS} in ('high_value_low_confidence', 'low_value_high_uncertainty') "
    f"union all select 'stable', count(*) from iv where {_CLS} in ('high_value_high_confidence', 'medium_value_high_confidence') union all select 'rejected_areas', 0",
)
def h07(spark, sf):
    from gridspark.plans.packages import hotspot_package

    scope = V.scope_of(spark, sf)
    parts = hotspot_package(V.interval(spark, sf, scope), scope=scope)
    out = None
    for name in ("summary", "top", "caution", "stable", "rejected_areas"):
        row = parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_DETAIL = (
    "select *, least(greatest(0.6 * confidence_score + 0.25 * (1 - least(relative_uncertainty / greatest(r90, 1e-6), 1)) + 0.15 * (1 - least(uncertainty_width / greatest(w90, 1e-6), 1)) "
    f"+ case {_CLS} when 'high_value_high_confidence' then 0.05 when 'medium_value_high_confidence' then 0.03 when 'high_value_low_confidence' then -0.08 else -0.12 end, 0), 1) stability_metric "
    "from (select *, quantile_cont(relative_uncertainty, 0.9) over (partition by area_id) r90, quantile_cont(uncertainty_width, 0.9) over (partition by area_id) w90 "
    f"from iv where {_P})"
)


@query(
    "h08_stability_detail",
    V.with_views("iv", extra={"d": _DETAIL})
    + f"select area_id, cell_id, {_CLS}, {rs('stability_metric')}, case when stability_metric >= 0.67 then 'high' when stability_metric < 0.4 then 'low' else 'medium' end stability_band from d",
)
def h08(spark, sf):
    scope = V.scope_of(spark, sf)
    df = H.stability_detail(V.interval(spark, sf, scope), scope)
    return pick(df, ["area_id", "cell_id", _CLS, "stability_band"], ["stability_metric"])


@query(
    "h08_stability_summary",
    V.with_views("iv", extra={"d": _DETAIL})
    + f"select area_id, {_CLS}, count(*) n_cells, {r('avg(stability_metric)', 'mean_stability_metric')}, {r('median(stability_metric)', 'median_stability_metric')}, "
    f"{r('avg(confidence_score)', 'mean_confidence_score')}, {r('median(relative_uncertainty)', 'median_relative_uncertainty')} from d group by 1, 2",
)
def h08s(spark, sf):
    scope = V.scope_of(spark, sf)
    df = H.stability_summary(H.stability_detail(V.interval(spark, sf, scope), scope), scope)
    return pick(df, ["area_id", _CLS, "n_cells"], ["mean_stability_metric", "median_stability_metric", "mean_confidence_score", "median_relative_uncertainty"])


@query(
    "h09_class_matrix",
    V.with_views("iv")
    + "select area_id, "
    + ", ".join(f"count(*) filter ({_CLS} = '{c}') {c}" for c in H.HOTSPOT_CLASSES)
    + " from iv group by area_id",
)
def h09(spark, sf):
    scope = V.scope_of(spark, sf)
    return H.class_matrix(V.interval(spark, sf, scope), scope=scope)


@query(
    "h09_band_matrix",
    V.with_views("iv") + "select area_id, " + ", ".join(f"count(*) filter (confidence_band = '{c}') {c}" for c in ("high", "medium", "low")) + " from iv group by area_id",
)
def h09b(spark, sf):
    scope = V.scope_of(spark, sf)
    return H.class_matrix(V.interval(spark, sf, scope), "confidence_band", scope)


@query(
    "h10_zone_mask",
    V.with_views("cells", extra={"t": "select *, quantile_cont(building_area, 0.9) over (partition by area_id) h, quantile_cont(building_area, 0.1) over (partition by area_id) c from cells"})
    + f"select area_id, cell_id, 'hotspot' zone_type, building_area >= h in_zone, {r('h', 'selection_threshold')} from t union all "
    f"select area_id, cell_id, 'coldspot', building_area <= c, {r('c', 'selection_threshold')} from t",
)
def h10(spark, sf):
    scope = V.scope_of(spark, sf)
    base = V.cells(spark, sf)
    both = H.zone_mask(base, "hotspot", "building_area", scope).unionByName(H.zone_mask(base, "coldspot", "building_area", scope))
    return both.select("area_id", "cell_id", "zone_type", "in_zone", rnd("selection_threshold").alias("selection_threshold"))
