"""Scaling, calibration, uncertainty and hotspot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.contracts import COMBINED_COLUMNS
from gridspark.operators import hotspots as H
from gridspark.operators import scaling as S
from gridspark.operators import uncertainty as U
from suite import views as V
from suite.registry import pick, query, r, rnd, rs

_W = "window w as (partition by area_id)"


@query(
    "f01_minmax",
    V.with_views("cells")
    + f"select area_id, cell_id, {r(V._minmax('building_area'), 'building_area_scaled')}, {r(V._minmax('road_length'), 'road_length_scaled')}, "
    f"{r(V._minmax('poi_access_index'), 'poi_access_index_scaled')} from cells {_W}",
)
def f01(spark, sf):
    df = S.minmax(V.cells(spark, sf), ["building_area", "road_length", "poi_access_index"], V.scope_of(spark, sf))
    return pick(df, ["area_id", "cell_id"], ["building_area_scaled", "road_length_scaled", "poi_access_index_scaled"])


@query(
    "f02_combined_index",
    V.with_views("cells") + f"select area_id, cell_id, {r(' + '.join(V._minmax(c) for c in COMBINED_COLUMNS), 'combined_index')} from cells {_W}",
)
def f02(spark, sf):
    return pick(S.combined_index(V.cells(spark, sf), scope=V.scope_of(spark, sf)), ["area_id", "cell_id"], ["combined_index"])


@query("f03_proxy_score", V.with_views("scored") + f"select area_id, cell_id, {rs('proxy_score')} from scored")
def f03(spark, sf):
    scope = V.scope_of(spark, sf)
    return pick(S.proxy_score(V.cells_with_total(spark, sf, scope), scope=scope), ["area_id", "cell_id"], ["proxy_score"])


@query("f04_weak_target", V.with_views("weak") + f"select area_id, cell_id, {r('weak_share', places=8)}, {rs('weak_target')} from weak")
def f04(spark, sf):
    scope = V.scope_of(spark, sf)
    df = S.allocate(V.cells_with_total(spark, sf, scope), scope=scope)
    return df.select("area_id", "cell_id", rnd("weak_share", 8).alias("weak_share"), rnd("weak_target").alias("weak_target"))


@query(
    "f05_calibrate",
    V.with_views("cells_t")
    + f"select area_id, cell_id, {r('case when s <= 0 then official_total / n else greatest(balance, 0) / s * official_total end', 'calibrated')} "
    "from (select *, sum(greatest(balance, 0)) over (partition by area_id) s, count(*) over (partition by area_id) n from cells_t)",
)
def f05(spark, sf):
    scope = V.scope_of(spark, sf)
    return pick(S.calibrate(V.cells_with_total(spark, sf, scope), "balance", "official_total", scope), ["area_id", "cell_id"], ["calibrated"])


@query(
    "f06_calibration_factor",
    V.with_views("cells_t")
    + f"select area_id, cell_id, {r('case when s > 0 then official_total / s else 0 end', 'calibration_factor')} "
    "from (select *, sum(building_area) over (partition by area_id) s from cells_t)",
)
def f06(spark, sf):
    scope = V.scope_of(spark, sf)
    return pick(S.calibration_factor(V.cells_with_total(spark, sf, scope), "building_area", "official_total", scope), ["area_id", "cell_id"], ["calibration_factor"])


@query(
    "u05_calibrate_members",
    V.with_views("cal") + f"select area_id, member_id, count(*) n, {r('sum(pc)', 'total')}, {r('max(pc)', 'largest')} from cal group by 1, 2",
)
def u05(spark, sf):
    from gridspark.scope import attach

    scope = V.scope_of(spark, sf)
    df = U.calibrate_members(attach(V.members(spark, sf), V.totals(spark, sf), scope, "inner"), scope=scope, n_members=V.MEMBERS)
    return df.groupBy("area_id", "member_id").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("pred_calibrated")).alias("total"), rnd(F.max("pred_calibrated")).alias("largest")
    )


@query(
    "u06_member_quantiles",
    V.with_views("summ")
    + f"select area_id, cell_id, member_count, {r('q10', 'p10')}, {r('q50', 'p50')}, {r('q90', 'p90')}, {r('q90 - q10', 'uncertainty_width')}, "
    f"{r('(q90 - q10) / greatest(q50, 1e-6)', 'relative_uncertainty')} from summ",
)
def u06(spark, sf):
    from gridspark.scope import attach

    scope = V.scope_of(spark, sf)
    cal = U.calibrate_members(attach(V.members(spark, sf), V.totals(spark, sf), scope, "inner"), scope=scope, n_members=V.MEMBERS)
    df = U.summarize_members(cal, scope=scope)
    return pick(df, ["area_id", "cell_id", "member_count"], ["p10", "p50", "p90", "uncertainty_width", "relative_uncertainty"])


@query("u07_align_total", V.with_views("aligned") + f"select area_id, cell_id, {rs('p10', 'p50', 'p90', 'uncertainty_width', 'relative_uncertainty')} from aligned")
def u07(spark, sf):
    from gridspark.scope import attach

    scope = V.scope_of(spark, sf)
    cal = U.calibrate_members(attach(V.members(spark, sf), V.totals(spark, sf), scope, "inner"), scope=scope, n_members=V.MEMBERS)
    aligned = U.align_to_total(attach(U.summarize_members(cal, scope=scope), V.totals(spark, sf), scope), scope=scope)
    return pick(aligned, ["area_id", "cell_id"], ["p10", "p50", "p90", "uncertainty_width", "relative_uncertainty"])


@query(
    "u08_u10_confidence",
    V.with_views("iv") + f"select area_id, cell_id, {rs('model_stability_score', 'confidence_score')}, confidence_band from iv",
)
def u08(spark, sf):
    df = V.interval(spark, sf, V.scope_of(spark, sf))
    return df.select("area_id", "cell_id", rnd("model_stability_score").alias("model_stability_score"), rnd("confidence_score").alias("confidence_score"), "confidence_band")


_RANKBAND = (
    "select area_id, cell_id, rnk / n pct, completeness_label from (select area_id, cell_id, completeness_label, "
    "rank() over (partition by area_id order by relative_uncertainty) + (count(*) over (partition by area_id, relative_uncertainty) - 1) / 2.0 rnk, "
    "count(*) over (partition by area_id)::double n from iv0)"
)


@query(
    "u11_rank_bands",
    V.with_views(
        "cells",
        "context",
        extra={
            "iv0": "select cells.area_id, cell_id, completeness_label, balance relative_uncertainty from cells join context using (area_id)",
            "p": _RANKBAND,
            "b": "select *, case when pct <= 1.0 / 3 then 'high' when pct > 2.0 / 3 then 'low' else 'medium' end plain from p",
        },
    )
    + "select area_id, cell_id, case when completeness_label in ('moderate', 'weak') then case when plain = 'high' then 'medium' else 'low' end else plain end rank_band from b",
)
def u11(spark, sf):
    from gridspark.scope import attach

    scope = V.scope_of(spark, sf)
    df = attach(V.cells(spark, sf), V.context(spark, sf), scope, "inner").withColumn("relative_uncertainty", F.col("balance"))
    return U.band_by_rank(df, scope=scope).select("area_id", "cell_id", "rank_band")


_U13 = (
    "select area_id, max(area_slug) area_slug, count(*) n_cells, {a} from iv group by area_id"
)


@query(
    "u13_interval_summary",
    V.with_views("iv")
    + _U13.format(
        a=", ".join(
            [
                r("sum(p50)", "sum_p50"),
                r("avg(uncertainty_width)", "mean_uncertainty_width"),
                r("median(relative_uncertainty)", "median_relative_uncertainty"),
                r("avg(confidence_score)", "mean_confidence_score"),
                r("avg((confidence_band = 'high')::int)", "share_high_confidence"),
                r("avg((confidence_band = 'medium')::int)", "share_medium_confidence"),
                r("avg((confidence_band = 'low')::int)", "share_low_confidence"),
                r("quantile_cont(p50, 0.9)", "hotspot_threshold_p90"),
                "count(*) filter (hotspot_priority_class = 'high_value_high_confidence') n_high_confidence_hotspots",
                "count(*) filter (hotspot_priority_class = 'low_value_high_uncertainty') n_low_value_high_uncertainty",
            ]
        )
    ),
)
def u13(spark, sf):
    scope = V.scope_of(spark, sf)
    df = U.interval_summary(V.interval(spark, sf, scope), scope)
    return pick(
        df,
        ["area_id", "area_slug", "n_cells", "n_high_confidence_hotspots", "n_low_value_high_uncertainty"],
        ["sum_p50", "mean_uncertainty_width", "median_relative_uncertainty", "mean_confidence_score", "share_high_confidence", "share_medium_confidence", "share_low_confidence", "hotspot_threshold_p90"],
    )


@query("h01_hotspot_class", V.with_views("iv") + f"select area_id, cell_id, hotspot_rank, hotspot_priority_class, {rs('p50')} from iv")
def h01(spark, sf):
    df = V.interval(spark, sf, V.scope_of(spark, sf))
    return pick(df, ["area_id", "cell_id", "hotspot_rank", "hotspot_priority_class"], ["p50"])
