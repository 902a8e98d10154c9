"""Correlation, benchmark, district and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import stats as B
from gridspark.scope import AREA, Scope, materialize
from suite import views as V
from suite.registry import pick, query, r, rnd, rs


def avg_rank(x: str, by: str) -> str:
    """Average rank in SQL; ``by`` is the partition list or empty."""
    part = f"partition by {by}" if by else ""
    ties = f"partition by {by}, {x}" if by else f"partition by {x}"
    return f"(rank() over ({part} order by {x}) + (count(*) over ({ties}) - 1) / 2.0::double)"


_G = Scope(("source",), ("doc_id",))


@query(
    "b01_correlations_labels",
    "with t as (select source, d.doc_id, quality::double q, n_chars::double n from labels l join documents d using (doc_id)), "
    f"k as (select *, {avg_rank('q', 'source')} rq, {avg_rank('n', 'source')} rn from t) "
    f"select source, case when count(*) >= 2 and min(q) <> max(q) and min(n) <> max(n) then {r('corr(q, n)', 'x').replace(' as x', '')} end pearson, "
    f"case when count(*) >= 2 and min(q) <> max(q) and min(n) <> max(n) then {r('corr(rq, rn)', 'x').replace(' as x', '')} end spearman from k group by source",
)
def b01(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("n"))
    df = V.table(spark, sf, "labels").join(docs, "doc_id").withColumn("q", F.col("quality").cast("double"))
    out = B.correlations(df, {"pearson": ("q", "n", "pearson"), "spearman": ("q", "n", "spearman")}, Scope.measured(df, ("source",), ("doc_id",)))
    return pick(out, ["source"], ["pearson", "spearman"])


_B02 = {
    "c": "select area_id, cell_id, building_area s, greatest(balance, 0) b from cells",
    "k": f"select *, {avg_rank('s', 'area_id')} rs, {avg_rank('b', 'area_id')} rb, row_number() over (partition by area_id order by s desc, cell_id) ps, "
    "row_number() over (partition by area_id order by b desc, cell_id) pb, greatest(ceil(count(*) over (partition by area_id) * 0.1), 1) k from c",
}


@query(
    "b02_surface_metrics",
    V.with_views("cells", extra=_B02)
    + f"select area_id, count(*) cell_count, {r('sum(s)', 'surface_total')}, {r('sum(b)', 'benchmark_total')}, {r('abs(sum(b) - sum(s))', 'absolute_gap_total')}, "
    f"{r('sum(b) / nullif(sum(s), 0)', 'benchmark_ratio')}, {r('corr(s, b)', 'pearson_r')}, {r('corr(rs, rb)', 'spearman_r')}, "
    f"{r('count(*) filter (ps <= k and pb <= k)::double / count(*) filter (ps <= k)', 'top_decile_overlap')}, "
    f"{r('count(*) filter (ps <= k and pb <= k)::double / count(*) filter (ps <= k or pb <= k)', 'hotspot_iou')} from k group by area_id",
)
def b02(spark, sf):
    scope = V.scope_of(spark, sf)
    df = V.cells(spark, sf).withColumn("bench", F.greatest("balance", F.lit(0.0)))
    out = B.surface_metrics(df, "bench", "building_area", scope)
    return pick(out, ["area_id", "cell_count"], ["surface_total", "benchmark_total", "absolute_gap_total", "benchmark_ratio", "pearson_r", "spearman_r", "top_decile_overlap", "hotspot_iou"])


@query(
    "b03_top_set",
    V.with_views("cells", extra={"k": "select *, row_number() over (partition by area_id order by road_length desc, cell_id) p, count(*) over (partition by area_id) n from cells"})
    + "select area_id, cell_id, p <= greatest(ceil(n * 0.1), 1) in_top from k",
)
def b03(spark, sf):
    return B.top_set(V.cells(spark, sf), "road_length", 0.1, V.scope_of(spark, sf)).select("area_id", "cell_id", "in_top")


def _mean_by(product: str, s: str, b: str) -> str:
    return (
        f"select '{product}' benchmark_name, avg(p) pearson_r, avg(sp) spearman_r, avg(o) top_decile_overlap, avg(i) hotspot_iou from "
        f"(select corr(s, b) p, corr(rs, rb) sp, count(*) filter (ps <= k and pb <= k)::double / count(*) filter (ps <= k) o, "
        f"count(*) filter (ps <= k and pb <= k)::double / count(*) filter (ps <= k or pb <= k) i from (select *, {avg_rank('s', 'area_id')} rs, {avg_rank('b', 'area_id')} rb, "
        "row_number() over (partition by area_id order by s desc, cell_id) ps, row_number() over (partition by area_id order by b desc, cell_id) pb, "
        f"greatest(ceil(count(*) over (partition by area_id) * 0.1), 1) k from (select area_id, cell_id, {s} s, {b} b from cells)) group by area_id)"
    )


@query(
    "b04_external_batch",
    V.with_views("cells", extra={"m": _mean_by("road_length", "building_area", "road_length") + " union all " + _mean_by("park_area", "building_area", "park_area")})
    + f"select benchmark_name, {rs('pearson_r', 'spearman_r', 'top_decile_overlap', 'hotspot_iou')} from m",
)
def b04(spark, sf):
    scope = V.scope_of(spark, sf)
    _, means = B.external_batch(V.cells(spark, sf), ["road_length", "park_area"], "building_area", scope)
    return pick(means, ["benchmark_name"], ["pearson_r", "spearman_r", "top_decile_overlap", "hotspot_iou"])


_REGION = ("region_id",)
_D = (
    "select n_regionkey::bigint region_id, n_name district_name, n_nationkey % 5 <> 4 use_in_metrics, "
    "sum(official_total) official_population, coalesce(sum(building_area), 0) predicted_population from totals join nation on n_nationkey = area_id "
    "left join (select area_id, sum(building_area) * 100 building_area from cells group by 1) using (area_id) group by 1, 2, 3"
)
_DS = "select *, official_population / sum(official_population) over (partition by region_id) os, predicted_population / sum(predicted_population) over (partition by region_id) ps from d"


def _districts(spark, sf):
    """Nations as districts of their region; shares over all districts of the region."""
    n = V.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("area_id"),
        F.col("n_regionkey").cast("long").alias("region_id"),
        F.col("n_name").alias("district_name"),
        (F.col("n_nationkey") % 5 != 4).alias("use_in_metrics"),
    )
    pred = V.cells(spark, sf).groupBy("area_id").agg((F.sum("building_area") * 100).alias("predicted_population"))
    t = V.totals(spark, sf).select("area_id", F.col("official_total").alias("official_population"))
    d = n.join(t, "area_id").join(pred, "area_id", "left").na.fill(0.0, ["predicted_population"])
    from gridspark.operators.spatial import district_shares

    return district_shares(d, Scope.measured(n, _REGION, ("district_name",))), Scope.measured(n, _REGION, ("district_name",))


@query(
    "b05_district_metrics",
    V.with_views(
        "totals",
        "cells",
        extra={
            "d": _D,
            "s": _DS,
            "k": f"select *, {avg_rank('official_population', 'region_id')} ro, {avg_rank('predicted_population', 'region_id')} rp from s where use_in_metrics",
        },
    )
    + f"select region_id, count(*) district_count_compared, {r('avg(abs(predicted_population - official_population))', 'mae')}, "
    f"{r('sqrt(avg((predicted_population - official_population) ** 2))', 'rmse')}, {r('avg(abs(predicted_population - official_population) / official_population) * 100', 'mape')}, "
    f"{r('avg(abs(ps - os))', 'share_mae')}, {r('sqrt(avg((ps - os) ** 2))', 'share_rmse')}, {r('corr(official_population, predicted_population)', 'pearson_r')}, "
    f"{r('corr(ro, rp)', 'spearman_r')}, {r('abs(sum(predicted_population) - sum(official_population))', 'absolute_gap_total')} from k group by region_id",
)
def b05(spark, sf):
    d, scope = _districts(spark, sf)
    out = B.district_metrics(d, scope)
    return pick(out, ["region_id", "district_count_compared"], ["mae", "rmse", "mape", "share_mae", "share_rmse", "pearson_r", "spearman_r", "absolute_gap_total"])


_D7 = {
    "d": "select n_regionkey::bigint region_id, n_name district_name, n_nationkey % 5 <> 4 use_in_metrics, max(official_total) * (0.9 + (n_nationkey % 4) * 0.06::double) official_population, "
    "sum(p10) p10, sum(p50) p50, sum(p90) p90 from iv join nation on n_nationkey = area_id group by 1, 2, 3, n_nationkey",
    "u": f"select *, p90 - p10 w, (p90 - p10) / greatest(p50, 1e-6) rw, official_population between p10 and p90 cov, {avg_rank('official_population', 'region_id')} ro, {avg_rank('p50', 'region_id')} rp from d where use_in_metrics",
}


@query(
    "b07_district_interval_metrics",
    V.with_views("iv", extra=_D7)
    + f"select region_id, count(*) district_count_compared, {r('avg(cov::int)', 'coverage_rate')}, {r('median(w)', 'median_interval_width')}, {r('median(rw)', 'median_relative_interval_width')}, "
    f"{r('sqrt(avg((p50 - official_population) ** 2))', 'p50_rmse')}, {r('corr(official_population, p50)', 'p50_pearson_r')}, {r('corr(ro, rp)', 'p50_spearman_r')} from u group by region_id",
)
def b07(spark, sf):
    scope = V.scope_of(spark, sf)
    n = V.table(spark, sf, "nation")
    sums = V.interval(spark, sf, scope).groupBy("area_id").agg(
        F.max("official_total").alias("t"), *[F.sum(p).alias(f"predicted_{p}") for p in ("p10", "p50", "p90")]
    )
    d = sums.join(n, F.col("area_id") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("long").alias("region_id"),
        F.col("n_name").alias("district_name"),
        (F.col("n_nationkey") % 5 != 4).alias("use_in_metrics"),
        (F.col("t") * (0.9 + (F.col("n_nationkey") % 4) * 0.06)).alias("official_population"),
        "predicted_p10",
        "predicted_p50",
        "predicted_p90",
    )
    rscope = Scope.measured(n.select(F.col("n_regionkey").alias("region_id")), _REGION, ("district_name",))
    out = B.district_interval_metrics(B.interval_columns(d), rscope)
    return pick(out, ["region_id", "district_count_compared"], ["coverage_rate", "median_interval_width", "median_relative_interval_width", "p50_rmse", "p50_pearson_r", "p50_spearman_r"])


@query(
    "b08_partial_district",
    V.with_views("totals", "cells", extra={"d": _D, "u": "select *, abs(predicted_population - official_population) e from d where use_in_metrics and region_id <> 3"})
    + "select r_regionkey::bigint region_id, coalesce(any_value(n), 0) n_districts_compared, any_value(m1) mean_absolute_error_p50, any_value(m2) median_absolute_error_p50, any_value(m3) mean_relative_error_p50 "
    f"from region left join (select region_id, count(*) n, {r('avg(e)', 'm1')}, {r('median(e)', 'm2')}, {r('avg(e / greatest(official_population, 1e-6))', 'm3')} from u group by 1) on region_id = r_regionkey group by 1",
)
def b08(spark, sf):
    d, scope = _districts(spark, sf)
    regions = V.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("region_id"))
    out = B.partial_district_summary(regions, d.where("region_id <> 3"), scope)
    return pick(out, ["region_id", "n_districts_compared"], ["mean_absolute_error_p50", "median_absolute_error_p50", "mean_relative_error_p50"])


@query(
    "b08_partial_rows",
    V.with_views("totals", "cells", extra={"d": _D})
    + f"select region_id, district_name, {r('predicted_population', 'predicted_p50')}, {r('abs(predicted_population - official_population)', 'absolute_error_p50')}, "
    f"{r('abs(predicted_population - official_population) / official_population', 'relative_error_p50')} from d",
)
def b08r(spark, sf):
    d, _ = _districts(spark, sf)
    return pick(B.partial_district_rows(d, ("region_id",)), ["region_id", "district_name"], ["predicted_p50", "absolute_error_p50", "relative_error_p50"])


@query(
    "b09_interval_coverage",
    V.with_views("diag")
    + f"select area_id, count(*) n_cells, {r('avg((weak_target between p10 and p90)::int)', 'coverage_p10_p90')}, {r('avg((weak_target < p10)::int)', 'below_p10_share')}, "
    f"{r('avg((weak_target > p90)::int)', 'above_p90_share')}, {r('avg(uncertainty_width)', 'mean_interval_width')}, {r('median(uncertainty_width)', 'median_interval_width')}, "
    f"{r('median(relative_uncertainty)', 'median_relative_uncertainty')} from diag where weak_target is not null group by area_id",
)
def b09(spark, sf):
    scope = V.scope_of(spark, sf)
    out = B.interval_coverage(V.diagnostics(spark, sf, scope), "proxy", scope)
    return pick(out, ["area_id", "n_cells"], ["coverage_p10_p90", "below_p10_share", "above_p90_share", "mean_interval_width", "median_interval_width", "median_relative_uncertainty"])


_AL = {
    "v": "select * from diag where absolute_error_p50 is not null",
    "k": "select *, "
    + ", ".join(f"{avg_rank(c, 'area_id')} r{i}" for i, c in enumerate(("absolute_error_p50", "uncertainty_width", "relative_uncertainty", "confidence_score", "model_stability_score")))
    + " from v",
}


def _c(a, b, x, y, name):
    return f"case when min({x}) <> max({x}) and min({y}) <> max({y}) then round(corr({a}, {b}), 4) + 0.0 end {name}"


_ERR = ("uncertainty_width", "relative_uncertainty", "confidence_score", "model_stability_score")
_ERR_NAMES = ("uncertainty_width", "relative_uncertainty", "confidence_score", "model_stability")


@query(
    "b10_error_alignment",
    V.with_views("diag", extra=_AL)
    + "select area_id, count(*) n_cells, "
    + ", ".join(_c("absolute_error_p50", c, "absolute_error_p50", c, f"pearson_error_vs_{n}") for c, n in zip(_ERR, _ERR_NAMES))
    + ", "
    + ", ".join(_c("r0", f"r{i + 1}", "absolute_error_p50", c, f"spearman_error_vs_{n}") for i, (c, n) in enumerate(zip(_ERR, _ERR_NAMES)))
    + ", "
    + ", ".join(f"round(avg(absolute_error_p50) filter (confidence_band = '{b}'), 4) + 0.0 mean_error_{b}_confidence" for b in ("high", "medium", "low"))
    + " from k group by area_id",
)
def b10(spark, sf):
    scope = V.scope_of(spark, sf)
    out = B.error_alignment(V.diagnostics(spark, sf, scope), "proxy", scope)
    return pick(
        out,
        ["area_id", "n_cells"],
        [f"{m}_error_vs_{n}" for n in _ERR_NAMES for m in ("pearson", "spearman")] + [f"mean_error_{b}_confidence" for b in ("high", "medium", "low")],
    )


_MONO = {
    "v": "select area_id, cell_id, relative_uncertainty u, absolute_error_p50 e from diag where absolute_error_p50 is not null",
    "q": "select least(5, greatest(2, count(distinct u))) q, count(*) n from v",
    "b": "select greatest(ceil((row_number() over (order by u, area_id, cell_id) - 1) * q / (n - 1)::double) - 1, 0)::bigint bucket, u, e from v, q",
}


@query(
    "b11_monotonicity",
    V.with_views("diag", extra=_MONO) + f"select bucket uncertainty_bucket, count(*) row_count, {r('avg(u)', 'mean_uncertainty')}, {r('avg(e)', 'mean_abs_error')} from b group by bucket",
)
def b11(spark, sf):
    scope = V.scope_of(spark, sf)
    diag = V.diagnostics(spark, sf, scope)
    out = B.monotonicity_buckets(_rounded_for_order(diag), scope=B.GLOBAL)
    return pick(out, ["uncertainty_bucket", "row_count"], ["mean_uncertainty", "mean_abs_error"])


def _rounded_for_order(df):
    return df


@query(
    "b11_monotonicity_metrics",
    V.with_views(
        "diag",
        extra=_MONO
        | {
            "m": "select bucket, avg(e) e from b group by bucket",
            "k": f"select *, {avg_rank('u', '')} ru, {avg_rank('e', '')} re from v",
        },
    )
    + f"select (select {r('arg_min(e, bucket)', 'x')} from m) mean_abs_error_lowest_bucket, (select {r('arg_max(e, bucket)', 'x')} from m) mean_abs_error_highest_bucket, "
    "(select min(ok)::double from (select coalesce(e >= lag(e) over (order by bucket), true)::int ok from m)) monotonic_non_decreasing, "
    f"{r('corr(u, e)', 'error_uncertainty_pearson')}, {r('corr(ru, re)', 'error_uncertainty_spearman')} from k",
)
def b11m(spark, sf):
    scope = V.scope_of(spark, sf)
    diag = materialize(V.diagnostics(spark, sf, scope).select("area_id", "cell_id", "relative_uncertainty", "absolute_error_p50"))
    out = B.monotonicity_metrics(diag, B.monotonicity_buckets(diag))
    return pick(out, [], ["mean_abs_error_lowest_bucket", "mean_abs_error_highest_bucket", "monotonic_non_decreasing", "error_uncertainty_pearson", "error_uncertainty_spearman"])


@query(
    "b12_band_validation",
    V.with_views("diag")
    + f"select area_id, confidence_band, count(*) n_cells, {r('count(*)::double / any_value(n)', 'share_cells')}, {r('avg(p50)', 'mean_p50')}, {r('median(p50)', 'median_p50')}, "
    f"{r('avg(uncertainty_width)', 'mean_uncertainty_width')}, {r('median(relative_uncertainty)', 'median_relative_uncertainty')}, {r('avg(absolute_error_p50)', 'mean_error_if_available')}, "
    f"{r('''avg((hotspot_priority_class <> 'not_priority')::int)''', 'share_hotspot_priority_cells')} from (select *, count(*) over (partition by area_id) n from diag) group by 1, 2",
)
def b12(spark, sf):
    scope = V.scope_of(spark, sf)
    out = B.band_validation(V.diagnostics(spark, sf, scope), scope)
    return pick(out, ["area_id", "confidence_band", "n_cells"], ["share_cells", "mean_p50", "median_p50", "mean_uncertainty_width", "median_relative_uncertainty", "mean_error_if_available", "share_hotspot_priority_cells"])


_DIS = {
    "j": "select iv.area_id, iv.cell_id, relative_uncertainty u, p50, road_length, greatest(balance, 0) * 10 bench from iv join cells using (area_id, cell_id)",
    "l": "select area_id, cell_id, u, 'road_length' b, abs(p50 - road_length) d from j union all select area_id, cell_id, u, 'bench', abs(p50 - bench) from j",
    "k": f"select *, {avg_rank('u', 'area_id, b')} ru, {avg_rank('d', 'area_id, b')} rd, quantile_cont(u, 0.9) over (partition by area_id, b) uh, quantile_cont(u, 0.1) over (partition by area_id, b) ul, "
    "quantile_cont(d, 0.9) over (partition by area_id, b) dh, quantile_cont(d, 0.1) over (partition by area_id, b) dl from l",
}


def _bench(spark, sf):
    c = V.cells(spark, sf)
    return c.select("area_id", "cell_id", "road_length", (F.greatest("balance", F.lit(0.0)) * 10).alias("bench"))


@query(
    "b13_disagreement",
    V.with_views("iv", "cells", extra=_DIS)
    + f"select area_id, b benchmark_name, count(*) row_count, {r('corr(u, d)', 'disagreement_uncertainty_pearson')}, {r('corr(ru, rd)', 'disagreement_uncertainty_spearman')}, "
    f"{r('avg(d) filter (u >= uh)', 'high_uncertainty_mean_disagreement')}, {r('avg(d) filter (u <= ul)', 'low_uncertainty_mean_disagreement')} from k group by 1, 2",
)
def b13(spark, sf):
    scope = V.scope_of(spark, sf)
    joined = V.interval(spark, sf, scope).join(_bench(spark, sf), ["area_id", "cell_id"])
    out = B.disagreement(joined, ["road_length", "bench"], "p50", scope)
    return pick(out, ["area_id", "benchmark_name", "row_count"], ["disagreement_uncertainty_pearson", "disagreement_uncertainty_spearman", "high_uncertainty_mean_disagreement", "low_uncertainty_mean_disagreement"])


@query(
    "b14_disagreement_report",
    V.with_views("iv", "cells", extra=_DIS)
    + f"select area_id, b benchmark_product, count(*) n_cells, 'absolute_difference_to_' || b disagreement_metric, {r('corr(u, d)', 'pearson_disagreement_vs_uncertainty')}, "
    f"{r('corr(ru, rd)', 'spearman_disagreement_vs_uncertainty')}, {r('avg(u) filter (d >= dh)', 'mean_uncertainty_high_disagreement')}, {r('avg(u) filter (d <= dl)', 'mean_uncertainty_low_disagreement')} from k group by 1, 2",
)
def b14(spark, sf):
    scope = V.scope_of(spark, sf)
    out = B.disagreement_report(V.interval(spark, sf, scope), _bench(spark, sf), ["road_length", "bench"], scope)
    return pick(
        out,
        ["area_id", "benchmark_product", "n_cells", "disagreement_metric"],
        ["pearson_disagreement_vs_uncertainty", "spearman_disagreement_vs_uncertainty", "mean_uncertainty_high_disagreement", "mean_uncertainty_low_disagreement"],
    )


@query("b15_proxy_check", V.with_views("diag") + f"select area_id, cell_id, {rs('weak_target', 'absolute_error_p50')}, covered_by_interval from diag")
def b15(spark, sf):
    df = V.diagnostics(spark, sf, V.scope_of(spark, sf))
    return pick(df, ["area_id", "cell_id", "covered_by_interval"], ["weak_target", "absolute_error_p50"])


@query(
    "b16_concentration",
    V.with_views("cells", extra={"k": "select *, row_number() over (partition by area_id order by building_area desc, cell_id) p, count(*) over (partition by area_id) n from cells"})
    + f"select area_id, {r('case when sum(building_area) > 0 then coalesce(sum(building_area) filter (p <= greatest(ceil(n * 0.1), 1)), 0) / sum(building_area) else 0 end', 'top_share')} from k group by area_id",
)
def b16(spark, sf):
    return pick(B.concentration(V.cells(spark, sf), "building_area", V.scope_of(spark, sf)), ["area_id"], ["top_share"])


@query(
    "b17_validation_package",
    V.with_views("diag")
    + "select 'interval_coverage' part, count(distinct area_id) n from diag union all select 'error_alignment', count(distinct area_id) from diag "
    "union all select 'band_validation', count(*) from (select distinct area_id, confidence_band from diag) union all select 'monotonicity', 5 "
    "union all select 'hotspot_stability', count(*) from (select distinct area_id, hotspot_priority_class from diag where hotspot_priority_class <> 'not_priority') union all select 'blockers', 1",
)
def b17(spark, sf):
    scope = V.scope_of(spark, sf)
    diag = V.diagnostics(spark, sf, scope)
    out = None
    for name, df in B.validation_package(None, diag, "run", scope).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out
