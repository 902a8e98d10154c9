"""Training, ensemble, inference and study queries. Forests are few shallow trees; boosted trees are fitted whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import ensemble as E
from gridspark.operators import moments as M
from gridspark.operators import training as T
from gridspark.operators import uncertainty as U
from gridspark.operators.scaling import combined_index
from gridspark.plans import surface as S
from gridspark.scope import Scope, materialize
from suite import views as V
from suite.registry import pick, query, r, rnd, rs

SMALL = T.TrainingConfig(trees=4, max_depth=4, model="random_forest")
RIDGE = T.TrainingConfig(model="ridge")


def five(spark, sf):
    """Cells regrouped into the five regions, so that leave-one-out has five folds."""
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), F.col("n_regionkey").cast("long").alias("region"))
    c = V.cells(spark, sf).join(n, "area_id").drop("area_id").withColumnRenamed("region", "area_id")
    t = V.totals(spark, sf).join(n, "area_id").groupBy(F.col("region").alias("area_id")).agg(F.sum("official_total").alias("official_total"))
    r_ = V.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("area_id"), F.col("r_name").alias("area_name"))
    # read by validation, labels, fits and predictions: the order lines are joined and summed once
    c = materialize(c)
    scope = Scope.measured(c.select("area_id"))
    return materialize(combined_index(c, scope=scope)), materialize(t.join(r_, "area_id")), scope


def labelled(spark, sf):
    c, t, scope = five(spark, sf)
    return materialize(T.training_set(c, t, scope=scope)[0]), scope


@query(
    "t01_training_set",
    V.with_views("cells", extra={"g": "select n_regionkey::bigint area_id, count(*) n from cells join nation on n_nationkey = area_id group by 1"})
    + "select area_id, n, 'kept' status from g where area_id < 3 union all select area_id, null, 'outside the requested training subset' from g where area_id = 4 union all select area_id, null, 'no official total found' from g where area_id = 3",
)
def t01(spark, sf):
    c, t, scope = five(spark, sf)
    allowed = spark.range(4).select(F.col("id").alias("area_id"))
    rows, skipped = T.training_set(c, t.where("area_id <> 3"), allowed, scope)
    kept = rows.groupBy("area_id").agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("kept"))
    return kept.unionByName(skipped.select("area_id", F.lit(None).cast("long").alias("n"), F.col("reason").alias("status")))


@query("t03_ridge_cross_validation")
def t03(spark, sf):
    rows, scope = labelled(spark, sf)
    return T.fold_report(T.cross_validate(rows, RIDGE, scope), RIDGE)


@query(
    "t03_ridge_with_nulls",
    V.with_views("cells")
    + """, x as (select n_regionkey::bigint area_id, c.area_id || '-' || cell_id cell, case when hash_free % 3 = 0 then null else building_area end x, road_length y
        from (select *, round(building_area)::bigint hash_free from cells) c join nation on n_nationkey = c.area_id),
    f as (select distinct area_id fold from x), part as (select fold, x, y from f join x on area_id <> fold),
    m as (select fold, median(x) med from part group by 1), filled as (select fold, coalesce(x, coalesce(med, 0)) x, y from part join m using (fold)),
    s as (select fold, count(*) n, avg(x) mx, avg(y) my, var_pop(x) vx, covar_pop(x, y) * count(*) sxy from filled group by 1)
    select fold, """
    + r("sxy / vx / (n + 1.0)", "slope", 6)
    + ", "
    + r("my - sxy / vx / (n + 1.0) * mx", "intercept", 4)
    + " from s",
)
def t03_nulls(spark, sf):
    """Slope and intercept of a one-feature ridge outside each region, nulls filled by the median outside it."""
    c = V.cells(spark, sf).join(V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_regionkey").cast("long").alias("fold")), "area_id")
    x = F.when(F.round("building_area").cast("long") % 3 != 0, F.col("building_area"))
    rows = c.select(F.lit("").alias("group"), "fold", F.lit(1).alias("weight"), x.alias("x"), F.col("road_length").alias("y"))
    models = M.training_moments(rows, ["x"]).ridge(["x"], 1.0)
    return models.select("fold", rnd(F.col("slopes")[0], 6).alias("slope"), rnd("intercept").alias("intercept"))


@query("t04_forest_cross_validation")
def t04(spark, sf):
    rows, scope = labelled(spark, sf)
    return T.fold_report(T.cross_validate(rows, SMALL, scope), SMALL)


@query("t05_boosted_fit")
def t05(spark, sf):
    rows, scope = labelled(spark, sf)
    config = T.TrainingConfig(model="boosted_trees")  # all trees at full depth
    scored = T.predict_raw(T.fit(rows, config), rows, config.features)
    return T.reg_metrics(scored, "weak_target", "pred", ["area_id"])


@query("t07_folds_loco", "select distinct n_regionkey::bigint area_id, dense_rank() over (order by n_regionkey) fold from nation")
def t07(spark, sf):
    c, _, scope = five(spark, sf)
    return T.folds_loco(c, scope).select("area_id", "fold").distinct()


@query("t08_folds_blocks")
def t08(spark, sf):
    c, t, scope = five(spark, sf)
    from gridspark.operators.spatial import spatial_blocks

    blocks = spatial_blocks(c.join(t, "area_id"), 2000.0, scope)
    return T.folds_blocks(blocks, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("block").alias("blocks"))


@query(
    "t10_reg_metrics",
    V.with_views("cells")
    + f"select area_id, count(*) \"rows\", {r('avg(abs(road_length - building_area))', 'mae')}, {r('sqrt(avg((road_length - building_area) ** 2))', 'rmse')}, "
    f"{r('1 - sum((road_length - building_area) ** 2) / nullif(var_pop(building_area) * count(*), 0)', 'r2')} from cells group by 1",
)
def t10(spark, sf):
    return pick(T.reg_metrics(V.cells(spark, sf), "building_area", "road_length", ["area_id"]), ["area_id", "rows"], ["mae", "rmse", "r2"])


# fold metrics derived from the order lines: one "fold" per return flag, status and line number
_FM = (
    "select case l_linenumber % 4 when 0 then 'full_features' when 1 then 'built_form_only' when 2 then 'transport_only' else 'poi_services_only' end ablation_name, l_returnflag model_name, l_linestatus validation_protocol, l_linenumber, "
    "avg(l_quantity) raw_mae, avg(l_quantity) + 3 raw_rmse, avg(l_discount) raw_r2, avg(l_quantity) - 1 calibrated_mae, avg(l_quantity) + 1 calibrated_rmse, avg(l_tax) calibrated_r2 from lineitem group by all"
)


def fold_rows(spark, sf):
    li = V.table(spark, sf, "lineitem")
    names = F.array(*[F.lit(s.name) for s in T.ABLATIONS])
    name = F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.groupBy(name.alias("ablation_name"), F.col("l_returnflag").alias("model_name"), F.col("l_linestatus").alias("validation_protocol"), "l_linenumber").agg(
        F.avg("l_quantity").alias("raw_mae"),
        (F.avg("l_quantity") + 3).alias("raw_rmse"),
        F.avg("l_discount").alias("raw_r2"),
        (F.avg("l_quantity") - 1).alias("calibrated_mae"),
        (F.avg("l_quantity") + 1).alias("calibrated_rmse"),
        F.avg("l_tax").alias("calibrated_r2"),
    )


@query(
    "t14_compare_runs",
    f"with f as ({_FM}) select model_name, validation_protocol, count(*) folds, {r('avg(raw_mae)', 'mean_raw_mae')}, {r('avg(calibrated_rmse)', 'mean_calibrated_rmse')}, {r('median(calibrated_rmse)', 'median_calibrated_rmse')}, {r('median(calibrated_r2)', 'median_calibrated_r2')} from f group by 1, 2",
)
def t14(spark, sf):
    return pick(T.compare_runs(fold_rows(spark, sf)), ["model_name", "validation_protocol", "folds"], ["mean_raw_mae", "mean_calibrated_rmse", "median_calibrated_rmse", "median_calibrated_r2"])


@query(
    "t15_ablation_summary",
    f"with f as ({_FM}), m as (select ablation_name, avg(raw_rmse) rr, avg(calibrated_rmse) cr, avg(calibrated_r2) c2 from f group by 1) select ablation_name, {r('cr', 'mean_calibrated_rmse')}, {r('rr - cr', 'calibration_rmse_gain')}, "
    f"{r('cr - (select cr from m where ablation_name = ' + chr(39) + 'full_features' + chr(39) + ')', 'delta_vs_full_calibrated_rmse')}, ablation_name = (select arg_min(ablation_name, cr) from m where ablation_name <> 'full_features') is_selected_non_full_winner from m",
)
def t15(spark, sf):
    return pick(T.ablation_summary(fold_rows(spark, sf)), ["ablation_name", "is_selected_non_full_winner"], ["mean_calibrated_rmse", "calibration_rmse_gain", "delta_vs_full_calibrated_rmse"])


@query("t16_run_ablation")
def t16(spark, sf):
    rows, scope = labelled(spark, sf)
    return T.ablation_summary(T.run_ablation(rows, RIDGE, scope=scope)).select("ablation_name", "mean_calibrated_rmse", "delta_vs_full_calibrated_rmse", "is_selected_non_full_winner")


def _runs(spark, sf):
    scope = V.scope_of(spark, sf)
    sizes = F.array(F.lit(250), F.lit(500), F.lit(1000))
    c = V.cells_with_total(spark, sf, scope).withColumn("cell_size_m", F.explode(sizes))
    surf = c.select("area_id", "cell_size_m", "cell_id", (F.col("building_area") * F.col("cell_size_m")).alias("raw_value"), (F.col("road_length") / F.col("cell_size_m")).alias("surface_value"))
    k = F.col("area_id")
    asked = V.totals(spark, sf).select("area_id", F.explode(F.array(F.lit(250), F.lit(500), F.lit(1000), F.lit(2000))).alias("cell_size_m"))
    asked = asked.withColumns({"qa_warning_count": k % 3, "qa_error_count": F.lit(0), "layer_warning_count": (k + F.col("cell_size_m")) % 4, "runtime_seconds": (F.lit(100000) / F.col("cell_size_m")).cast("double")})
    two = Scope(("area_id", "cell_size_m"), ("cell_id",), scope.groups * 3, scope.max_rows)
    return T.size_runs(surf, V.totals(spark, sf), asked, two)


_RUNS = {
    "s": "select area_id, z cell_size_m, cell_id, building_area * z rv, road_length / z sv from cells_t, (select unnest([250, 500, 1000]) z)",
    "g": "select area_id, cell_size_m, count(*) zones, sum(rv) raw_sum, sum(sv) final_sum, median(sv) med, quantile_cont(sv, 0.95) p95 from s group by 1, 2",
    "t": "select area_id, cell_size_m, sum(sv) filter (p <= greatest(ceil(n * 0.1), 1)) / sum(sv) top from (select *, row_number() over (partition by area_id, cell_size_m order by sv desc, cell_id) p, count(*) over (partition by area_id, cell_size_m) n from s) group by 1, 2",
    "a": "select area_id, official_total, z cell_size_m, area_id % 3 qa, (area_id + z) % 4 lw, 100000.0::double / z rt from totals, (select unnest([250, 500, 1000, 2000]) z)",
    "r": "select a.*, zones, raw_sum, med, p95, top, official_total / raw_sum f, abs(ln(official_total / raw_sum)) d from a left join g using (area_id, cell_size_m) left join t using (area_id, cell_size_m)",
}


@query(
    "t17_size_runs",
    V.with_views("cells_t", extra=_RUNS) + f"select area_id, cell_size_m, coalesce(zones, 0) zones, zones is not null success, {r('f', 'calibration_factor', 8)}, {r('med', 'median_cell_value')}, {r('p95', 'p95_cell_value')}, {r('top', 'top_10pct_share')} from r",
)
def t17(spark, sf):
    out = _runs(spark, sf)
    return out.select("area_id", "cell_size_m", "zones", "success", rnd("calibration_factor", 8).alias("calibration_factor"), *[rnd(c).alias(c) for c in ("median_cell_value", "p95_cell_value", "top_10pct_share")])


@query(
    "t18_size_choice",
    V.with_views("cells_t", extra=_RUNS)
    + f"select cell_size_m, count(*) total_runs, {r('avg(d) + 0.05 * avg(qa) + 0.1 * avg(lw) + 0.001 * avg(rt)', 'benchmark_score')} from r where zones is not null group by 1",
)
def t18(spark, sf):
    return pick(T.size_choice(_runs(spark, sf))[0], ["cell_size_m", "total_runs"], ["benchmark_score"])


@query(
    "t18_size_choice_per_area",
    V.with_views("cells_t", extra=_RUNS)
    + f"select area_id, arg_min(cell_size_m, (s, qa, lw, rt, cell_size_m)) recommended_cell_size_m, {r('min(s)', 'benchmark_score')} from (select *, d + 0.05 * qa + 0.1 * lw + 0.001 * rt s from r where zones is not null) group by 1",
)
def t18a(spark, sf):
    return pick(T.size_choice(_runs(spark, sf))[1], ["area_id", "recommended_cell_size_m"], ["benchmark_score"])


@query("u01_member_seeds", "select 'member_0' || i member_id, (n + 1009 * (i - 1))::bigint seed from (select count(*) n from nation), generate_series(1, 9) g(i)")
def u01(spark, sf):
    base = V.table(spark, sf, "nation").count()
    return U.member_seeds(spark, base, 9)


@query("u02_bootstrap", V.with_views("cells") + "select area_id, count(*) n from cells group by 1")
def u02(spark, sf):
    drawn = U.bootstrap(V.cells(spark, sf), F.lit(42).cast("long"), V.scope_of(spark, sf))
    return drawn.groupBy("area_id").agg(F.sum("draws").alias("n"))


@query("u03_u04_ensemble", V.with_views("cells") + "select 'member_0' || m member_id, count(*) n from cells, generate_series(1, 2) g(m) group by 1")
def u03(spark, sf):
    rows, scope = labelled(spark, sf)
    models, _ = E.train_ensemble(rows, RIDGE, 2, scope=scope)
    return E.predict_members(models, rows, RIDGE).groupBy("member_id").agg(F.count("pred").alias("n"))


@query("u15_cv_uncertainty")
def u15(spark, sf):
    rows, scope = labelled(spark, sf)
    return E.cv_uncertainty(rows, RIDGE, 2, scope=scope)[1]


@query(
    "i03_build_surface",
    V.with_views("cells") + f"select n_regionkey::bigint area_id, count(*) n, {r('any_value(t)', 'total')} from cells join nation on n_nationkey = area_id join (select n_regionkey k, sum(cast(round(o_totalprice) as bigint)) t from nation join customer on n_nationkey = c_nationkey join orders on o_custkey = c_custkey group by 1) on k = n_regionkey group by 1",
)
def i03(spark, sf):
    c, t, scope = five(spark, sf)
    rows = materialize(T.training_set(c, t, scope=scope)[0])
    out = S.build_surface(c, t, T.fit(rows, RIDGE), "ridge", scope=scope)
    return out["surface"].groupBy("area_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("surface_value")).alias("total"))


@query("i04_build_interval_surface")
def i04(spark, sf):
    c, t, scope = five(spark, sf)
    rows = T.training_set(c, t, scope=scope)[0]
    models, _ = E.train_ensemble(rows, RIDGE, 3, scope=scope)
    return S.build_interval_surface(c, t, models, RIDGE, scope=scope)["summary"]
