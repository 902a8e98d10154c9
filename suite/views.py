"""Views that map the driver's tables onto the engine's data model (integer arithmetic throughout).

``SQL`` holds the same views for DuckDB as named CTE bodies; ``with_views`` assembles the ones needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.contracts import MODEL_FEATURES
from gridspark.scope import Scope, unsent

SIZE = 500.0
COLS = 40


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Parquet table; the schema of a path is inferred once and given to later reads."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def scope_of(spark: SparkSession, sf: str) -> Scope:
    """Measured area scope: customers per nation, one column scanned."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("area_id"))
    return Scope.measured(c)


# name -> sum expression over order lines joined to their order (l_* and o_* columns)
_LINE_FEATURES = {
    "building_area": "sum(l_quantity)",
    "residential_area": "sum(case when l_returnflag = 'N' then l_quantity else 0 end)",
    "commercial_area": "sum(case when l_returnflag = 'A' then l_quantity else 0 end)",
    "retail_area": "sum(case when l_returnflag = 'R' then l_quantity else 0 end)",
    "public_area": "sum(case when l_linestatus = 'F' then l_quantity else 0 end)",
    "park_area": "sum(case when l_discount >= 0.095 then l_quantity else 0 end)",
    "building_with_levels_count": "sum(case when l_linenumber > 3 then 1 else 0 end)",
    "line_count": "count(*)",
    "level_sum": "sum(l_linenumber)",
    "total_floor_area": "sum(l_quantity * l_linenumber)",
    "parks_shops_count": "sum(case when l_tax >= 0.075 then 1 else 0 end)",
}
_ORDER_FEATURES = {
    "building_count": "count(*)",
    "road_length": "sum(cast(round(o_totalprice) as bigint))",
    "bus_stop_count": "sum(case when o_orderstatus = 'O' then 1 else 0 end)",
    "schools_count": "sum(case when o_orderpriority like '1-%' then 1 else 0 end)",
    "hospitals_count": "sum(case when o_orderpriority like '2-%' then 1 else 0 end)",
}
_DIRECT = [c for c in MODEL_FEATURES if c not in ("mean_building_levels", "poi_access_index", "combined_index")]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One cell per customer of a known nation, with 16 features (the combined index is an operator).

    Lines are pre-aggregated per order and orders per customer before each join.
    """
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.expr(e).alias(n) for n, e in _LINE_FEATURES.items()])
    orders = table(spark, sf, "orders")
    per_line = (
        orders.select("o_orderkey", "o_custkey")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(*[F.sum(n).alias(n) for n in _LINE_FEATURES])
    )
    per_order = orders.groupBy(F.col("o_custkey").alias("ck")).agg(*[F.expr(e).alias(n) for n, e in _ORDER_FEATURES.items()])
    nation = table(spark, sf, "nation").select("n_nationkey")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    joined = c.join(per_order, F.col("c_custkey") == F.col("ck"), "left").join(
        per_line, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    num = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double")
    k = F.col("c_custkey")
    return joined.select(
        F.col("c_nationkey").cast("long").alias("area_id"),
        F.concat(F.lit("Z"), k).alias("cell_id"),
        k.alias("cell_no"),
        (k % COLS).alias("grid_col"),
        F.expr(f"c_custkey div {COLS}").alias("grid_row"),
        (40.0 + F.expr(f"c_custkey div {COLS}") * 0.004).alias("latitude"),
        (70.0 + (k % COLS) * 0.005).alias("longitude"),
        *[num(n).alias(n) for n in _DIRECT],
        F.coalesce(F.try_divide("level_sum", "line_count"), F.lit(0.0)).cast("double").alias("mean_building_levels"),
        (1.0 / (1.0 + k % 97)).alias("poi_access_index"),
        F.col("c_acctbal").cast("double").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Official total per area: whole order value of its customers."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round("o_totalprice").cast("long")).alias("v"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("area_id"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), F.col("n_name").alias("area_name"))
    s = c.join(unsent(o), F.col("c_custkey") == F.col("o_custkey")).groupBy("area_id").agg(F.sum("v").alias("official_total"))
    return s.join(n, "area_id").select("area_id", "area_name", F.col("official_total").cast("double").alias("official_total"))


def cells_with_total(spark: SparkSession, sf: str, scope: Scope) -> DataFrame:
    from gridspark.scope import attach

    return attach(cells(spark, sf), totals(spark, sf), scope, how="inner")


MEMBERS = 9


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Nine raw member predictions per cell around its building area."""
    # the spread differs per cell, so that no two cells tie up to rounding
    spread = 1.0 + (F.col("cell_no") % 9973) / 20000.0
    factor = 1.0 + (F.pmod(F.col("cell_no") * 31 + F.col("m") * 17, F.lit(21)) - 10) / 100.0 * spread
    return (
        cells(spark, sf)
        .withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(MEMBERS))))
        .select(
            "area_id",
            "cell_id",
            "latitude",
            "longitude",
            F.concat(F.lit("member_0"), F.col("m").cast("string")).alias("member_id"),
            ((F.col("building_area") + 1.0) * factor).alias("pred"),
        )
    )


def context(spark: SparkSession, sf: str) -> DataFrame:
    """Area context for the interval surface: completeness and internal support by simple rules."""
    a = F.col("area_id")
    score = (40 + (a * 7) % 55).cast("double")
    support = ((a % 5) * 0.2).cast("double")
    return totals(spark, sf).select(
        "area_id",
        "area_name",
        "official_total",
        score.alias("completeness_score"),
        F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 55, "moderate").otherwise("weak").alias("completeness_label"),
        support.alias("internal_support_score"),
        F.when(support >= 0.6, "strong").otherwise("mixed").alias("district_support_flag"),
    )


def interval(spark: SparkSession, sf: str, scope: Scope) -> DataFrame:
    from gridspark.operators.uncertainty import interval_surface

    return interval_surface(members(spark, sf), context(spark, sf), scope=scope, n_members=MEMBERS)


def diagnostics(spark: SparkSession, sf: str, scope: Scope) -> DataFrame:
    """Interval surface with the recomputed weak target, covered flag and error."""
    from gridspark.operators.scaling import allocate
    from gridspark.operators.stats import proxy_check

    weak = allocate(cells_with_total(spark, sf, scope), scope=scope)
    return proxy_check(interval(spark, sf, scope), weak, scope)


# ---------------------------------------------------------------------------------------------- DuckDB

_BANDS = "case when {s} >= 0.70 then 'high' when {s} < 0.40 then 'low' else 'medium' end"

_minmax = lambda e: f"coalesce(({e} - min({e}) over w) / nullif(max({e}) over w - min({e}) over w, 0), 0.0)"
PROXY_SQL = " + ".join(
    f"{w} * " + _minmax(f"ln(1 + {c})")
    for c, w in {
        "total_floor_area": 0.35,
        "building_area": 0.18,
        "residential_area": 0.16,
        "building_count": 0.08,
        "road_length": 0.06,
        "bus_stop_count": 0.04,
        "schools_count": 0.03,
        "hospitals_count": 0.03,
        "parks_shops_count": 0.04,
    }.items()
)

SQL: dict[str, str] = {
    "per_line": "select o_custkey, "
    + ", ".join(f"{e} as {n}" for n, e in _LINE_FEATURES.items())
    + " from orders join lineitem on o_orderkey = l_orderkey group by o_custkey",
    "per_order": "select o_custkey as ck, "
    + ", ".join(f"{e} as {n}" for n, e in _ORDER_FEATURES.items())
    + " from orders group by o_custkey",
    "cells": "select cast(c_nationkey as bigint) area_id, 'Z' || c_custkey cell_id, c_custkey cell_no, "
    f"c_custkey % {COLS} grid_col, c_custkey // {COLS} grid_row, "
    f"40.0 + (c_custkey // {COLS}) * 0.004::double latitude, 70.0 + (c_custkey % {COLS}) * 0.005::double longitude, "
    + ", ".join(f"coalesce({n}, 0)::double as {n}" for n in _DIRECT)
    + ", coalesce(level_sum::double / line_count, 0.0)::double mean_building_levels, "
    "1.0::double / (1 + c_custkey % 97) poi_access_index, c_acctbal::double balance, c_mktsegment segment "
    "from customer left join per_order on c_custkey = ck left join per_line on c_custkey = o_custkey "
    "where c_nationkey in (select n_nationkey from nation)",
    "totals": "select cast(n_nationkey as bigint) area_id, n_name area_name, sum(cast(round(o_totalprice) as bigint))::double official_total "
    "from nation join customer on n_nationkey = c_nationkey join orders on o_custkey = c_custkey group by 1, 2",
    "cells_t": "select cells.*, area_name, official_total from cells join totals using (area_id)",
    "scored": f"select *, greatest({PROXY_SQL}, 0) proxy_score from cells_t window w as (partition by area_id)",
    "weak": "select *, (proxy_score + 1e-6) / sum(proxy_score + 1e-6) over (partition by area_id) weak_share, "
    "(proxy_score + 1e-6) / sum(proxy_score + 1e-6) over (partition by area_id) * official_total weak_target from scored",
    "context": "select *, case when completeness_score >= 85 then 'excellent' when completeness_score >= 70 then 'good' "
    "when completeness_score >= 55 then 'moderate' else 'weak' end completeness_label, "
    "case when internal_support_score >= 0.6 then 'strong' else 'mixed' end district_support_flag "
    "from (select *, (40 + (area_id * 7) % 55)::double completeness_score, (area_id % 5) * 0.2::double internal_support_score from totals)",
    "members": f"select area_id, cell_id, latitude, longitude, 'member_0' || m member_id, "
    f"(building_area + 1) * (1 + (((cell_no * 31 + m * 17) % 21) - 10) / 100.0::double * (1 + (cell_no % 9973) / 20000.0::double)) pred from cells, generate_series(1, {MEMBERS}) g(m)",
    "cal": "select members.*, official_total, pred / sum(pred) over (partition by area_id, member_id) * official_total pc from members join totals using (area_id)",
    "summ": "select area_id, cell_id, latitude, longitude, any_value(official_total) official_total, count(*) member_count, "
    "quantile_cont(pc, 0.1) q10, quantile_cont(pc, 0.5) q50, quantile_cont(pc, 0.9) q90 from cal group by 1, 2, 3, 4",
    "aligned": "select area_id, cell_id, latitude, longitude, official_total, member_count, q10 * f p10, q50 * f p50, q90 * f p90, "
    "(q90 - q10) * f uncertainty_width, (q90 - q10) * f / greatest(q50 * f, 1e-6) relative_uncertainty "
    "from (select *, official_total / sum(q50) over (partition by area_id) f from summ)",
    "scored_iv": "select a.*, c.area_name, completeness_score, completeness_label, internal_support_score, district_support_flag, "
    "1 - least(greatest(relative_uncertainty / greatest(quantile_cont(relative_uncertainty, 0.9) over (partition by a.area_id), 1e-6), 0), 1) model_stability_score "
    "from aligned a join context c using (area_id)",
    "conf": "select *, least(greatest(0.40 * model_stability_score + 0.25 * completeness_score / 100 + 0.20 * 0.5 + 0.15 * internal_support_score, 0), 1) confidence_score from scored_iv",
    "ranked": "select *, " + _BANDS.format(s="confidence_score") + " confidence_band, dense_rank() over (partition by area_id order by p50 desc) hotspot_rank, "
    "quantile_cont(p50, 0.9) over (partition by area_id) hot, quantile_cont(p50, 0.75) over (partition by area_id) upp, quantile_cont(p50, 0.5) over (partition by area_id) mid from conf",
    "iv": "select 'run' run_id, 'rf500m_uncertainty' model_version, area_id, replace(lower(area_name), '_', '_') area_slug, cell_id, "
    "latitude centroid_latitude, longitude centroid_longitude, official_total, member_count, p10, p50, p90, p50 surface_value, "
    "uncertainty_width, relative_uncertainty, model_stability_score, completeness_score, completeness_label, completeness_score / 100 completeness_support, "
    "0.5::double external_agreement_score, internal_support_score, confidence_score, confidence_band, hotspot_rank, "
    "case when p50 < mid and confidence_band = 'low' then 'low_value_high_uncertainty' when p50 >= upp and p50 < hot and confidence_band = 'high' then 'medium_value_high_confidence' "
    "when p50 >= hot and confidence_band = 'low' then 'high_value_low_confidence' when p50 >= hot and confidence_band = 'high' then 'high_value_high_confidence' else 'not_priority' end hotspot_priority_class, "
    "district_support_flag from ranked",
    "diag": "select iv.*, w.weak_target, coalesce(w.weak_target >= p10 and w.weak_target <= p90, false) covered_by_interval, abs(p50 - w.weak_target) absolute_error_p50 "
    "from iv left join weak w using (area_id, cell_id)",
}
_NEEDS = {
    "cells": ["per_line", "per_order"],
    "cells_t": ["cells", "totals"],
    "scored": ["cells_t"],
    "weak": ["scored"],
    "context": ["totals"],
    "members": ["cells"],
    "cal": ["members", "totals"],
    "summ": ["cal"],
    "aligned": ["summ"],
    "scored_iv": ["aligned", "context"],
    "conf": ["scored_iv"],
    "ranked": ["conf"],
    "iv": ["ranked"],
    "diag": ["iv", "weak"],
}


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named views and everything they need, then the extra CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _NEEDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as materialized ({SQL[n]})" for n in order]
    parts += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    return "with " + ", ".join(parts) + " "
