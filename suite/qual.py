"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.contracts import MODEL_FEATURES
from gridspark.operators import quality as Q
from suite import views as V
from suite.registry import pick, query, r, rnd, rs

_COLS = ("building_area", "road_length", "poi_access_index", "park_area", "balance")


def _dirty(spark, sf):
    """Cells with defects: null coordinates, a constant column, and every 50th cell id repeated."""
    c = V.cells(spark, sf)
    return c.withColumns(
        {
            "latitude": F.when(F.col("cell_no") % 41 != 0, F.col("latitude")),
            "poi_access_index": F.when(F.col("area_id") % 6 == 0, F.lit(0.0)).otherwise(F.col("poi_access_index")),
            "cell_id": F.when(F.col("cell_no") % 50 == 1, F.lit("Z0")).otherwise(F.col("cell_id")),
            "hospitals_count": F.when(F.col("hospitals_count") > 3, F.col("hospitals_count")).otherwise(F.lit(0.0)),
        }
    )


_DIRTY = (
    "select * replace (case when cell_no % 41 <> 0 then latitude end as latitude, case when area_id % 6 = 0 then 0.0 else poi_access_index end as poi_access_index, "
    "case when cell_no % 50 = 1 then 'Z0' else cell_id end as cell_id, case when hospitals_count > 3 then hospitals_count else 0.0 end as hospitals_count) from cells"
)
_QC = ("building_area", "poi_access_index", "hospitals_count", "balance")
_LONG = " union all ".join(f"select area_id, '{c}' \"column\", {c}::double v from d" for c in _QC)
_PROF = (
    "select area_id, \"column\", count(v) \"count\", avg(v) mean, median(v) median, quantile_cont(v, 0.95) p95, max(v) \"max\", avg((v = 0)::int) zero_share, count(distinct v) unique_count, "
    "count(*) filter (v < 0) negative_count, count(*) n from l group by 1, 2"
)


@query(
    "q01_profile",
    V.with_views("cells", extra={"d": _DIRTY, "l": _LONG, "p": _PROF})
    + f"select area_id, \"column\", \"count\", unique_count, negative_count, {rs('mean', 'median', 'p95', 'zero_share')}, {r('\"max\"', '\"max\"')} from p",
)
def q01(spark, sf):
    df = Q.profile(_dirty(spark, sf), _QC, V.scope_of(spark, sf))
    return pick(df, ["area_id", "column", "count", "unique_count", "negative_count"], ["mean", "median", "p95", "zero_share", "max"])


_FLAGS = (
    "select area_id, 'error' severity, \"column\", 'negative_values' issue from p where negative_count > 0 union all select area_id, 'warning', \"column\", 'constant_feature' from p where unique_count <= 1 and n > 1 "
    "union all select area_id, 'warning', \"column\", 'extreme_zero_share' from p where zero_share >= 0.98 union all select area_id, 'error', \"column\", 'zero_critical_feature' from p where \"column\" = 'poi_access_index' and unique_count = 1 and \"max\" = 0 "
    "union all select area_id, 'error', 'latitude/longitude', 'missing_coordinates' from d group by area_id having count(*) filter (latitude is null) > 0 "
    "union all select area_id, 'error', 'cell_id', 'duplicate_cell_ids' from d group by area_id having count(*) > count(distinct cell_id)"
)


@query("q02_qa_flags", V.with_views("cells", extra={"d": _DIRTY, "l": _LONG, "p": _PROF}) + _FLAGS)
def q02(spark, sf):
    return Q.qa_flags(_dirty(spark, sf), _QC, V.scope_of(spark, sf)).select("area_id", "severity", "column", "issue")


_SUM = (
    "select area_id, max(n) row_count, sum(negative_count)::bigint negative_feature_values, count(*) filter (unique_count <= 1 and n > 1) constant_feature_count, count(*) filter (zero_share >= 0.98) high_zero_share_feature_count, "
    "max(zero_share) filter (\"column\" = 'building_area') building_area_zero_share from p group by 1"
)


@query(
    "q03_qa_summary",
    V.with_views("cells", extra={"d": _DIRTY, "l": _LONG, "p": _PROF, "s": _SUM, "f": "select area_id, count(*) filter (latitude is null) null_latitude, count(*) - count(distinct cell_id) duplicate_ids from d group by 1"})
    + f"select s.area_id, row_count, negative_feature_values, constant_feature_count, high_zero_share_feature_count, null_latitude, duplicate_ids, {rs('building_area_zero_share')} from s join f using (area_id)",
)
def q03(spark, sf):
    df = Q.qa_summary(_dirty(spark, sf), _QC, V.scope_of(spark, sf))
    return pick(
        df,
        ["area_id", "row_count", "negative_feature_values", "constant_feature_count", "high_zero_share_feature_count", "null_latitude", "duplicate_ids"],
        ["building_area_zero_share"],
    )


@query(
    "q04_qa_digest",
    V.with_views("cells", extra={"d": _DIRTY, "l": _LONG, "p": _PROF, "f": _FLAGS})
    + "select (select count(distinct area_id) from d) areas, (select count(*) from d) total_rows, (select count(*) from f where severity = 'error') qa_errors, (select count(*) from f where severity = 'warning') qa_warnings, "
    f"(select count(distinct area_id) from f where severity = 'error') areas_with_errors, (select {r('median(median)', 'x')} from p where \"column\" = 'building_area') building_area_median, (select {r('median(p95)', 'x')} from p where \"column\" = 'building_area') building_area_p95",
)
def q04(spark, sf):
    scope = V.scope_of(spark, sf)
    d = _dirty(spark, sf)
    p = Q.profile(d, _QC, scope)
    df = Q.qa_digest(Q.qa_summary(d, _QC, scope, p), Q.qa_flags(d, _QC, scope, p), p, ["building_area"])
    return pick(df, ["areas", "total_rows", "qa_errors", "qa_warnings", "areas_with_errors"], ["building_area_median", "building_area_p95"])


@query(
    "q05_validate_cells",
    V.with_views("cells", extra={"d": _DIRTY})
    + "select area_id, 'error' level, 'missing_coordinates' code, count(*) affected_rows from d where latitude is null or longitude is null group by 1 union all "
    "select area_id, 'error', 'duplicate_cell_id', count(*) - count(distinct cell_id) from d group by 1 having count(*) > count(distinct cell_id) union all "
    "select area_id, 'error', 'negative_values', count(*) from d where balance < 0 group by 1 union all select area_id, 'error', 'missing_columns', 0 from d group by 1",
)
def q05(spark, sf):
    df = Q.validate(_dirty(spark, sf), non_negative=(*MODEL_FEATURES, "balance"), scope=V.scope_of(spark, sf))
    return df.select("area_id", "level", "code", "affected_rows")


def _broken(spark, sf):
    """Interval surface with wrong bands, classes and finals in a few areas."""
    n = F.substring("cell_id", 2, 12).cast("long")
    return V.interval(spark, sf, V.scope_of(spark, sf)).withColumns(
        {
            "confidence_band": F.when(n % 101 == 0, "sure").otherwise(F.col("confidence_band")),
            "hotspot_priority_class": F.when(n % 103 == 0, "maybe").otherwise(F.col("hotspot_priority_class")),
            "surface_value": F.when(n % 107 == 0, F.col("surface_value") + 1).otherwise(F.col("surface_value")),
            "uncertainty_width": F.when(n % 109 == 0, F.col("uncertainty_width") * 2 + 1).otherwise(F.col("uncertainty_width")),
            "relative_uncertainty": F.when(n % 113 == 0, F.lit(float("inf"))).otherwise(F.col("relative_uncertainty")),
        }
    )


_BRK = "select *, substr(cell_id, 2)::bigint n from iv"
_Q6 = (
    "select area_id, 'error' lv, 'invalid_confidence_band' code, count(*) affected_rows from k where n % 101 = 0 group by 1 union all select area_id, 'error', 'confidence_band_mismatch', count(*) from k where n % 101 = 0 group by 1 "
    "union all select area_id, 'error', 'invalid_hotspot_priority_class', count(*) from k where n % 103 = 0 group by 1 union all select area_id, 'error', 'invalid_final_alias', count(*) from k where n % 107 = 0 group by 1"
)


@query("q06_validate_interval", V.with_views("iv", extra={"k": _BRK, "x": _Q6}) + "select area_id, lv as level, code, affected_rows from x")
def q06(spark, sf):
    return Q.validate_interval(_broken(spark, sf), V.scope_of(spark, sf)).select("area_id", "level", "code", "affected_rows")


_Q7 = (
    "select area_id, 'confidence_band' \"check\", count(*) affected_rows from k where n % 101 = 0 group by 1 union all select area_id, 'priority_class', count(*) from k where n % 103 = 0 group by 1 "
    "union all select area_id, 'interval_width', count(*) from k where n % 109 = 0 group by 1"
)


@query("q07_validate_ranked", V.with_views("iv", extra={"k": _BRK}) + _Q7)
def q07(spark, sf):
    return Q.validate_ranked(_broken(spark, sf), V.scope_of(spark, sf))


@query(
    "q08_validate_package",
    V.with_views("iv", extra={"k": _BRK, "x": _Q6})
    + _Q7
    + " union all select area_id, 'finite_relative', count(*) from k where n % 113 = 0 group by 1 union all select area_id, code, affected_rows from x",
)
def q08(spark, sf):
    return Q.validate_package(_broken(spark, sf), V.scope_of(spark, sf))


@query(
    "q09_sanitize",
    "select c_custkey cell_no, case when c_custkey % 5 = 0 then 0.0 else round(greatest(c_acctbal, 0), 2) end + 0.0 v from customer where c_custkey % 41 <> 0",
)
def q09(spark, sf):
    c = V.table(spark, sf, "customer")
    raw = c.select(
        F.col("c_custkey").alias("cell_no"),
        F.when(F.col("c_custkey") % 41 != 0, F.lit(1.0)).alias("latitude"),
        F.lit(2.0).alias("longitude"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("v"),
    )
    return Q.sanitize(raw, ["v"]).select("cell_no", rnd("v", 2).alias("v"))


_Z = {n: f"avg(({c} <= 0)::int)" for n, c in {"b": "building_area", "ro": "road_length", "p": "poi_access_index", "f": "total_floor_area", "bs": "bus_stop_count", "pk": "park_area", "s": "schools_count", "h": "hospitals_count", "re": "retail_area"}.items()}
_H = lambda n: f"(0.5 * (1 - {n}) + 0.5 * (case when 1 - {n} > 0 then 1 else 0 end))"
_COMP = {
    "z": "select area_id, " + ", ".join(f"{e} {n}" for n, e in _Z.items()) + " from d group by 1",
    "s": f"select *, ({_H('b')} + {_H('ro')} + (1 - p)) / 3 cc, ({_H('bs')} + {_H('pk')} + {_H('s')} + {_H('h')} + {_H('re')}) / 5 oc, (3 - b - ro - f) / 3 dq from z",
    "c": "select *, 100 * (0.45 * cc + 0.2 * oc + 0.25 * dq + 0.1) sc from s",
}
_COMP_OUT = (
    "select area_id, round_even(sc, 3) + 0.0 completeness_score, case when sc >= 85 then 'excellent' when sc >= 70 then 'good' when sc >= 55 then 'moderate' else 'weak' end completeness_label, "
    "round_even(cc, 3) + 0.0 critical_coverage_score, round_even(oc, 3) + 0.0 optional_coverage_score, round_even(dq, 3) + 0.0 density_quality_score from c"
)


@query("q10_completeness", V.with_views("cells", extra={"d": _DIRTY} | _COMP) + _COMP_OUT)
def q10(spark, sf):
    df = Q.completeness(_dirty(spark, sf), V.scope_of(spark, sf))
    return df.select("area_id", "completeness_score", "completeness_label", "critical_coverage_score", "optional_coverage_score", "density_quality_score")


@query("q11_completeness_batch", V.with_views("cells", extra={"d": "select * from cells"} | _COMP) + _COMP_OUT)
def q11(spark, sf):
    df = Q.completeness_batch(V.cells(spark, sf), V.scope_of(spark, sf))
    return df.select("area_id", "completeness_score", "completeness_label", "critical_coverage_score", "optional_coverage_score", "density_quality_score")


@query(
    "q14_validate_cases",
    "with c as (select 'area_' || s_nationkey area_slug, count(*) n from supplier group by 1), k as (select 'area_' || n_nationkey area_slug from nation) "
    "select k.area_slug, 'wrong_case_count' issue, coalesce(n, 0)::varchar details from k left join c using (area_slug) where coalesce(n, 0) <> 4 "
    "union all select k.area_slug, 'wrong_hotspot_count', coalesce(h, 0)::varchar from k left join (select 'area_' || s_nationkey area_slug, count(*) filter (s_suppkey % 2 = 0) h from supplier group by 1) using (area_slug) where coalesce(h, 0) <> 2 "
    "union all select k.area_slug, 'wrong_coldspot_count', coalesce(h, 0)::varchar from k left join (select 'area_' || s_nationkey area_slug, count(*) filter (s_suppkey % 2 = 1) h from supplier group by 1) using (area_slug) where coalesce(h, 0) <> 2 "
    "union all select k.area_slug, 'missing_case_id', i from k, (select unnest(['H1', 'H2']) i) where not exists (select 1 from supplier where 'area_' || s_nationkey = k.area_slug and s_suppkey % 2 = 0 and 'H' || (s_suppkey // 2 % 2 + 1) = i) "
    "union all select k.area_slug, 'missing_case_id', i from k, (select unnest(['L1', 'L2']) i) where not exists (select 1 from supplier where 'area_' || s_nationkey = k.area_slug and s_suppkey % 2 = 1 and 'L' || (s_suppkey // 2 % 2 + 1) = i) "
    "union all select 'area_' || s_nationkey, 'duplicate_component', 'c' || s_suppkey % 8 from supplier group by s_nationkey, s_suppkey % 8 having count(*) > 1 "
    "union all select 'area_' || s_nationkey, 'missing_text', case when s_suppkey % 2 = 0 then 'H' else 'L' end || (s_suppkey // 2 % 2 + 1) from supplier where s_suppkey % 11 = 0 "
    "union all select 'area_' || s_nationkey, 'unknown_component', 'c7' from supplier where s_suppkey % 8 = 7",
)
def q14(spark, sf):
    s = V.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    slug = F.concat(F.lit("area_"), "s_nationkey")
    hot = k % 2 == 0
    registry = s.select(
        F.upper(slug).alias("area_slug"),
        F.when(hot, "hotspot").otherwise("coldspot").alias("zone_type"),
        F.concat(F.when(hot, "H").otherwise("L"), (F.expr("s_suppkey div 2") % 2 + 1)).alias("case_id"),
        F.concat(F.lit("c"), k % 8).alias("source_component_id"),
        F.when(k % 11 != 0, F.col("s_name")).alias("case_title"),
        F.lit("label").alias("interpretation_label"),
        F.lit("text").alias("narrative_summary"),
        F.lit("Yes").alias("include_in_report"),
    )
    areas = V.table(spark, sf, "nation").select(F.concat(F.lit("area_"), "n_nationkey").alias("area_slug"))
    known = areas.withColumn("source_component_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(7)])))
    return Q.validate_cases(registry, known, areas)


def question_view(spark, sf):
    """User turns as a question bank, with blank and repeated ids and odd languages in it."""
    c = V.table(spark, sf, "conversations").where("role = 'user'")
    k = F.col("conv_id") * 100 + F.col("turn")
    cats = F.array(*[F.lit(x) for x in ("city_overview", "hotspot_interpretation", "uncertainty_confidence", "compare_cities")])
    none = F.lit("")
    return c.select(
        F.when(k % 37 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Q"), F.expr("(conv_id * 100 + turn) div 3"))).alias("question_id"),
        F.element_at(cats, (k % 4 + 1).cast("int")).alias("category"),
        F.concat(F.lit("NATION_"), k % 25).alias("city"),
        F.lit("ask").alias("mode"),
        F.when(k % 29 == 0, "xx").when(k % 2 == 0, "EN").otherwise("ru").alias("language"),
        F.when(k % 31 == 0, none).otherwise(F.col("text")).alias("question"),
        none.alias("expected_risk_level"),
        none.alias("expected_evidence_type"),
        none.alias("must_mention"),
        none.alias("forbidden_claim_trigger"),
        none.alias("notes"),
    )


_QB = (
    "select case when k % 37 = 0 then '' else 'Q' || (k // 3) end question_id, case k % 4 when 0 then 'city_overview' when 1 then 'hotspot_interpretation' when 2 then 'uncertainty_confidence' else 'compare_cities' end category, "
    "case when k % 29 = 0 then 'xx' when k % 2 = 0 then 'EN' else 'ru' end \"language\", case when k % 31 = 0 then '' else \"text\" end question from (select *, conv_id * 100 + turn k from conversations where \"role\" = 'user')"
)


@query(
    "q15_validate_questions",
    f"with q as ({_QB}) select 'blank_question_id' issue, '' details, 1::bigint affected_rows from q where question_id = '' union all select 'blank_question', question_id, 1 from q where trim(question) = '' "
    "union all select 'invalid_language', question_id, 1 from q where \"language\" = 'xx' union all select 'duplicate_question_id', question_id, count(*) from q where question_id <> '' group by question_id having count(*) > 1",
)
def q15(spark, sf):
    return Q.validate_questions(question_view(spark, sf))


@query(
    "q15_question_counts",
    f"with q as ({_QB}) select 'category' kind, category \"value\", count(*) questions from q group by category union all select 'language', \"language\", count(*) from q group by \"language\"",
)
def q15c(spark, sf):
    return Q.question_counts(question_view(spark, sf))
