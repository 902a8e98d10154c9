"""Source, scalar, registry and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import scalars as N
from gridspark.operators import hotspots as H
from gridspark.operators import quality as Q
from gridspark.operators import registry as Y
from gridspark.operators import reports as R
from gridspark.operators import spatial as P
from gridspark.operators import stats as B
from gridspark.operators import training as T
from gridspark.operators import uncertainty as U
from gridspark.scope import Scope, materialize, spread
from gridspark.sources import tables as S
from suite import views as V
from suite.registry import pick, query, r, rnd, rs
from suite.space import component_surface
from suite.text import scored_cases
from suite.qual import question_view
from suite.train import fold_rows


@query(
    "n01_n02_names",
    "select c_custkey, 'customer ' || lpad(c_custkey::varchar, 9, '0') area_key, 'customer_' || lpad(c_custkey::varchar, 9, '0') slug, c_name display, lower(c_mktsegment) segment_key from customer",
)
def n01(spark, sf):
    c = V.table(spark, sf, "customer")
    messy = F.concat(F.lit("  12_"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" "))
    return c.select(
        "c_custkey",
        N.norm_name(messy).alias("area_key"),
        N.slug(F.replace("c_name", F.lit("#"), F.lit(","))).alias("slug"),
        N.display_name(F.concat("c_name", F.lit(", Country"))).alias("display"),
        N.norm_name(F.translate("c_mktsegment", "EU", "ÉÜ")).alias("segment_key"),
    )


@query("n03_boundary_labels", "select n_nationkey, 'nation ' || n_nationkey as label_key from nation")
def n03(spark, sf):
    n = V.table(spark, sf, "nation")
    return n.select("n_nationkey", N.norm_boundary(F.concat(F.lit(" "), "n_name", F.lit("! District"))).alias("label_key"))


@query("n04_question_keys", r"select item_id, trim(regexp_replace(lower(t), '[^a-z0-9_\-/]+', ' ', 'g')) k from (select item_id, regexp_replace(" + '"text"' + r", '[^\x00-\x7F]', '', 'g') t from benchmark)")
def n04(spark, sf):
    b = V.table(spark, sf, "benchmark")
    return b.select("item_id", N.norm_question(F.regexp_replace("text", r"[^\x00-\x7F]", "")).alias("k"))


#: Full forms of digits, small and capital letters and signs: each is the plain one moved by a fixed step.
PLAIN = "".join(map(chr, range(0x21, 0x7F)))
FULL = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)


@query(
    "n04_full_forms",
    "select c_custkey, 'fi 1⁄2 viii kg '.replace('⁄', ' ') || trim(regexp_replace(lower(c_name), '[^a-z0-9_/-]+', ' ', 'g')) || ' é' question_key, "
    "'fi viii ' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ' e' area_key, "
    "'fi ' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) label_key from customer",
)
def n04_full(spark, sf):
    c = spread(V.table(spark, sf, "customer").select("c_custkey", "c_name"))  # folding is work by row: on all cores
    full = F.translate("c_name", PLAIN, FULL)
    return c.select(
        "c_custkey",
        N.norm_question(F.concat(F.lit("ﬁ ½ Ⅷ ㎏ "), full, F.lit(" e\u0301"))).alias("question_key"),
        N.norm_name(F.concat(F.lit("ﬁ Ⅷ "), F.translate(full, "＃", "-"), F.lit(" e\u0301"))).alias("area_key"),
        N.norm_boundary(F.concat(F.lit("ﬁ "), full)).alias("label_key"),
    )


@query(
    "n05_n06_coerce",
    "select p_partkey, p_partkey % 5 in (0, 1) flag, case p_partkey % 5 when 0 then true when 1 then true when 2 then false end flag3, case when p_partkey % 3 = 0 then p_retailprice end num, case when p_size > 25 then round(abs(ln(p_size / 25.0)), 6) + 0.0 end ld from part",
)
def n05(spark, sf):
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey")
    word = F.when(k % 5 == 0, " Yes").when(k % 5 == 1, "1").when(k % 5 == 2, "FALSE").otherwise("maybe")
    num = F.when(k % 3 == 0, F.col("p_retailprice").cast("string")).when(k % 3 == 1, "inf").otherwise("n/a")
    d = N.log_distance(F.col("p_size") / 25.0)
    return p.select("p_partkey", N.to_bool(word).alias("flag"), N.to_bool3(word).alias("flag3"), N.to_num(num).alias("num"), F.when(F.col("p_size") > 25, rnd(d, 6)).alias("ld"))


@query(
    "n07_n16_mixed",
    f"select s_suppkey, lower(trim(s_name)) clean, {r('ln(1 + greatest(s_acctbal, 0))', 'fwd')}, {r('greatest(s_acctbal, 0)', 'back')}, case when s_nationkey > 0 then {r('s_acctbal / s_nationkey', 'x', 9).replace(' as x', '')} else -1.0 end ratio, "
    "least(case when s_nationkey > 1 then s_nationkey / 100.0::double else s_nationkey end, 1.0)::double support, case when s_nationkey < 8 then 'west' when s_nationkey > 16 then 'east' else 'central' end dir from supplier",
)
def n07(spark, sf):
    s = V.table(spark, sf, "supplier")
    nk = F.col("s_nationkey")
    return s.select(
        "s_suppkey",
        N.clean_str(s, "s_name").alias("clean"),
        rnd(N.forward_target(F.col("s_acctbal"))).alias("fwd"),
        rnd(N.inverse_target(N.forward_target(F.col("s_acctbal")))).alias("back"),
        rnd(N.safe_div(F.col("s_acctbal"), nk, -1.0), 9).alias("ratio"),
        N.norm_support(nk).alias("support"),
        N.direction(nk.cast("double"), F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(24.0), F.lit(24.0)).alias("dir"),
    )


@query(
    "s02_structured_totals",
    "select replace(lower(c_mktsegment), '_', ' ') normalized_city_name, max(floor(c_acctbal))::bigint population from customer where floor(c_acctbal) > 0 group by 1",
)
def s02(spark, sf):
    c = V.table(spark, sf, "customer")
    raw = c.select(F.col("c_name").alias("city_name"), F.col("c_mktsegment").alias("normalized_city_name"), F.when(F.col("c_custkey") % 7 >= 0, F.floor("c_acctbal").cast("string")).alias("population"))
    return S.clean_totals(raw).select("normalized_city_name", "population")


@query(
    "s03_lenient_totals",
    "select 'customer ' || (c_custkey % 50) k, max(c_custkey)::bigint v from customer where c_custkey % 4 in (0, 1) and c_custkey > 0 group by 1 union all select 'rejected', count(*) from customer where c_custkey % 4 in (2, 3) or (c_custkey = 0)",
)
def s03(spark, sf):
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("Customer-"), k % 50)
    line = (
        F.when(k % 4 == 0, F.concat(F.lit('"'), name, F.lit(",\t"), k, F.lit('"')))
        .when(k % 4 == 1, F.concat(name, F.lit(", "), k))
        .when(k % 4 == 2, name)
        .otherwise(F.concat(name, F.lit(",none")))
    )
    good, bad = S.parse_total_lines(c.select(k.alias("line_no"), line.alias("line")))
    return good.select(F.col("normalized_city_name").alias("k"), F.col("population").alias("v")).unionByName(
        bad.agg(F.count(F.lit(1)).alias("v")).select(F.lit("rejected").alias("k"), "v")
    )


@query("s04_with_total", V.with_views("cells_t") + "select area_id, cell_id, official_total from cells_t where area_id <> 4")
def s04(spark, sf):
    scope = V.scope_of(spark, sf)
    return S.with_total(V.cells(spark, sf), V.totals(spark, sf).where("area_id <> 4"), "drop", scope).select("area_id", "cell_id", "official_total")


@query("s05_s06_flags", "select n_nationkey, lower(n_name[:6]) || ' ' || n_nationkey normalized_city_name, n_nationkey % 2 = 0 use_in_metrics, (n_nationkey * 10)::double official_population from nation")
def s05(spark, sf):
    n = V.table(spark, sf, "nation")
    raw = n.select(
        "n_nationkey",
        F.col("n_name").alias("city_name"),
        F.lit("d").alias("district_name"),
        F.lit("q").alias("district_query"),
        (F.col("n_nationkey") * 10).cast("string").alias("official_population"),
        F.when(F.col("n_nationkey") % 2 == 0, "True").otherwise("no").alias("use_in_metrics"),
    )
    return S.clean_districts(raw).select("n_nationkey", "normalized_city_name", "use_in_metrics", "official_population")


@query(
    "s07_attach_geometry",
    "select count(*) filter (c_custkey % 10 = 3) missing_geometry, 0::bigint duplicate_attribute_keys, count(*) filter (c_custkey % 10 = 5) duplicate_geometry_keys from customer",
)
def s07(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("area_id"), F.col("c_custkey").alias("cell_id"))
    g = c.where("cell_id % 10 <> 3").withColumn("geom", F.lit("box"))
    return S.attach_geometry(c, g.unionByName(g.where("cell_id % 10 = 5")))[1]


@query(
    "s08_layers",
    "select l, count(*) n from (select unnest(list_filter([case when true then 'buildings' end, case when l_linenumber = 2 then 'schools' end, case when l_linenumber = 3 then 'shops' end], lambda x: x is not null)) l from lineitem) group by 1",
)
def s08(spark, sf):
    li = V.table(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    tags = F.create_map(F.lit("building"), F.lit("house"), F.lit("amenity"), F.when(k == 2, "school").otherwise("bench"), F.lit("shop"), F.when(k == 3, "yes"))
    return S.label_layers(li.select(tags.alias("tags"), F.lit(1).alias("geom"))).groupBy(F.col("layer").alias("l")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s09_extract_totals",
    "with f as (select o_custkey % 20 s, arg_min(o_totalprice, o_orderkey) v from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1) select 'area ' || s area_key, round_even(v, 0)::bigint population from f",
)
def s09(spark, sf):
    o = V.table(spark, sf, "orders")
    rows = o.select((F.col("o_custkey") % 20).alias("source_id"), F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").cast("string").alias("value"))
    rules = rows.select("source_id").distinct().select("source_id", F.concat(F.lit("area "), "source_id").alias("area_key"), F.array(F.lit("urgent"), F.lit("high")).alias("terms"))
    return S.extract_totals(rows, rules)[0].select("area_key", "population")


@query(
    "s10_extract_options",
    "with p as (select page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 1)) i, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 2)) l from pages) "
    "select page_id, i option_id, l option_label, count(*) n from p where trim(i) <> '' and trim(l) <> '' and contains(lower(l), 'e') and (contains(lower(l), 'th') or contains(lower(l), 'qu')) group by 1, 2, 3",
)
def s10(spark, sf):
    p = V.table(spark, sf, "pages").select("page_id", F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>', '<option value="$1">$2</option>').alias("html"))
    out = S.extract_options(p, "e", ["th", "qu"])
    return out.groupBy("page_id", "option_id", "option_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s12_upsert_summary",
    "select 'slug_' || n_nationkey area_slug, case when n_nationkey % 2 = 0 then 'new' else 'old' end source, case when n_nationkey % 2 = 0 then n_nationkey end extra from nation",
)
def s12(spark, sf):
    n = V.table(spark, sf, "nation").select(F.concat(F.lit("slug_"), "n_nationkey").alias("area_slug"), "n_nationkey")
    old = n.select("area_slug", F.lit("old").alias("source"))
    new = n.where("n_nationkey % 2 = 0").select("area_slug", F.lit("new").alias("source"), F.col("n_nationkey").alias("extra"))
    return S.upsert_summary(old, new, columns=["area_slug", "source", "extra"])


@query(
    "s17_context",
    "select n_nationkey::bigint area_id, case when n_nationkey % 2 = 0 then n_name else n_nationkey::varchar end display_name, case when n_nationkey % 3 = 0 then round((n_nationkey + 2) / 100.0::double, 6) + 0.0 else 0.0 end completeness_support, case when n_nationkey % 2 = 1 then 0.5 when n_nationkey % 4 = 0 then 0.55 else 0.4 end::double internal_support_score from nation",
)
def s17(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), F.col("n_name").alias("area_name"))
    k = F.col("area_id")
    reg = n.where(k % 2 == 0).withColumn("district_benchmark_quality", F.when(k % 4 == 0, " Partial").otherwise("full"))
    com = n.where(k % 3 == 0).select("area_id", (k + 2.0).alias("completeness_score"), F.lit("weak").alias("completeness_label"))
    return S.with_context(n.select("area_id"), reg, com, Scope()).select(
        "area_id", "display_name", rnd("completeness_support", 6).alias("completeness_support"), "internal_support_score"
    )


@query("s19_s20_lookup", "select n_nationkey area_id, case when n_nationkey % 3 = 0 then 'B' else 'A' end || n_nationkey alias, 'p/' || n_nationkey || '/a' path from nation where n_nationkey % 5 <> 0")
def s19(spark, sf):
    n = V.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    areas = n.select(k.alias("area_id"), F.array(F.lit("none"), F.concat(F.lit("A"), k), F.concat(F.lit("B"), k)).alias("aliases"))
    have = n.where(k % 5 != 0).select(F.explode(F.when(k % 3 == 0, F.array(F.concat(F.lit("B"), k))).otherwise(F.array(F.concat(F.lit("B"), k), F.concat(F.lit("A"), k)))).alias("alias"))
    hit, _ = S.resolve_alias(areas, have)
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("f")) for m in ("v_rf", "other") for f in ("b", "a")])
    listing = n.select(k.cast("string").alias("area_slug"), F.explode(kinds).alias("_e")).select(
        "area_slug", "_e.model", F.concat(F.lit("p/"), "area_slug", F.lit("/"), "_e.f").alias("path")
    )
    found = S.find_surface(listing, hit.select(F.col("area_id").cast("string").alias("area_slug"), F.lit("rf").alias("model_suffix")))
    return hit.join(found.select(F.col("area_slug").cast("int").alias("area_id"), "path"), "area_id")


@query("s21_tag_run", "select 'run-1' run_id, n_nationkey, n_regionkey from nation")
def s21(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return S.tag_run(S.attach_display(n.select("n_nationkey"), n, ["n_regionkey"], ["n_nationkey"]), "run-1")


def registry(spark, sf):
    """Evidence about nations from different tables."""
    n = V.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    named = lambda cond: n.where(cond).select(F.col("n_name").alias("city_name"), "n_nationkey")
    c = V.table(spark, sf, "customer").join(n, F.col("c_nationkey") == k)
    totals = named(k < 20).select("city_name", F.lit("Land").alias("country"), (k * 100 + 1).alias("population"), F.lit("2026-01-01").alias("reference_date"), F.lit(True).alias("verified"))
    features = c.where(k % 2 == 0).select(F.col("n_name").alias("city_name"), F.lit("f.csv").alias("source_file"), F.lit(1).cast("long").alias("row_count"))
    qa = named(k % 2 == 0).withColumn("high_zero_share_feature_count", F.lit(1))
    flags = c.where((k % 6 == 0)).select(F.col("n_name").alias("city_name"), F.when(F.col("c_custkey") % 2 == 0, "error").otherwise("warning").alias("severity"))
    dist = named(k % 4 == 0).select("city_name", F.lit(3).alias("district_reference_row_count"), F.lit(3).alias("district_count_total"), F.when(k % 8 == 0, 3).otherwise(2).alias("district_count_compared"), F.lit(0).alias("boundary_warning_count"))
    return Y.build_registry(totals, features, qa, flags, c.where(k % 10 != 2).select(F.col("n_name").alias("city_name")), named(k < 12), named(k % 3 == 0), dist, named(k % 4 == 0))


_REG = (
    "select n_name, n_nationkey k, n_nationkey < 20 tot, n_nationkey % 2 = 0 feat, case when n_nationkey % 6 = 0 then (select count(*) from customer where c_nationkey = n_nationkey and c_custkey % 2 = 0) else 0 end err, "
    "n_nationkey % 10 <> 2 tr, (n_nationkey % 4 = 0) dd, n_nationkey % 8 = 0 dfull from nation"
)
_REGL = (
    "select *, feat and err = 0 and tr val, case when dd and dfull then 'full' when dd then 'partial' else 'none' end quality from reg"
)
_REGS = (
    "select 'nation ' || k normalized_city_name, quality district_benchmark_quality, val validated_batch, err qa_error_count, case when val and quality = 'full' then 'validated_district_benchmark' when val and quality = 'partial' then 'validated_partial_district_benchmark' "
    "when val and k < 12 then 'validated_smoke_passed' when val then 'validated_batch' when tot and k % 3 = 0 then 'calibrated_runtime_only' when tot then 'official_total_only' when feat then 'feature_only' else 'untracked' end status_label from regl"
)


@query("q12_status_registry", f"with reg as ({_REG}), regl as ({_REGL}) {_REGS}")
def q12(spark, sf):
    return registry(spark, sf).select("normalized_city_name", "district_benchmark_quality", "validated_batch", "qa_error_count", "status_label")


@query("q13_registry_queries", f"with reg as ({_REG}), regl as ({_REGL}) select 'nation ' || k normalized_city_name, case when tot then n_name || ', Land' else initcap_n || ', Unknown' end display_query from (select *, 'Nation ' || k initcap_n from regl) where val")
def q13(spark, sf):
    return Y.select_areas(registry(spark, sf), "validated_batch").select("normalized_city_name", "display_query")


@query("r04_status_counts", f"with reg as ({_REG}), regl as ({_REGL}), s as ({_REGS}) select status_label, count(*) areas from s group by 1")
def r04(spark, sf):
    return R.status_counts(registry(spark, sf))


@query(
    "r01_report_tables",
    V.with_views("diag")
    + "select 'coverage' part, count(distinct area_id) n from diag union all select 'interval_coverage', count(distinct area_id) from diag where area_id < 4 union all select 'error_alignment', count(distinct area_id) from diag where area_id < 4 "
    "union all select 'hotspots', count(distinct area_id) from diag union all select 'bands', count(*) from (select distinct area_id, confidence_band from diag) union all select 'limitations', 2 union all select 'stability', count(*) from (select distinct area_id, hotspot_priority_class from diag where hotspot_priority_class <> 'not_priority')",
)
def r01(spark, sf):
    scope = V.scope_of(spark, sf)
    d = materialize(V.diagnostics(spark, sf, scope))
    empty_d = d.select("area_id", F.lit(0).alias("n_districts_compared"), F.lit(0.0).alias("mean_absolute_error_p50")).where("false")
    empty_e = d.select("area_id", F.lit("p").alias("benchmark_product"), F.lit(0.0).alias("spearman_disagreement_vs_uncertainty")).where("false")
    tables = R.report_tables(
        U.interval_summary(d, scope),
        B.interval_coverage(d, "proxy", scope),
        B.error_alignment(d, "proxy", scope),
        H.hotspot_summary(d, scope),
        B.band_validation(d, scope),
        R.limitation_rows(empty_d, empty_e),
        H.stability_summary(H.stability_detail(d, scope), scope),
        spark.range(4).select(F.col("id").alias("area_id")),
    )
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "r02_limitation_rows",
    "select 'district_interval_coverage' evidence_layer, n_nationkey::varchar \"scope\", printf('compared=%d; mean_absolute_error_p50=%.1f', n_nationkey, n_nationkey * 1.5) available_result from nation union all select 'external_disagreement_alignment', 'benchmark areas', 'no external alignment summary found'",
)
def r02(spark, sf):
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"))
    d = n.withColumns({"n_districts_compared": F.col("area_id"), "mean_absolute_error_p50": F.col("area_id") * 1.5})
    e = n.withColumns({"benchmark_product": F.lit("p"), "spearman_disagreement_vs_uncertainty": F.lit(0.1)}).where("false")
    return R.limitation_rows(d, e).select("evidence_layer", "scope", "available_result")


@query("r03_headline")
def r03(spark, sf):
    scope = V.scope_of(spark, sf)
    f = fold_rows(spark, sf)
    sizes = V.table(spark, sf, "part").groupBy(F.col("p_size").alias("cell_size_m")).agg(F.avg("p_retailprice").alias("benchmark_score"))
    cells = V.cells(spark, sf)
    return R.headline(T.compare_runs(f), sizes, Q.completeness(cells, scope), B.external_batch(cells, ["road_length", "park_area"], "building_area", scope)[1], T.ablation_summary(f))


@query(
    "r05_case_metrics",
    V.with_views("cells")
    + f"select area_id, 'c' || (cell_no % 3) source_component_id, count(*) cell_count, {r('sum(building_area)', 'total_value_full')}, {r('avg(road_length)', 'mean_value_built_form')} from cells group by 1, 2",
)
def r05(spark, sf):
    c = V.cells(spark, sf)
    members = c.select("area_id", F.concat(F.lit("c"), F.col("cell_no") % 3).alias("source_component_id"), "cell_id")
    cases = members.select("area_id", "source_component_id").distinct()
    full = c.withColumn("surface_value", F.col("building_area"))
    built = c.select("area_id", "cell_id", F.col("road_length").alias("surface_value"))
    comp = c.groupBy("area_id").agg(F.lit(1.0).alias("completeness_score"), F.lit("weak").alias("completeness_label"))
    return pick(R.case_metrics(cases, members, full, built, comp), ["area_id", "source_component_id", "cell_count"], ["total_value_full", "mean_value_built_form"])


@query(
    "r06_eval_tables",
    "select category, \"language\", count(*) questions from (select case k % 4 when 0 then 'city_overview' when 1 then 'hotspot_interpretation' when 2 then 'uncertainty_confidence' else 'compare_cities' end category, case when k % 29 = 0 then 'xx' when k % 2 = 0 then 'EN' else 'ru' end \"language\" "
    "from (select conv_id * 100 + turn k from conversations where \"role\" = 'user')) group by cube (category, \"language\")",
)
def r06(spark, sf):
    from gridspark.operators.textaudit import eval_summary

    return R.eval_tables(question_view(spark, sf), eval_summary(scored_cases(spark, sf)))[0]


@query("r07_qualitative")
def r07(spark, sf):
    surface = component_surface(spark, sf)
    scope = Scope.measured(surface.select("area_id"))
    areas = surface.select("area_id").distinct().withColumn("area_slug", F.concat(F.lit("area_"), "area_id"))
    zones = F.array(*[F.struct(F.lit(z).alias("zone_type"), F.lit(c).alias("case_id"), F.lit(s).alias("source_component_id")) for z, c, s in (("hotspot", "H1", "hotspot_01"), ("hotspot", "H2", "hotspot_02"), ("coldspot", "L1", "coldspot_01"), ("coldspot", "L2", "coldspot_02"))])
    registry_ = areas.select("area_slug", F.explode(zones).alias("_z")).select("area_slug", "_z.*").withColumns(
        {"case_title": F.lit("t"), "interpretation_label": F.lit("l"), "narrative_summary": F.lit("n"), "include_in_report": F.lit("yes")}
    )
    comp = areas.select("area_id", F.lit(70.0).alias("completeness_score"), F.lit("good").alias("completeness_label"))
    out = R.qualitative(surface, surface, registry_, areas, comp, scope=scope)
    return out["candidates"].select("area_id", "zone_type", "source_component_id", "cell_count", "direction_label")
