"""Fact, retrieval and answer queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.operators import answers as A
from gridspark.operators import facts as L
from gridspark.operators import hotspots as H
from gridspark.operators import retrieval as R
from gridspark.operators import stats as B
from gridspark.operators import textaudit as X
from gridspark.operators import uncertainty as U
from gridspark.scope import Scope, materialize
from suite import views as V
from suite.qual import question_view
from suite.registry import pick, query, r, rnd, rs
from suite.text import OPENINGS, turns

_ONE = Scope()  # nothing measured


def _n(spark, sf):
    return V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), F.col("n_name").alias("area_name"))


def registry(spark, sf):
    """Registry without areas 20 and above; every seventh area has no features."""
    n = _n(spark, sf)
    return n.where("area_id < 20").withColumn("feature_generated", F.when(F.col("area_id") % 7 == 0, "False").otherwise("true"))


def support(spark, sf, summary):
    names = _n(spark, sf).select("area_id").unionByName(spark.range(90, 92).select(F.col("id").alias("area_id")))
    return L.support_level(names, registry(spark, sf), V.totals(spark, sf), summary.where("area_id % 3 = 0"), scope=_ONE)


def facts_of(spark, sf):
    """Fact tables of all areas, from one interval surface."""
    scope = V.scope_of(spark, sf)
    iv = materialize(V.interval(spark, sf, scope))
    summary = U.interval_summary(iv, scope)
    sup = support(spark, sf, summary)
    city = L.city_facts(sup, summary.where("area_id % 3 = 0"), _ONE)
    hot = L.hotspot_facts(sup, H.hotspot_summary(iv, scope), iv, 5, _ONE)
    return {"iv": iv, "summary": summary, "support": sup, "city": city, "hot": hot, "scope": scope}


_SUP = (
    "select a area_id, case when a % 3 = 0 and a < 90 then 'full' when a >= 90 then 'unknown' when a < 20 and a % 7 = 0 then 'partial' else 'basic' end support_level from "
    "(select n_nationkey::bigint a from nation union all select unnest([90, 91])::bigint)"
)


@query("l01_support_level", _SUP)
def l01(spark, sf):
    return support(spark, sf, V.totals(spark, sf)).select("area_id", "support_level")


@query(
    "l02_city_facts",
    V.with_views("iv", extra={"s": _SUP})
    + f"select s.area_id, support_level, {r('any_value(t.official_total)', 'official_total')}, case when support_level = 'full' then count(cell_id) end cell_count, case when support_level = 'full' then {r('median(relative_uncertainty)', 'x').replace(' as x', '')} end median_relative_uncertainty, "
    "case support_level when 'full' then 2 when 'partial' then 2 else 1 end cautions, concat_ws(',', case when s.area_id < 20 then 'registry' end, case when s.area_id < 90 then 'totals' end, case when support_level = 'full' then 'interval_summary' end) sources "
    "from s left join totals t using (area_id) left join iv using (area_id) group by 1, 2",
)
def l02(spark, sf):
    f = facts_of(spark, sf)["city"]
    return f.select(
        "area_id",
        "support_level",
        rnd("official_total").alias("official_total"),
        "cell_count",
        rnd("median_relative_uncertainty").alias("median_relative_uncertainty"),
        F.size("caution").alias("cautions"),
        F.array_join("evidence_sources", ",").alias("sources"),
    )


@query(
    "l03_hotspot_facts",
    V.with_views("iv", extra={"p": "select *, row_number() over (partition by area_id order by hotspot_rank, cell_id) k from iv where hotspot_priority_class <> 'not_priority'"})
    + "select n_nationkey::bigint area_id, (select string_agg(cell_id, ',' order by k) from p where p.area_id = n_nationkey and k <= 5) top_cells, "
    "(select count(*) from p where p.area_id = n_nationkey and hotspot_priority_class in ('high_value_high_confidence', 'medium_value_high_confidence')) stable_hotspot_cells from nation union all select unnest([90, 91]), null, 0",
)
def l03(spark, sf):
    f = facts_of(spark, sf)["hot"]
    cells = F.array_join(F.transform("top_hotspots", lambda s: s["cell_id"]), ",")
    return f.select("area_id", F.when(cells != "", cells).alias("top_cells"), "stable_hotspot_cells")


@query(
    "l04_confidence_facts",
    V.with_views("iv")
    + f"select area_id, {r('coalesce(count(*) filter (confidence_band = ' + chr(39) + 'medium' + chr(39) + ')::double / count(*), 0)', 'medium')}, count(distinct confidence_band) bands from iv group by 1 union all select unnest([90, 91]), 0, null",
)
def l04(spark, sf):
    f = facts_of(spark, sf)
    bands = B.band_validation(f["iv"].withColumn("absolute_error_p50", F.lit(0.0)), f["scope"])
    out = L.confidence_facts(f["city"], bands, _ONE)
    return out.select("area_id", rnd(F.coalesce("medium_share", F.lit(0.0))).alias("medium"), F.size(F.map_keys("bands")).cast("long").alias("bands"))


@query(
    "l05_uncertainty_facts",
    V.with_views("diag", extra={"s": _SUP})
    + f"select d.area_id, {r('avg((weak_target between p10 and p90)::int)', 'coverage')}, {r('corr(absolute_error_p50, uncertainty_width)', 'pearson')}, "
    "concat_ws(',', case when d.area_id < 20 then 'registry' end, 'totals', case when any_value(support_level) = 'full' then 'interval_summary' end, 'interval_coverage', 'error_alignment') sources from diag d join s using (area_id) group by 1 union all select unnest([90, 91]), null, null, ''",
)
def l05(spark, sf):
    f = facts_of(spark, sf)
    scope = f["scope"]
    diag = V.diagnostics(spark, sf, scope)
    out = L.uncertainty_facts(f["city"], B.interval_coverage(diag, "proxy", scope), B.error_alignment(diag, "proxy", scope), None, None, _ONE)
    return out.select(
        "area_id",
        rnd("weak_target_interval_coverage").alias("coverage"),
        rnd("error_width_alignment.pearson").alias("pearson"),
        F.array_join("evidence_sources", ",").alias("sources"),
    )


@query(
    "l06_cell_facts",
    V.with_views("iv", extra={"s": _SUP, "q": "select c_custkey k, case when c_custkey % 2 = 0 then c_nationkey else (c_nationkey + 3) % 25 end::bigint area_id, 'Z' || c_custkey cell_id from customer"})
    + f"select k request_id, q.area_id, support_level = 'full' and p50 is not null found, case when support_level = 'full' and p50 is not null then {r('p50', 'x').replace(' as x', '')} end p50 from q join s using (area_id) left join iv using (area_id, cell_id)",
)
def l06(spark, sf):
    scope = V.scope_of(spark, sf)
    iv = V.interval(spark, sf, scope)
    c = V.table(spark, sf, "customer")
    home = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise((F.col("c_nationkey") + 3) % 25).cast("long")
    asked = c.select(F.col("c_custkey").alias("request_id"), home.alias("area_id"), F.concat(F.lit(" z"), "c_custkey").alias("requested_cell"))
    out = L.cell_facts(asked, support(spark, sf, V.totals(spark, sf)), iv, Scope(("area_id",), ("request_id",), 27))
    return out.select("request_id", "area_id", "found", F.when(F.col("found"), rnd("p50")).alias("p50"))


@query(
    "l07_compare_areas",
    V.with_views("iv", extra={"g": "select area_id, median(relative_uncertainty) u, avg((confidence_band = 'high')::int) h from iv where area_id % 3 = 0 group by 1"})
    + "select (select max('NATION_' || area_id) from g where h = (select max(h) from g)) highest_confidence, (select max('NATION_' || area_id) from g where u = (select max(u) from g)) highest_uncertainty",
)
def l07(spark, sf):
    f = facts_of(spark, sf)
    return L.compare_areas(f["city"], f["hot"], _ONE)[1]


def requests(spark, sf):
    t = turns(spark, sf)
    k = F.col("conv_id")
    modes = F.array(*[F.lit(m) for m in ("ask", "city_brief", "explain_cell", "hotspot_review", "claim_checker", "reviewer_safe", "compare_cities", "uncertainty_summary")])
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        (k % 25).cast("long").alias("area_id"),
        F.element_at(modes, (k % 8 + 1).cast("int")).alias("mode"),
        F.when(k % 3 == 0, "ru").otherwise("en").alias("language"),
        F.concat(F.when(k % 2 == 0, "Which hotspot cell Z").otherwise("What is the confidence of Z"), (k * 7).cast("string"), F.lit("? "), "question").alias("question"),
    )


def packs_of(spark, sf, f=None):
    f = f or facts_of(spark, sf)
    scope = f["scope"]
    conf = L.confidence_facts(f["city"], B.band_validation(f["iv"].withColumn("absolute_error_p50", F.lit(0.0)), scope), _ONE)
    unc = f["city"].select("area_id", "area_name", "support_level", "median_relative_uncertainty", "mean_uncertainty_width", "evidence_sources")
    leaders = L.compare_areas(f["city"], f["hot"], _ONE)[1]

    def build(req):
        return L.evidence_pack(req, f["city"], f["hot"], conf, unc, f["iv"], leaders, ("proxy evidence only",), _ONE)

    return build


@query(
    "l09_evidence_pack",
    "with t as (select u.conv_id k, u.turn from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.\"role\" = 'user' and a.\"role\" = 'assistant') "
    "select k || '-' || turn request_id, case k % 8 when 0 then 'ask' when 1 then 'city_brief' when 2 then 'explain_cell' when 3 then 'hotspot_review' when 4 then 'claim_checker' when 5 then 'reviewer_safe' when 6 then 'compare_cities' else 'ask' end \"mode\", "
    "k % 8 not in (2, 4, 6) has_hotspots, k % 8 = 2 has_cell, k % 8 = 6 has_comparison from t",
)
def l09(spark, sf):
    p = packs_of(spark, sf)(requests(spark, sf))
    return p.select(
        "request_id",
        "mode",
        F.col("hotspot_summary").isNotNull().alias("has_hotspots"),
        F.col("cell_evidence").isNotNull().alias("has_cell"),
        F.col("city_comparison").isNotNull().alias("has_comparison"),
    )


@query("l10_compact_pack")
def l10(spark, sf):
    return L.compact_pack(packs_of(spark, sf)(requests(spark, sf))).select("request_id", "character_count", "approximate_tokens", "size_warning")


@query("l11_render_answers")
def l11(spark, sf):
    p = packs_of(spark, sf)(requests(spark, sf))
    return A.render_answers(p).select("request_id", "mode", "answer_kind", "language", "answer", "confidence_of_answer")


@query(
    "l12_route",
    "select doc_id, case when regexp_matches(lower(\"text\"), 'uncertainty|p10|p50|p90|интервал|неопредел') then 'uncertainty_summary' when regexp_matches(lower(\"text\"), 'confidence|уверен|довер') then 'confidence_summary' "
    "when regexp_matches(lower(\"text\"), 'hotspot|priority|приоритет|горяч') then 'hotspot_review' else 'city_brief' end kind from (select doc_id, case doc_id % 4 when 0 then 'hotspot ' when 1 then 'Confidence ' when 2 then 'P90 ' else '' end || \"text\" \"text\" from documents)",
)
def l12(spark, sf):
    d = V.table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    t = F.concat(F.when(k == 0, "hotspot ").when(k == 1, "Confidence ").when(k == 2, "P90 ").otherwise(""), F.col("text"))
    return d.select("doc_id", L.route(t).alias("kind"))


def _new_answers(spark, sf):
    """Assistant turns offered to the store: some lack evidence, some carry claims, some are written twice."""
    t = turns(spark, sf)
    k = F.col("conv_id")
    base = t.select(
        (k % 25).cast("string").alias("area"),
        F.lit("ask").alias("mode"),
        F.lit("en").alias("language"),
        "question",
        F.lit("h0").alias("evidence_hash"),
        F.expr("cast(conv_id * 100 + turn as bigint)").alias("created_at"),
        F.concat(F.when(k % 9 == 0, F.lit(OPENINGS[0])).otherwise(F.lit("")), "answer", F.lit(" " * 3 + "limited evidence " * 6)).alias("answer"),
        F.when(k % 5 != 0, F.array(F.lit("registry"))).otherwise(F.array().cast("array<string>")).alias("evidence_used"),
        F.array(F.lit("bounded")).alias("claim_boundary_notes"),
        F.array().cast("array<string>").alias("missing_artifacts"),
        F.lit(True).alias("fallback_used"),
        F.struct(F.lit("s").alias("summary"), F.array(F.lit("e")).alias("evidence"), F.array(F.lit("c")).alias("cautions"), F.array(F.lit("n")).alias("next_checks")).alias("structured_sections"),
    )
    again = base.withColumns({"created_at": F.col("created_at") + 1_000_000, "answer": F.concat(F.col("answer"), F.lit(" (again)"))})
    both = base.unionByName(again.where("created_at % 2 = 0"))
    return both.withColumn("cache_id", X.request_key(F.col("area"), F.col("mode"), F.col("language"), F.col("question"), F.col("evidence_hash")))


@query("x08_store_answers")
def x08(spark, sf):
    return R.store_answers(_new_answers(spark, sf), None).select("cache_id", "created_at", "area_norm", "question_norm", "answer")


@query("x09_lookup_answers")
def x09(spark, sf):
    store = R.store_answers(_new_answers(spark, sf), None)
    t = turns(spark, sf)
    q = F.when(F.col("turn") % 4 == 0, F.col("question")).otherwise(F.concat(F.substring("question", 3, 100000), F.lit(" ok")))
    req = t.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        (F.col("conv_id") % 25).cast("string").alias("area"),
        F.lit("ask").alias("mode"),
        F.lit("en").alias("language"),
        q.alias("question"),
        F.lit("h0").alias("evidence_hash"),
    )
    return R.lookup_answers(req, store).select("request_id", "hit", "match_type", "similarity", "cache_id")


def document_corpus(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("doc-"), "doc_id").alias("entry_id"),
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        "text",
        "source",
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("NATION_"), F.col("doc_id") % 25)).alias("area"),
        F.lit("document").alias("category"),
    )


def corpus_of(spark, sf):
    docs = document_corpus(spark, sf)
    t = V.totals(spark, sf)
    facts = t.select(
        F.concat(F.lit("city-"), "area_id").alias("entry_id"),
        F.concat("area_name", F.lit(" evidence summary")).alias("title"),
        F.lit("totals").alias("source"),
        F.col("area_name").alias("area"),
        F.lit("city_summary").alias("category"),
        "official_total",
    )
    return R.build_corpus(facts, docs)


@query(
    "x10_build_corpus",
    V.with_views("totals")
    + "select 'doc-' || doc_id entry_id, length(trim(regexp_replace(\"text\", '\\s+', ' ', 'g')))::bigint n, 'document' category from documents union all select 'city-' || area_id, length('{\"official_total\":}') + length(printf('%d.0', official_total::bigint)) - 0, 'city_summary' from totals where official_total < 1e7 "
    "union all select 'city-' || area_id, null, 'city_summary' from totals where official_total >= 1e7",
)
def x10(spark, sf):
    c = corpus_of(spark, sf)
    t = V.totals(spark, sf).select(F.concat(F.lit("city-"), "area_id").alias("entry_id"), (F.col("official_total") >= 1e7).alias("_big"))
    return c.join(t, "entry_id", "left").select("entry_id", F.when(~F.coalesce("_big", F.lit(False)), F.length("text").cast("long")).alias("n"), "category")


def query_view(spark, sf):
    b = V.table(spark, sf, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("NATION_"), F.col("item_id") % 25)).alias("area")
    )


@query("x11_retrieve")
def x11(spark, sf):
    return R.retrieve(query_view(spark, sf), corpus_of(spark, sf), 5).select("query_id", "entry_id", "position", "score", "is_exact")


OVERLAP_SQL = r"""
    with c as (
        select 'doc-' || doc_id as entry_id, case when doc_id % 10 = 0 then 'nation_' || doc_id % 25 else '' end as area,
               trim(regexp_replace(lower('Document ' || doc_id || ' ' || text), '[^\p{L}\p{N}_\-/]+', ' ', 'g')) as s from documents
    ), q as (
        select item_id::varchar as query_id, case when item_id % 4 = 0 then 'nation_' || item_id % 25 else '' end as area,
               trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\-/]+', ' ', 'g')) as t from benchmark
    ), ct as (select distinct entry_id, area, unnest(string_split(s, ' ')) as term from c),
    qt as (select distinct query_id, area, unnest(string_split(t, ' ')) as term from q),
    size as (select query_id, count(*) as n from qt group by 1),
    overlap as (
        select query_id, entry_id, least(0.99, count(*) / any_value(n)::double) as score
        from qt join ct using (term) join size using (query_id) where qt.area = '' or ct.area = '' or qt.area = ct.area group by 1, 2
    ), exact as (select query_id, entry_id from q join c on contains(s, t) where q.area = '' or c.area = '' or q.area = c.area),
    scored as (
        select query_id, entry_id, case when e.query_id is not null then 1.0 else score end as score, e.query_id is not null as is_exact
        from overlap full join exact as e using (query_id, entry_id)
    ), placed as (select *, row_number() over (partition by query_id order by score desc, is_exact desc, entry_id) as position from scored)
    select query_id, entry_id, position, round(score, 4) + 0.0 as score, is_exact from placed where position <= 5
"""


@query("x11_overlap", OVERLAP_SQL)
def x11_overlap(spark, sf):
    """The part of the search that SQL can say: overlap and exact substrings, through the same postings and bounds."""
    found = R.retrieve(query_view(spark, sf), R.build_corpus(None, document_corpus(spark, sf)), 5, sequence=0.0)
    return found.select("query_id", "entry_id", "position", rnd("score").alias("score"), "is_exact")


@query(
    "x12_snippet",
    "with d as (select doc_id, trim(regexp_replace(\"text\", '\\s+', ' ', 'g')) t from documents), p as (select *, least(nullif(strpos(lower(t), 'the'), 0), nullif(strpos(lower(t), 'que'), 0)) f from d), "
    "s as (select *, greatest(coalesce(f, 1) - 1 - 80, 0) st from p) select doc_id, case when length(t) <= 420 then t else case when st > 0 then '...' else '' end || substr(t, st + 1, 420) || case when st + 420 < length(t) then '...' else '' end end snippet from s",
)
def x12(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", R.snippet(F.col("text"), F.lit("The la QUE?")).alias("snippet"))


@query("x13_augment")
def x13(spark, sf):
    q, c = query_view(spark, sf), corpus_of(spark, sf)
    out = R.augment(q, R.retrieve(q, c, 3), c)
    return out.select("query_id", F.size("retrieved_snippets").alias("snippets"), F.array_join("retrieval_sources", ",").alias("sources"))


@query("x16_run_eval")
def x16(spark, sf):
    cases = question_view(spark, sf).where("trim(question_id) <> '' and question <> ''")
    first = Window.partitionBy("question_id").orderBy("question", F.xxhash64(*cases.columns))
    cases = cases.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    cases = cases.withColumns({"area_id": F.pmod(F.xxhash64("question_id"), F.lit(25)), "language": F.lower("language")})
    return A.run_eval(cases, packs_of(spark, sf)).select("question_id", "config", "severity", "answer_completeness_score", "limitation_awareness_score", "unsafe_phrase_count")


@query("x18_answer_batch")
def x18(spark, sf):
    p = packs_of(spark, sf)(requests(spark, sf))
    p = materialize(p.withColumns({"area": F.col("area_id").cast("string"), "evidence_hash": F.lit("h0")}))  # read by the batch and the outputs
    outputs = p.where("area_id % 4 = 1").select("request_id", F.lit('{"answer": "A bounded reading of limited evidence for the area; values are proxy estimates and need manual review before use.", "claim_boundary_notes": ["limited"]}').alias("raw_text"))
    store = R.store_answers(_new_answers(spark, sf), None)
    return A.answer_batch(p, store, outputs).select("request_id", "provider_used", "cache_hit", "passed", "severity", "answer")
