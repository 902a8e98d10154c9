"""Template answers over packs made of customers per nation and conversation turns, with a statement from the same rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gridspark.operators import answer_rules as R
from gridspark.operators import answer_store as ST
from gridspark.operators import answers as A
from gridspark.storage import new_folder
from suite import views as V
from suite.registry import query

MODES = tuple(m for m in A.ANSWER_MODES if m != "claim_checker")
LANGUAGES = ("en", "ru", "de")
SEGMENTS = {"n_priority_cells": "BUILDING", "n_high_value_high_confidence": "MACHINERY", "n_high_value_low_confidence": "FURNITURE", "n_medium_value_high_confidence": "HOUSEHOLD", "n_low_value_high_uncertainty": "AUTOMOBILE"}
SHARES = {"high_share": "c_acctbal > 6000", "medium_share": "c_acctbal between 1000 and 6000", "low_share": "c_acctbal < 1000"}


def _share(test: str) -> str:
    return f"floor(1000.0 * count(case when {test} then 1 end) / count(*)) / 1000.0"


#: Path in the pack -> expression that Spark and DuckDB read alike, over customers grouped by nation.
NUMBERS = {
    "city_summary.official_total": "sum(cast(floor(c_acctbal) as bigint))",
    "city_summary.cell_count": "count(*)",
    "city_summary.median_relative_uncertainty": _share("c_acctbal < 0"),
    **{f"hotspot_summary.{name}": f"count(case when c_mktsegment = '{value}' then 1 end)" for name, value in SEGMENTS.items()},
    "hotspot_summary.stable_hotspot_cells": "count(case when c_acctbal > 9000 then 1 end)",
    "hotspot_summary.caution_hotspot_cells": "count(case when c_acctbal < -900 then 1 end)",
    **{f"confidence_summary.{name}": _share(test) for name, test in SHARES.items()},
    "uncertainty_summary.median_relative_uncertainty": _share("c_acctbal < 500"),
    "uncertainty_summary.median_interval_width": "floor(max(c_acctbal))",
    "uncertainty_summary.weak_target_interval_coverage": _share("c_acctbal > 100"),
    "uncertainty_summary.error_width_alignment.pearson": _share("c_acctbal > 2000"),
    "uncertainty_summary.error_width_alignment.spearman": _share("c_acctbal > 3000"),
}
CELL = {"p10": "turn", "p50": "turn + 0.5", "p90": "turn + 1.25", "relative_uncertainty": "0.375", "confidence_score": "conv_id % 100"}


def _flat(path: str) -> str:
    return path.replace(".", "__")


def answer_packs(spark, sf):
    """One pack per conversation turn; the area's figures come from the customers of a nation."""
    c = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(
        *[F.expr(e).alias(_flat(p)) for p, e in NUMBERS.items()],
        F.array_sort(F.collect_set("c_mktsegment")).alias("allowed"),  # five segments
        F.array(F.min("c_custkey"), F.max("c_custkey")).cast("array<string>").alias("ends"),
    )
    n = V.table(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("n_nationkey")
    part = lambda name, *more: F.struct(*[F.col(_flat(p)).alias(p.split(".")[1]) for p in NUMBERS if p.startswith(name + ".") and p.count(".") == 1], *more).alias(name)
    level = F.when(k % 5 < 2, "full").when(k % 5 == 2, "basic").when(k % 5 == 3, "partial").otherwise("unknown")
    alignment = F.struct(*[F.col(f"uncertainty_summary__error_width_alignment__{x}").alias(x) for x in ("pearson", "spearman")])
    areas = n.select(
        k.alias("area_id"),
        F.col("n_name").alias("area_name"),
        part("city_summary", level.alias("support_level"), F.col("allowed"), F.when(k % 2 == 0, F.array("n_name")).alias("caution")),
        part(
            "hotspot_summary",
            F.when(k % 3 > 0, F.concat(F.lit("Classes of "), "n_name")).alias("interpretation"),
            F.transform("ends", lambda x: F.struct(x.alias("cell_id"))).alias("stable_examples"),
            F.when(k % 2 == 0, F.transform("ends", lambda x: F.struct(x.alias("cell_id")))).alias("caution_examples"),
        ),
        part("confidence_summary"),
        part("uncertainty_summary", F.when(k % 3 > 0, alignment).alias("error_width_alignment")),
        F.when(k % 2 == 0, F.struct(F.col("n_name").alias("highest_confidence"), F.col("n_name").alias("highest_uncertainty"))).alias("city_comparison"),
    )
    i, found = F.col("conv_id"), F.col("turn") % 2 == 0
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    cell = F.struct(
        found.alias("found"),
        F.concat(F.lit("z"), i).alias("requested_cell"),
        *[F.when(found, F.expr(e).cast("double")).alias(name) for name, e in CELL.items()],
        F.when(found, "high").alias("confidence_band"),
        F.when(found, "not_priority").alias("hotspot_priority_class"),
        F.when(~found, "No such cell.").alias("reason"),
    )
    t = V.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        (i % 25).alias("area_id"),
        pick(MODES).alias("mode"),
        pick(LANGUAGES).alias("language"),
        F.col("text").alias("question"),
        cell.alias("cell_evidence"),
        F.when(i % 4 == 0, F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.array().cast("array<string>")).alias("missing_artifacts"),
        F.array(F.lit("registry")).alias("evidence_sources"),
    )
    return t.join(areas, "area_id")


# ------------------------------------------------------------------------------------------------ the statement

SOME = {
    "any": "true",
    **{x: f"lvl = '{x}'" for x in ("full", "basic", "partial")},
    "limited": "lvl <> 'full'",
    "found": "found",
    "not_found": "not found",
    "compared": "n_nationkey % 2 = 0",
    "not_compared": "n_nationkey % 2 <> 0",
    "aligned": "lvl = 'full' and n_nationkey % 3 > 0",
    "policy": "regexp_matches(question, '" + "|".join(R.POLICY_WORDS) + "')",
    "missing": "conv_id % 4 = 0",
    "other_language": "asked = 'de'",
}
TEXTS = {
    "city_summary.support_level": "lvl",
    "hotspot_summary.interpretation": "case when n_nationkey % 3 > 0 then 'Classes of ' || n_name end",
    "city_comparison.highest_confidence": "n_name",
    "city_comparison.highest_uncertainty": "n_name",
    "cell_evidence.requested_cell": "'z' || conv_id",
    "cell_evidence.confidence_band": "case when found then 'high' end",
    "cell_evidence.hotspot_priority_class": "case when found then 'not_priority' end",
    "cell_evidence.reason": "case when not found then 'No such cell.' end",
}
LISTS = {
    "city_summary.allowed": "allowed",
    "city_summary.caution": "case when n_nationkey % 2 = 0 then [n_name] else []::varchar[] end",
    "hotspot_summary.stable_examples.cell_id": "ends",
    "hotspot_summary.caution_examples.cell_id": "case when n_nationkey % 2 = 0 then ends else []::varchar[] end",
    "missing_artifacts": "case when conv_id % 4 = 0 then ['m1', 'm2'] else []::varchar[] end",
}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _text_sql(template: str, language: str) -> str:
    none, parts = _quote(R.NO_VALUE[language]), []
    for piece in re.split(r"(\{[^}]*\}|\[[^\]]*\])", template):
        path = piece[1:-1].rstrip("%$")
        number = _flat(path) if path in NUMBERS else f"case when found then {CELL.get(path.split('.')[-1])} end"
        if not piece:
            continue
        if piece == "{area}":
            parts.append("n_name")
        elif piece[0] == "[":
            parts.append(f"array_to_string({LISTS[path]}, ', ')")
        elif piece[0] != "{":
            parts.append(_quote(piece))
        elif piece[-2] == "$":
            parts.append(f"coalesce({TEXTS[path]}, {none})")
        elif piece[-2] == "%":
            parts.append(f"coalesce(printf('%.1f%%', ({number})::double * 100), {none})")
        else:
            v = f"({number})::double"
            parts.append(f"case when {v} is null then {none} when {v} = floor({v}) then format('{{:,}}', {v}::bigint) else printf('%.3f', {v}) end")
    return "(" + " || ".join(parts) + ")"


def _block_sql(kind: str, section: str, language: str) -> str:
    items = []
    for rule in R.rules_of(kind, section):
        text = rule.text(language)
        whole = re.fullmatch(r"\[[^\]]*\]", text)
        items.append(f"case when {SOME[rule.when]} then {LISTS[text[1:-1]] if whole else '[' + _text_sql(text, language) + ']'} else []::varchar[] end")
    if not items:
        return "null"
    joined = f"array_to_string(flatten([{', '.join(items)}]), chr(10) || '- ')"
    return f"{_quote(R.SECTIONS[section][language])} || ':' || chr(10) || '- ' || nullif({joined}, '')"


def _answer_sql() -> str:
    branches = []
    for kind in R.KINDS:
        for language in ("en", "ru"):
            summary = "case " + " ".join(f"when {SOME[x.when]} then {_text_sql(x.text(language), language)}" for x in R.rules_of(kind, "summary")) + " end"
            head = f"{_quote(R.SECTIONS['summary'][language])} || ':' || chr(10) || {summary}"
            blocks = ", ".join(_block_sql(kind, x, language) for x in R.SECTIONS if x != "summary")
            branches.append(f"when kind = '{kind}' and lang = '{language}' then concat_ws(chr(10) || chr(10), {head}, {blocks})")
    return "case " + " ".join(branches) + " end"


_STATEMENT = (
    "with c as (select c_nationkey, " + ", ".join(f"{e} as {_flat(p)}" for p, e in NUMBERS.items()) + ", "
    "list_sort(list(distinct c_mktsegment)) as allowed, [min(c_custkey)::varchar, max(c_custkey)::varchar] as ends from customer group by 1), "
    "t as (select conv_id, turn, lower(coalesce(\"text\", '')) question, turn % 2 = 0 found, "
    + f"[{', '.join(_quote(m) for m in MODES)}][conv_id % {len(MODES)} + 1] as mode, [{', '.join(_quote(x) for x in LANGUAGES)}][conv_id % {len(LANGUAGES)} + 1] as asked from conversations), "
    "p as (select *, case when asked = 'ru' then 'ru' else 'en' end lang, case when n_nationkey % 5 < 2 then 'full' when n_nationkey % 5 = 2 then 'basic' when n_nationkey % 5 = 3 then 'partial' else 'unknown' end lvl, "
    "case when mode <> 'ask' then mode when regexp_matches(question, 'uncertainty|p10|p50|p90|интервал|неопредел') then 'uncertainty_summary' when regexp_matches(question, 'confidence|уверен|довер') then 'confidence_summary' "
    "when regexp_matches(question, 'hotspot|priority|приоритет|горяч') then 'hotspot_review' else 'city_brief' end kind from t join nation on n_nationkey = conv_id % 25 join c on c_nationkey = n_nationkey) "
    "select conv_id || '-' || turn request_id, mode, kind answer_kind, lang \"language\", " + _answer_sql() + " answer, "
    "case when lvl in ('unknown', 'partial') then 'low' when conv_id % 4 = 0 or lvl = 'basic' or kind in ('uncertainty_summary', 'compare_cities', 'reviewer_safe') then 'medium' else 'high' end confidence_of_answer from p"
)


@query("l11_answer_text", _STATEMENT)
def l11(spark, sf):
    return A.render_answers(answer_packs(spark, sf)).select("request_id", "mode", "answer_kind", "language", "answer", "confidence_of_answer")


@query(
    "x08_upsert_store",
    "with e as (select conv_id || '-' || turn % 3 cache_id, turn * 2 + (case when \"role\" = 'user' then 1 else 0 end) created_at, coalesce(\"text\", '') answer, \"role\" said from conversations) "
    "select cache_id, max(created_at) created_at, arg_max(answer, (created_at, answer)) answer, count(distinct said) speakers from e group by cache_id",
)
def x08(spark, sf):
    """Two batches go to the store, then the first one again; what each key holds at last."""
    e = V.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn") % 3).alias("cache_id"),
        (F.col("turn") * 2 + (F.col("role") == "user").cast("int")).alias("created_at"),
        F.coalesce("text", F.lit("")).alias("answer"),
        F.col("role").alias("said"),
    )
    path = new_folder(spark, "answers")
    for batch in (e.where("said = 'user'"), e.where("not said <=> 'user'"), e.where("said = 'user'")):
        ST.upsert(batch.drop("said"), path, 16)
    speakers = e.groupBy("cache_id").agg(F.count_distinct("said").alias("speakers"))
    return ST.read_store(spark, path).join(speakers, "cache_id")


@query(
    "x18_write_back",
    "select " + f"[{', '.join(_quote(m) for m in MODES)}][conv_id % {len(MODES)} + 1] as mode, count(distinct (conv_id % 25, conv_id % 3, lower(trim(regexp_replace(coalesce(\"text\", ''), '\\s+', ' ', 'g'))))) entries, 0::bigint asked_again_missed "
    "from conversations where conv_id % 25 in (select c_nationkey from customer) group by 1",
)
def x18(spark, sf):
    """Answers of all turns go to the store; asked again, every question is found there."""
    p = answer_packs(spark, sf).withColumns({"area": F.col("area_id").cast("string"), "evidence_hash": F.concat_ws("-", F.lit("h"), F.col("language")), "at": F.length("request_id")})
    path = new_folder(spark, "answers")
    ST.upsert(ST.batch_entries(A.answer_batch(p), p, F.col("at")), path, 16)
    store = ST.read_store(spark, path)
    exact = A.answer_batch(p, store)
    missed = exact.groupBy("mode").agg(F.count_if(~F.col("cache_hit")).alias("asked_again_missed"))
    return store.groupBy("mode").agg(F.count(F.lit(1)).alias("entries")).join(missed, "mode")


OUTPUT = '{"answer": "A bounded reading of limited evidence for the area; values are proxy estimates and need manual review before use.", "claim_boundary_notes": ["limited"]}'


@query(
    "x16_configurations",
    "with k as (select conv_id, any_value(conv_id % 25) a from conversations where conv_id % 25 in (select c_nationkey from customer) group by 1), "
    "c as (select * from (values ('fallback_only'), ('model_with_fallback'), ('fallback_with_cache'), ('claim_checker_only')) t(config)) "
    "select config, case when config = 'fallback_with_cache' and conv_id % 2 = 0 then 'cache' when config = 'model_with_fallback' and conv_id % 3 = 0 then 'model' else 'fallback' end provider_used, "
    "count(*) cases, count(*) passed from k, c group by 1, 2",
)
def x16(spark, sf):
    """One case per conversation in four configurations: the store knows even ones, a model answered every third."""
    one = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    cases = one.where(F.col("turn").isNotNull()).select(
        F.col("conv_id").cast("string").alias("question_id"),
        (F.col("conv_id") % 25).alias("area_id"),
        F.lit("city_brief").alias("mode"),
        F.lit("en").alias("language"),
        F.md5(F.col("conv_id").cast("string")).alias("question"),  # no two are alike
        F.lit("brief").alias("category"),
        F.lit("").alias("must_mention"),
        F.lit("").alias("forbidden_claim_trigger"),
    )
    known = answer_packs(spark, sf).groupBy("area_id").agg(*[F.first(c).alias(c) for c in ("area_name", "city_summary", "hotspot_summary", "confidence_summary", "uncertainty_summary")])
    extra = {"area": F.col("area_id").cast("string"), "evidence_hash": F.lit("h"), "missing_artifacts": F.array().cast("array<string>"), "evidence_sources": F.array(F.lit("registry"))}
    packs_of = lambda asked: asked.join(F.broadcast(known), "area_id").withColumns(extra)  # one row per nation
    even = packs_of(cases.where("cast(question_id as bigint) % 2 = 0").withColumn("request_id", F.col("question_id")))
    store = ST.batch_entries(A.answer_batch(even), even, F.lit(1))
    outputs = cases.where("cast(question_id as bigint) % 3 = 0").select("question_id", F.lit(OUTPUT).alias("raw_text"))
    scored = A.run_eval(cases, packs_of, store=store, outputs=outputs)
    return scored.groupBy("config", "provider_used").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))
