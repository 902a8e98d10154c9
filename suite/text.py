"""Text audit queries. Answers are derived from the documents with claim sentences in front of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import textaudit as X
from suite import views as V
from suite.registry import query, r, rnd

# eight openings that carry a claim, a negated claim, or none
OPENINGS = (
    "This cell is a verified hotspot. ",
    "This cell is not a verified hotspot. ",
    "The score is a probability of correctness; it proves the case. ",
    "Never read this as ground truth, please. ",
    "WorldPop is ground truth. ",
    "Results are definitely right and there is no uncertainty. ",
    "These are true census counts. ",
    "A plain report. ",
)


def answers(spark, sf):
    d = V.table(spark, sf, "documents")
    k = F.col("doc_id")
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (k % 8 + 1).cast("int"))
    empty = F.array().cast("array<string>")
    return d.select(
        "doc_id",
        F.lit("en").alias("language"),
        F.concat(opening, F.col("text")).alias("answer"),
        F.when(k % 5 != 0, F.array(F.lit("registry"), F.col("source"))).otherwise(empty).alias("evidence_used"),
        F.when(k % 7 != 0, F.array(F.lit("bounded reading"))).otherwise(empty).alias("claim_boundary_notes"),
        F.when(k % 11 != 0, F.when(k % 3 == 0, F.array(F.lit("coverage table"))).otherwise(empty)).alias("missing_artifacts"),
        F.when(k % 13 != 0, F.lit(True)).alias("fallback_used"),
        F.struct(
            F.lit("in short").alias("summary"), F.array(F.lit("item")).alias("evidence"), F.array(F.lit("careful")).alias("cautions"), empty.alias("next_checks")
        ).alias("structured_sections"),
    )


_ANS = (
    "select doc_id, list_extract([" + ", ".join("'" + o + "'" for o in OPENINGS) + "], (doc_id % 8 + 1)::int) || \"text\" answer, source, n from (select doc_id, \"text\", source, length(\"text\") n from documents)"
)
# ASCII form of the rules that the openings or the invented prose can trigger, per clause
_PAT = {
    "TRUE_CENSUS_RECONSTRUCTION": (r"\btrue\s+(?:cell[- ]level\s+)?census(?:\s+reconstruction|\s+counts?)?\b", 40, 5),
    "CONFIDENCE_AS_PROBABILITY": (r"\bprobability\s+of\s+correctness\b", 30, 4),
    "EXTERNAL_PRODUCTS_AS_GROUND_TRUTH": (r"\bground\s*truth\b", 30, 4),
    "VERIFIED_HOTSPOT_TRUTH": (r"\b(?:verified|true)\s+(?:population\s+)?hotspot\b", 30, 4),
    "FAKE_PRECISION_OR_OVERCONFIDENCE": (r"\b(?:definitely|proves?|guarantees?|no\s+uncertainty)\b", 18, 3),
}
_NEG = r"\b(?:not|never|without|cannot)\b"


def _hit(pat):
    return f"len(list_filter(string_split_regex(answer, '[.;:!?\\n]'), lambda c: regexp_matches(c, '(?i){pat}') and not regexp_matches(c, '(?i){_NEG}.*{pat}'))) > 0"


_SCAN = "select *, " + ", ".join(f"({_hit(p)})::int h{i}" for i, (p, _, _) in enumerate(_PAT.values())) + " from a"
_RISK = "least(100, " + " + ".join(f"h{i} * {w}" for i, (_, w, _) in enumerate(_PAT.values())) + ")"
_RANK = "greatest(1, " + ", ".join(f"h{i} * {s}" for i, (_, _, s) in enumerate(_PAT.values())) + ")"
_SEV = "list_extract(['none', 'low', 'medium', 'high', 'critical'], ({}))"
_CATS = "concat_ws(',', " + ", ".join(f"case when h{i} = 1 then '{c}' end" for i, c in enumerate(_PAT)) + ")"
_A = {"a": _ANS, "s": _SCAN}


def _w(**ctes):
    return "with " + ", ".join(f"{n} as materialized ({b})" for n, b in ctes.items()) + " "


@query("x01_scan_claims", _w(**_A) + f"select doc_id, {_CATS} categories, {_SEV.format(_RANK)} severity, {_RISK} risk_score, n + length(answer) - n checked_text_length from s")
def x01(spark, sf):
    df = X.scan_claims(answers(spark, sf), "answer")
    cats = F.array_join(F.transform("violations", lambda v: v["category"]), ",")
    return df.select("doc_id", cats.alias("categories"), "severity", "risk_score", "checked_text_length")


@query(
    "x02_scan_light",
    _w(a=_ANS)
    + r"select doc_id, concat_ws(',', case when regexp_matches(answer, '(?i)\btrue\s+(?:cell[- ]level\s+)?census\b') then 'true_census' end, case when regexp_matches(answer, '(?i)\bground\s*truth\b') then 'ground_truth' end, "
    r"case when regexp_matches(answer, '(?i)\bprobability\s+of\s+correctness\b') then 'correctness_probability' end, case when regexp_matches(answer, '(?i)\bverified\s+(?:population\s+)?hotspot\b') then 'verified_hotspot' end) labels from a",
)
def x02(spark, sf):
    return X.scan_light(answers(spark, sf), "answer").select("doc_id", F.array_join("risk_labels", ",").alias("labels"))


@query("x03_response_text", _w(a=_ANS) + "select doc_id, length(answer) + length('in short') + length('item') + length('careful') + 3 + case when doc_id % 7 <> 0 then 1 + length('bounded reading') else 0 end n from a")
def x03(spark, sf):
    df = answers(spark, sf)
    return df.select("doc_id", F.length(X.response_text(df)).cast("long").alias("n"))


_GR = (
    "select *, (doc_id % 5 = 0)::int e, (doc_id % 7 = 0)::int b, (length(trim(answer, ' ')) < 80)::int sh, (doc_id % 11 = 0)::int mn, "
    "(doc_id % 11 <> 0 and doc_id % 3 = 0 and not regexp_matches(lower(answer) || case when doc_id % 7 <> 0 then ' bounded reading' else '' end, 'missing|unavailable|partial|limited|нет|недоступ|отсутств'))::int mm from s"
)
_GSC = "100 - 40 * e - 25 * b - 20 * sh - 10 * mn - 15 * mm"


@query("x04_grounding", _w(**_A, g=_GR) + f"select doc_id, {_GSC} grounding_score, e + b + sh + mn + mm issues from g")
def x04(spark, sf):
    return X.grounding(answers(spark, sf)).select("doc_id", "grounding_score", F.size("grounding_issues").alias("issues"))


_CK = (
    f"select *, {_GSC} gs, (e + b + sh + mn + mm) > 0 ung, (doc_id % 13 = 0 or doc_id % 11 = 0) lack, {_RISK} rk, {_RANK} rn from g"
)


@query(
    "x05_check_responses",
    _w(**_A, g=_GR, k=_CK)
    + f"select doc_id, rn = 1 and not ung and not lack passed, {_SEV.format('greatest(rn, case when lack then 3 else 1 end, case when ung then 2 else 1 end)')} severity, "
    "case when ung then least(100, case when lack then least(100, rk + 20) else rk end + greatest(5, 100 - gs)) else case when lack then least(100, rk + 20) else rk end end risk_score from k",
)
def x05(spark, sf):
    return X.check_responses(answers(spark, sf)).select("doc_id", "passed", "severity", "risk_score")


_RW = {c: t for c, t in ((rule.category, rule.rewrite_en) for rule in X.CLAIM_RULES)}


@query(
    "x06_rewrite",
    _w(**_A)
    + f"select doc_id, h0 + h1 + h2 + h3 + h4 > 0 rewritten, case when h0 + h1 + h2 + h3 + h4 > 0 then concat_ws(' ', '{X.REWRITE_FRAME['en'][0]}', "
    + ", ".join(f"case when h{i} = 1 then '{_RW[c]}' end" for i, c in enumerate(_PAT))
    + f", '{X.REWRITE_FRAME['en'][1]}') else answer end safe_answer from s",
)
def x06(spark, sf):
    return X.rewrite(X.scan_claims(answers(spark, sf), "answer")).select("doc_id", "rewritten", "safe_answer")


@query("x06_guard", _w(**_A) + "select doc_id, h0 + h1 + h2 + h3 + h4 > 0 used_safe_rewrite, case when doc_id % 7 <> 0 then 1 else 0 end + case when h0 + h1 + h2 + h3 + h4 > 0 then 3 else 0 end notes from s")
def x06g(spark, sf):
    return X.guard(answers(spark, sf)).select("doc_id", "used_safe_rewrite", F.size("claim_boundary_notes").alias("notes"))


def turns(spark, sf):
    """User turns with the assistant turn that follows."""
    c = V.table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


_TURNS = "select u.conv_id, u.turn, u.\"text\" question, a.\"text\" answer from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.\"role\" = 'user' and a.\"role\" = 'assistant'"


@query(
    "x07_request_key",
    _w(t=_TURNS, h="select *, sha256('{\"area\":' || (conv_id % 25) || ',\"kind\":\"turn\"}') eh from t")
    + "select conv_id, turn, eh evidence_hash, substr(sha256('{\"city\":\"nation_' || (conv_id % 25) || '\",\"evidence_hash\":\"' || eh || '\",\"language\":\"en\",\"mode\":\"ask\",\"question\":\"q' || conv_id || ' t' || turn || '\",\"schema_version\":\"v4_cache_1\"}'), 1, 32) cache_id from h",
)
def x07(spark, sf):
    t = turns(spark, sf).withColumns({"area": F.col("conv_id") % 25, "kind": F.lit("turn")})
    h = t.withColumn("evidence_hash", X.pack_hash(t, ["area", "kind", "question"]))
    key = X.request_key(F.concat(F.lit("NATION_"), "area"), F.lit(" Ask"), F.lit("EN "), F.concat(F.lit("  Q"), "conv_id", F.lit(" ? T"), "turn"), F.col("evidence_hash"))
    return h.select("conv_id", "turn", "evidence_hash", key.alias("cache_id"))


@query(
    "x14_parse_outputs",
    _w(t=_TURNS) + "select conv_id, turn, conv_id % 5 <> 4 parse_success, case when conv_id % 5 in (0, 1, 2) then 'A' || turn end answer, case when conv_id % 5 in (0, 2) then 'high' else 'medium' end confidence_of_answer, case when conv_id % 5 in (0, 1, 2) then 2 else 0 end::int notes from t",
)
def x14(spark, sf):
    t = turns(spark, sf)
    obj = F.concat(F.lit('{"answer": " A'), F.col("turn"), F.lit('", "confidence_of_answer": "'), F.when(F.col("conv_id") % 5 == 1, "sure").otherwise("high"), F.lit('", "claim_boundary_notes": ["x", "y", "x"], "note": "a } b"}'))
    k = F.col("conv_id") % 5
    raw = (
        F.when(k == 0, obj)
        .when(k == 1, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\nbye")))
        .when(k == 2, F.concat(F.lit("Sure, "), obj, F.lit(" and {more}")))
        .when(k == 3, F.lit('{"answer": 7}'))
        .otherwise(F.lit("no json { here"))
    )
    out = X.parse_outputs(t.select("conv_id", "turn", raw.alias("raw_text")))
    return out.select("conv_id", "turn", "parse_success", "answer", "confidence_of_answer", F.size("claim_boundary_notes").alias("notes"))


def scored_cases(spark, sf):
    a = answers(spark, sf)
    k = F.col("doc_id")
    cats = F.array(*[F.lit(x) for x in ("city_overview", "hotspot_interpretation", "uncertainty_confidence", "other")])
    cases = a.withColumns(
        {
            "category": F.element_at(cats, (k % 4 + 1).cast("int")),
            "question": F.when(k % 6 == 0, F.lit("Is this ground truth?")).otherwise(F.lit("What is shown?")),
            "must_mention": F.lit("report| hotspot |"),
            "forbidden_claim_trigger": F.when(k % 9 == 0, F.lit("AUTOMATED_POLICY_DECISION")).otherwise(F.lit("")),
            "config": F.element_at(F.array(F.lit("plain"), F.lit("cached")), (k % 2 + 1).cast("int")),
            "cache_hit": k % 10 == 0,
        }
    )
    return X.score_answers(X.check_responses(cases))


_SCORED = (
    "select *, 0.6 + 0.2 * (contains(lower(answer), 'report')::int + contains(lower(answer), 'hotspot')::int) / 2.0 comp, (doc_id % 4 < 2)::int + 2 * (doc_id % 4 = 2)::int + (doc_id % 9 = 0)::int want, "
    "(doc_id % 4 = 0 and regexp_matches(lower(answer), 'not true cell-level census|not census truth|not observed census'))::int + (doc_id % 4 = 1 and regexp_matches(lower(answer), 'not verified hotspot|screening/triage|screening class'))::int "
    "+ (doc_id % 4 = 2 and regexp_matches(lower(answer), 'not true census uncertainty|proxy interval|ensemble spread'))::int + (doc_id % 4 = 2 and regexp_matches(lower(answer), 'not a probability|interpretation-confidence'))::int "
    "+ (doc_id % 9 = 0 and contains(lower(answer), 'manual review'))::int got, h0 + h1 + h2 + h3 + h4 aft, (doc_id % 6 = 0)::int bef, greatest(rn, case when lack then 3 else 1 end, case when ung then 2 else 1 end) sv from k"
)


@query(
    "x15_score_answers",
    _w(**_A, g=_GR, k=_CK, z=_SCORED)
    + "select doc_id, sv >= 3 claim_boundary_violation, sv = 5 critical_violation, doc_id % 5 <> 0 evidence_usage, round_even(comp, 4) + 0.0 answer_completeness_score, round_even(case when want > 0 then got / want else 1 end, 4) + 0.0 limitation_awareness_score, "
    "bef + aft unsafe_phrase_count from z",
)
def x15(spark, sf):
    return scored_cases(spark, sf).select("doc_id", "claim_boundary_violation", "critical_violation", "evidence_usage", "answer_completeness_score", "limitation_awareness_score", "unsafe_phrase_count")


@query(
    "x17_eval_summary",
    _w(**_A, g=_GR, k=_CK, z=_SCORED)
    + "select case when doc_id % 2 = 0 then 'plain' else 'cached' end config, count(*) question_count, round_even(avg((sv >= 3)::int), 4) + 0.0 claim_boundary_violation_rate, round_even(avg((doc_id % 5 <> 0)::int), 4) + 0.0 evidence_usage_rate, "
    "round_even(avg((doc_id % 10 = 0)::int), 4) + 0.0 cache_hit_rate, round_even(avg(gs), 4) + 0.0 grounding_score_mean, sum(bef + aft)::bigint unsafe_phrase_count_total from z group by rollup(config)",
)
def x17(spark, sf):
    return X.eval_summary(scored_cases(spark, sf)).select(
        "config", "question_count", "claim_boundary_violation_rate", "evidence_usage_rate", "cache_hit_rate", "grounding_score_mean", "unsafe_phrase_count_total"
    )
