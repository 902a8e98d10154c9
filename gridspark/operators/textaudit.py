"""Text audit: claim-rule scan, grounding, response checks, safe rewrite, hashes, JSON outputs, scoring.

Everything here is a row-wise column expression: a scan over any number of texts has no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.geometry import let
from gridspark.functions.scalars import norm_question
from gridspark.operators.claim_rules import CLAIM_RULES, LIGHT_RULES, LOOK_BACK, NEGATION_WORDS, SEVERITIES, ClaimRule

FLAGS = "(?iuU)"


def _guarded(pattern: str) -> str:
    """Pattern that does not match when a negation word stands before it in the clause, within the look-back.

    The look-ahead comes first, so that the look-behind runs only where the pattern matches.
    """
    before = "|".join(rf"\b{w}\b[^.;:!?\n]{{0,{LOOK_BACK - len(w)}}}" for w in NEGATION_WORDS)
    return f"(?={pattern})(?<!{before}){pattern}"


def _any(patterns: Sequence[str], guard: bool) -> str:
    return FLAGS + "(?:" + "|".join(_guarded(p) if guard else p for p in patterns) + ")"


def _first_match(text: Column, patterns: Sequence[str]) -> Column:
    """First unnegated match of the first pattern that has one."""
    hits = [F.regexp_extract(text, FLAGS + _guarded(p), 0) for p in patterns]
    return F.coalesce(*[F.when(h != "", h) for h in hits])


def language_of(c: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit("en"))))
    return F.when(v.isin("en", "ru"), v).otherwise(F.lit("en"))


def _severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)


def _severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def violations_of(text: Column, language: Column, rules: Sequence[ClaimRule] = CLAIM_RULES) -> Column:
    """Array of violations in rule order, one per category. Russian texts are scanned with both pattern lists."""
    value, lang = F.coalesce(text, F.lit("")), language_of(language)
    russian = lang == "ru"

    def hit(rule: ClaimRule, low: Column) -> Column:
        possible = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in rule.needs]) if rule.needs else F.lit(True)
        found = F.when(
            possible, F.when(russian, _first_match(value, rule.en + rule.ru)).otherwise(_first_match(value, rule.en))
        )
        row = lambda m: F.struct(
            F.lit(rule.category).alias("category"),
            m.alias("matched_text"),
            F.when(russian, rule.safe_ru).otherwise(rule.safe_en).alias("safe_alternative"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.weight).alias("weight"),
        )
        # the match is computed once: rows for the non-null match only
        return F.transform(F.filter(F.array(found), lambda m: m.isNotNull()), row)

    # lower case once per text; the literal test spares most texts every regular expression
    folded = F.translate(F.lower(value), "ſ", "s")
    return let(folded, lambda low: F.flatten(F.array(*[hit(r, low) for r in rules])))


def scan_claims(docs: DataFrame, text: str = "text", language: str | None = "language", rules: Sequence[ClaimRule] = CLAIM_RULES) -> DataFrame:
    """X01. Violations, maximum severity, risk score and pass flag per text."""
    lang = F.col(language) if language else F.lit("en")
    # a generator, so that later filters on the verdict do not pull the scan down and run it twice
    found = F.inline(F.array(F.struct(violations_of(F.col(text), lang, rules).alias("violations"))))
    scanned = docs.drop("violations").select("*", found)
    v = F.col("violations")
    worst = F.coalesce(F.array_max(F.transform(v, lambda x: _severity_rank(x["severity"]))), F.lit(1))
    risk = F.aggregate(v, F.lit(0), lambda acc, x: acc + x["weight"])
    return scanned.withColumns(
        {
            "passed": F.size(v) == 0,
            "severity": _severity_name(worst),
            "risk_score": F.least(risk, F.lit(100)),
            "checked_text_length": F.length(F.coalesce(F.col(text), F.lit(""))),
        }
    )


def scan_light(docs: DataFrame, text: str = "text") -> DataFrame:
    """X02. Labels of the light phrase check; no negation, all patterns in every language."""
    value = F.coalesce(F.col(text), F.lit(""))
    labels = F.array_compact(
        F.array(*[F.when(value.rlike(_any(p, False)), F.lit(label)) for label, p in LIGHT_RULES.items()])
    )
    return docs.withColumn("risk_labels", labels).withColumn("has_risk", F.size("risk_labels") > 0)


SECTION_TYPE = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("cautions", T.ArrayType(T.StringType())),
        T.StructField("next_checks", T.ArrayType(T.StringType())),
    ]
)
RESPONSE_FIELDS = ("answer", "structured_sections", "claim_boundary_notes", "evidence_used", "fallback_used", "missing_artifacts")


def _lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def response_text(df: DataFrame) -> Column:
    """X03. All text of a response: answer, sections, notes, and the text under review when present."""
    s = F.col("structured_sections")
    parts = [F.col("answer"), s["summary"], _lines(s["evidence"]), _lines(s["cautions"]), _lines(s["next_checks"]), _lines(F.col("claim_boundary_notes"))]
    parts += [F.col(c) for c in ("safe_rewrite", "claim_text_under_review") if c in df.columns]
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


# Answers too generic to count, and words that surface missing items.
GENERIC_ANSWERS = ("i do not know", "no information", "unknown")
MISSING_WORDS = ("missing", "unavailable", "partial", "limited", "нет", "недоступ", "отсутств")


def grounding(df: DataFrame) -> DataFrame:
    """X04. Grounding score 0 to 100 with the issue list."""
    answer = F.trim(F.coalesce("answer", F.lit("")))
    empty = lambda c: F.coalesce(F.size(F.col(c)) <= 0, F.lit(True))
    surfaced = F.lower(F.concat_ws(" ", answer, F.array_join(F.coalesce("claim_boundary_notes", F.array().cast("array<string>")), " ")))
    mentions = reduce(lambda a, b: a | b, [surfaced.contains(w) for w in MISSING_WORDS])
    missing = F.col("missing_artifacts")
    rules = [
        (empty("evidence_used"), 40, "evidence_used is missing or empty."),
        (empty("claim_boundary_notes"), 25, "claim_boundary_notes is missing or empty."),
        (
            (F.length(answer) < 80) | F.lower(answer).isin(*GENERIC_ANSWERS),
            20,
            "The answer is too short or generic to demonstrate evidence-grounded interpretation.",
        ),
        (missing.isNull(), 10, "missing_artifacts is not surfaced as a response field."),
        (
            F.coalesce(F.size(missing) > 0, F.lit(False)) & ~mentions,
            15,
            "Non-empty missing_artifacts are not surfaced in the answer or boundary notes.",
        ),
    ]
    lost = reduce(lambda a, b: a + b, [F.when(c, points).otherwise(0) for c, points, _ in rules])
    issues = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, _, text in rules]))
    return df.withColumns({"grounding_issues": issues, "grounding_score": F.greatest(F.lit(0), F.lit(100) - lost)}).withColumn(
        "grounded", F.size("grounding_issues") == 0
    )


def check_responses(df: DataFrame, language: str = "language") -> DataFrame:
    """X05. Claim scan of the whole response text, required fields and grounding in one verdict."""
    absent = [f for f in RESPONSE_FIELDS if f not in df.columns]
    full = df.withColumns({f: F.lit(None).cast(_FIELD_TYPES[f]) for f in absent})
    text = full.withColumn("_text", response_text(full))
    scanned = grounding(scan_claims(text, "_text", language if language in df.columns else None))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in RESPONSE_FIELDS]))
    lacking = F.size("missing_required_fields") > 0
    rank = F.greatest(
        _severity_rank(F.col("severity")), F.when(lacking, 3).otherwise(1), F.when(~F.col("grounded"), 2).otherwise(1)
    )
    first = F.when(lacking, F.least(F.col("risk_score") + 20, F.lit(100))).otherwise(F.col("risk_score"))
    risk = F.when(
        ~F.col("grounded"), F.least(first + F.greatest(F.lit(5), F.lit(100) - F.col("grounding_score")), F.lit(100))
    ).otherwise(first)
    return (
        scanned.withColumn("missing_required_fields", missing)
        .withColumns(
            {
                "_severity": _severity_name(rank),
                "risk_score": risk,
                "passed": F.col("passed") & ~lacking & F.col("grounded"),
                "response_has_required_fields": ~lacking,
                "evidence_used_present": F.coalesce(F.size("evidence_used") > 0, F.lit(False)),
            }
        )
        .drop("severity", "_text")
        .withColumnRenamed("_severity", "severity")
    )


_FIELD_TYPES = {
    "answer": "string",
    "structured_sections": SECTION_TYPE.simpleString(),
    "claim_boundary_notes": "array<string>",
    "evidence_used": "array<string>",
    "fallback_used": "boolean",
    "missing_artifacts": "array<string>",
}

# Frame sentences of a safe rewrite.
REWRITE_FRAME = {
    "en": (
        "The framework provides a calibrated proxy population surface and uncertainty-aware interpretation from frozen evidence.",
        "Manual review is recommended before practical use.",
        "Unsafe wording was replaced with conservative terminology.",
    ),
    "ru": (
        "Система предоставляет calibrated proxy population surface и uncertainty-aware interpretation на основе frozen evidence.",
        "Требуется ручная проверка перед практическим использованием.",
        "Unsafe wording replaced with conservative Russian/technical terminology.",
    ),
}


def rewrite(df: DataFrame, answer: str = "answer", language: str = "language") -> DataFrame:
    """X06. Safe answer built from the violated categories; untouched texts pass through."""
    lang = language_of(F.col(language)) if language in df.columns else F.lit("en")
    table = F.create_map(
        *[
            F.lit(x)
            for r in CLAIM_RULES
            for x in (f"en:{r.category}", r.rewrite_en, f"ru:{r.category}", r.rewrite_ru)
        ]
    )
    cats = F.array_distinct(F.transform("violations", lambda v: v["category"]))
    say = lambda i: F.when(lang == "ru", REWRITE_FRAME["ru"][i]).otherwise(REWRITE_FRAME["en"][i])
    lines = F.concat(F.array(say(0)), F.transform(cats, lambda c: table[F.concat(lang, F.lit(":"), c)]), F.array(say(1)))
    unsafe = F.size("violations") > 0
    note = F.concat(F.lit("Rewritten categories: "), F.array_join(cats, ", "))
    return df.withColumns(
        {
            "rewritten": unsafe,
            "safe_answer": F.when(unsafe, F.array_join(lines, " ")).otherwise(F.coalesce(F.col(answer), F.lit(""))),
            "rewrite_notes": F.when(unsafe, F.array(say(2), note)).otherwise(F.array().cast("array<string>")),
        }
    )


def guard(df: DataFrame, language: str = "language", auto_rewrite: bool = True) -> DataFrame:
    """X06 on whole responses: check, rewrite unsafe answers, extend the notes and sections."""
    checked = rewrite(check_responses(df, language), "answer", language)
    if not auto_rewrite:
        return checked.withColumn("used_safe_rewrite", F.lit(False))
    use = F.col("rewritten")
    warning = F.concat(F.lit("Guardrail applied a safe rewrite; severity="), F.col("severity"), F.lit("."))
    notes = F.array_distinct(
        F.concat(F.coalesce("claim_boundary_notes", F.array().cast("array<string>")), F.array(warning), F.col("rewrite_notes"))
    )
    fixed = checked.withColumn("_notes", F.when(use, notes).otherwise(F.col("claim_boundary_notes")))
    s = F.col("structured_sections")
    sections = F.struct(
        F.col("safe_answer").alias("summary"), s["evidence"].alias("evidence"), F.col("_notes").alias("cautions"), s["next_checks"].alias("next_checks")
    )
    return fixed.withColumns(
        {
            "answer": F.when(use, F.col("safe_answer")).otherwise(F.col("answer")),
            "structured_sections": F.when(use & s.isNotNull(), sections).otherwise(s),
            "claim_boundary_notes": F.col("_notes"),
            "used_safe_rewrite": use,
        }
    ).drop("_notes")


# Pack keys left out of the hash, and the store's schema version.
VOLATILE_KEYS = (
    "question",
    "token_saving_note",
    "retrieved_snippets",
    "retrieval_sources",
    "retrieval_note",
    "cache_hit",
    "cache_metadata",
)
STORE_VERSION = "v4_cache_1"


def _canonical(c: Column, dtype: T.DataType, drop: Sequence[str]) -> Column:
    """Same value with struct fields and map keys in name order, volatile keys removed, NaN as null."""
    if isinstance(dtype, T.StructType):
        kept = sorted((f for f in dtype.fields if f.name not in drop), key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_canonical(c[f.name], f.dataType, drop).alias(f.name) for f in kept]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, dtype.elementType, drop))
    if isinstance(dtype, T.MapType):
        entries = F.filter(F.map_entries(c), lambda e: ~e["key"].isin(*drop))
        clean = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], dtype.valueType, drop).alias("value")))
        return F.map_from_entries(F.array_sort(clean))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c


def pack_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """X07. SHA-256 of the canonical JSON of the named columns, volatile keys ignored."""
    fields = sorted((f for f in df.schema.fields if f.name in set(columns) - set(VOLATILE_KEYS)), key=lambda f: f.name)
    packed = F.struct(*[_canonical(F.col(f.name), f.dataType, VOLATILE_KEYS).alias(f.name) for f in fields])
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def request_key(area: Column, mode: Column, language: Column, question: Column, evidence_hash: Column) -> Column:
    """X07. 32-character key of a request; case and spacing variants agree."""
    low = lambda c, default: F.lower(F.trim(F.when(c != "", c).otherwise(F.lit(default))))
    identity = F.struct(
        norm_question(area).alias("city"),
        evidence_hash.alias("evidence_hash"),
        low(language, "en").alias("language"),
        low(mode, "ask").alias("mode"),
        norm_question(question).alias("question"),
        F.lit(STORE_VERSION).alias("schema_version"),
    )
    return F.substring(F.sha2(F.to_json(identity), 256), 1, 32)


#: Strings, braces, and what is between them.
JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}]|[^"{}]++|"'


def parse_outputs(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """X14. JSON object of a model output: plain, fenced, or embedded in text; fields normalised.

    Candidates are tried in order: fenced block, whole text, then what stands from the first brace to the one that
    balances it outside of strings (what a streaming decoder would return): found in one pass over the tokens, parsed
    once. Parsing uses the VARIANT type.
    """
    value = F.trim(F.coalesce(F.col(raw), F.lit("")))
    fenced = F.regexp_extract(value, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    start = F.instr(value, "{")
    tokens = F.regexp_extract_all(F.substring(value, start, F.length(value)), F.lit(JSON_TOKEN), F.lit(0))

    def step(acc, token):
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        open_still = (acc["size"] == 0) | (acc["depth"] > 0)
        return F.struct(
            F.when(open_still, depth).otherwise(acc["depth"]).alias("depth"),
            F.when(open_still, acc["size"] + F.length(token)).otherwise(acc["size"]).alias("size"),
        )

    walked = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size")), step)
    parses = lambda s: F.try_parse_json(s).isNotNull() & F.startswith(F.trim(s), F.lit("{"))
    balanced = F.element_at(F.transform(F.array(walked), lambda w: F.when(w["depth"] == 0, F.substring(value, start, w["size"]))), 1)
    embedded = F.element_at(F.transform(F.array(balanced), lambda b: F.when(parses(b), b)), 1)
    text = F.coalesce(
        F.when((fenced != "") & parses(fenced), fenced),
        F.when(parses(value), value),
        F.when((start > 0) & ~parses(value), embedded),
    )
    v = F.try_parse_json(F.col("_json"))
    is_text = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    string = lambda path: F.when(is_text(path), F.try_variant_get(v, path, "string"))
    strings = lambda path: F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
    answer = F.trim(string("$.answer"))
    conf = string("$.confidence_of_answer")
    sections = F.struct(
        F.coalesce(string("$.structured_sections.summary"), answer).alias("summary"),
        strings("$.structured_sections.evidence").alias("evidence"),
        strings("$.structured_sections.cautions").alias("cautions"),
        strings("$.structured_sections.next_checks").alias("next_checks"),
    )
    return (
        df.withColumn("_json", text)
        .withColumns(
            {
                "parse_success": F.col("_json").isNotNull(),
                "answer": F.when(answer != "", answer),
                "confidence_of_answer": F.when(conf.isin("high", "medium", "low"), conf).otherwise(F.lit("medium")),
                "structured_sections": sections,
                "claim_boundary_notes": F.array_distinct(strings("$.claim_boundary_notes")),
                "recommended_next_checks": F.array_distinct(strings("$.recommended_next_checks")),
            }
        )
        .drop("_json")
    )


# Limitation phrases and the categories or triggers that call for them.
LIMITATION_PHRASES = {
    "census": ("not true cell-level census", "not census truth", "not observed census", "не census truth", "не восстанавливает"),
    "uncertainty": ("not true census uncertainty", "proxy interval", "proxy-интервал", "ensemble spread"),
    "confidence": ("not a probability", "не probability", "interpretation-confidence"),
    "hotspot": ("not verified hotspot", "screening/triage", "screening class", "не verified"),
    "manual_review": ("manual review", "ручной провер"),
    "external": ("structural comparator", "not ground truth", "не ground truth"),
    "llm_role": ("does not change", "does not improve", "не изменяет", "evidence interpretation"),
}
CENSUS_CATEGORIES = ("city_overview", "limitation_boundary", "method_explanation", "partial_city_support", "compare_cities")


def _expected(category: Column, trigger: Column) -> dict[str, Column]:
    has = lambda word: F.coalesce(trigger.contains(word), F.lit(False))
    return {
        "census": category.isin(*CENSUS_CATEGORIES) | has("CENSUS"),
        "uncertainty": (category == "uncertainty_confidence") | has("TRUE_UNCERTAINTY"),
        "confidence": (category == "uncertainty_confidence") | has("CONFIDENCE_AS_PROBABILITY"),
        "hotspot": (category == "hotspot_interpretation") | has("VERIFIED_HOTSPOT"),
        "manual_review": has("AUTOMATED_POLICY"),
        "external": has("EXTERNAL_PRODUCTS"),
        "llm_role": has("LLM_IMPROVES"),
    }


def score_answers(df: DataFrame) -> DataFrame:
    """X15. Scores of answered cases: violations, evidence use, completeness, limitation awareness, sizes.

    Rows carry the question fields, the response fields, and the verdict of ``check_responses`` or
    ``guard`` (``severity, risk_score, grounding_score``).
    """
    answer = F.coalesce("answer", F.lit(""))
    lower = F.lower(answer)
    s = F.col("structured_sections")
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    section = (
        F.when(F.coalesce(s["summary"] != "", F.lit(False)), 0.2).otherwise(0.0)
        + F.when(full(s["evidence"]), 0.2).otherwise(0.0)
        + F.when(full(s["cautions"]), 0.2).otherwise(0.0)
        + F.when(full(s["next_checks"]), 0.2).otherwise(0.0)
    )
    terms = F.filter(F.transform(F.split(F.coalesce("must_mention", F.lit("")), r"\|"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    hits = F.size(F.filter(terms, lambda t: lower.contains(t)))
    mention = F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(1.0))
    expected = _expected(F.coalesce("category", F.lit("")), F.coalesce("forbidden_claim_trigger", F.lit("")))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    wanted = reduce(lambda a, b: a + b, [one(c) for c in expected.values()])
    said = lambda n: reduce(lambda a, b: a | b, [lower.contains(p) for p in LIMITATION_PHRASES[n]])
    covered = reduce(lambda a, b: a + b, [one(c & said(n)) for n, c in expected.items()])
    awareness = F.when(wanted > 0, covered / wanted).otherwise(F.lit(1.0))
    lang = F.col("language")
    return df.withColumns(
        {
            "claim_boundary_violation": F.col("severity").isin("medium", "high", "critical"),
            "critical_violation": F.col("severity") == "critical",
            "evidence_usage": full(F.col("evidence_used")),
            "missing_artifact": full(F.col("missing_artifacts")),
            "answer_completeness_score": F.bround(F.least(F.lit(1.0), section + 0.2 * mention), 4),
            "limitation_awareness_score": F.bround(awareness.cast("double"), 4),
            "unsafe_phrase_count_before": F.size(violations_of(F.col("question"), lang)),
            "unsafe_phrase_count_after": F.size(violations_of(answer, lang)),
            "answer_character_count": F.length(answer),
            "evidence_source_count": F.greatest(F.coalesce(F.size("evidence_used"), F.lit(0)), F.lit(0)),
        }
    ).withColumn("unsafe_phrase_count", F.col("unsafe_phrase_count_before") + F.col("unsafe_phrase_count_after"))


def eval_summary(scored: DataFrame) -> DataFrame:
    """X17. Rates and means per configuration, and overall (null configuration), by one rollup."""
    rate = lambda c: F.bround(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 4).alias(f"{c}_rate")
    mean = lambda c, n=4: F.bround(F.avg(c), n).alias(f"{c}_mean")
    have = set(scored.columns)
    rates = [c for c in ("claim_boundary_violation", "critical_violation", "evidence_usage", "fallback_used", "cache_hit", "missing_artifact") if c in have]
    means = {"grounding_score": 4, "answer_completeness_score": 4, "limitation_awareness_score": 4, "latency_seconds": 6, "answer_character_count": 2, "evidence_packet_character_count": 2}
    sums = [c for c in ("unsafe_phrase_count", "unsafe_phrase_count_after") if c in have]
    return scored.rollup("config").agg(
        F.count(F.lit(1)).alias("question_count"),
        *[rate(c) for c in rates],
        *[mean(c, n) for c, n in means.items() if c in have],
        *[F.sum(c).cast("long").alias(f"{c}_total") for c in sums],
    )
