import difflib
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import answer_rules as AR
from gridspark.operators import answers as A
from gridspark.operators import retrieval as R
from gridspark.operators import textaudit as X


def scan(spark, *texts, language="en"):
    df = spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "i int, text string, language string")
    return X.scan_claims(df).orderBy("i").collect()


def test_claims_and_negation(spark):
    out = scan(
        spark,
        "This is a true census reconstruction.",
        "It is not a true census reconstruction.",
        "It is not so. WorldPop is ground truth!",
        "confidence_score is a probability and proves it",
        "nothing here",
        None,
    )
    cats = [[v.category for v in r.violations] for r in out]
    assert cats[0] == ["TRUE_CENSUS_RECONSTRUCTION"] and out[0].severity == "critical" and out[0].risk_score == 40
    assert cats[1] == [] and cats[2] == ["EXTERNAL_PRODUCTS_AS_GROUND_TRUTH"]
    assert cats[3] == ["CONFIDENCE_AS_PROBABILITY", "FAKE_PRECISION_OR_OVERCONFIDENCE"] and out[3].risk_score == 48
    assert cats[4] == [] and out[4].passed and out[5].passed
    assert out[2].violations[0].matched_text == "WorldPop is ground truth"


def test_negation_stops_after_look_back(spark):
    far = "not " + "word " * 30 + "a verified hotspot"
    assert [len(r.violations) for r in scan(spark, far, "not " + "word " * 10 + "a verified hotspot")] == [1, 0]


def test_russian_rules(spark):
    ru = scan(spark, "Это подтверждённый hotspot.", "Это не подтверждённый hotspot.", "Данные однозначно верны", language="ru")
    assert [[v.category for v in r.violations] for r in ru] == [["VERIFIED_HOTSPOT_TRUTH"], [], ["FAKE_PRECISION_OR_OVERCONFIDENCE"]]
    assert scan(spark, "Данные однозначно верны", language="en")[0].passed


def test_request_key_is_canonical_json(spark):
    df = spark.createDataFrame([("  Al-Maty ", "ASK", "En", "What?  NOW"), ("al-maty", "ask", "en", "what now")], "a string, m string, l string, q string")
    keys = [r[0] for r in df.select(X.request_key(F.col("a"), F.col("m"), F.col("l"), F.col("q"), F.lit("h"))).collect()]
    want = {"city": "al-maty", "evidence_hash": "h", "language": "en", "mode": "ask", "question": "what now", "schema_version": "v4_cache_1"}
    assert keys[0] == keys[1] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def test_pack_hash_ignores_volatile_and_order(spark):
    a = spark.sql("select named_struct('b', 1, 'a', map('y', 2, 'x', 1)) s, 'q1' question, 5 z")
    b = spark.sql("select 5 z, 'q2' question, named_struct('a', map('x', 1, 'y', 2), 'b', 1) s")
    cols = ["s", "question", "z"]
    assert a.select(X.pack_hash(a, cols)).first() == b.select(X.pack_hash(b, cols)).first()


def test_model_json(spark):
    df = spark.createDataFrame([('{"answer":"a"}',), ('x ```json\n{"answer":"b"}\n``` y',), ('say {"answer":"c","n":{"k":1}} and } more',), ("[1]",), ("nope",), ('{"answer": 3}',)], "raw_text string")
    assert [r.answer for r in X.parse_outputs(df).collect()] == ["a", "b", "c", None, None, None]


def test_candidates_lose_no_similar_pair(spark):
    """Texts of 1 to 60 characters of a small alphabet with edits: whatever reaches the threshold is a candidate, and most pairs are not."""
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 30, 60]))) for _ in range(60)]

    def edit(t):
        out = list(t)
        for _ in range(rnd.randint(0, max(1, len(t) // 5))):
            i = rnd.randrange(len(out) + 1)
            out[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        return "".join(out) or "a"

    a = [(i % 2, f"a{i}", t) for i, t in enumerate(base)]
    b = [(i % 2, f"b{i}", edit(t)) for i, t in enumerate(base)]
    left, right = (spark.createDataFrame(x, "_ctx long, id string, text string") for x in (a, b))
    for threshold in (0.86, 0.7, 0.5):
        rare = R.gram_counts(left.unionByName(right), threshold)
        got = {(r.a, r.b) for r in R.similar_candidates(R.prefix_grams(left, rare, threshold), R.prefix_grams(right, rare, threshold), threshold).collect()}
        alike = {(i, j) for c, i, t in a for d, j, u in b if c == d and difflib.SequenceMatcher(None, t, u).ratio() >= threshold}
        assert len(alike) > 20 and alike <= got
    pairs = lambda th: R.similar_candidates(*(R.prefix_grams(x, R.gram_counts(left.unionByName(right), th), th) for x in (left, right)), th).count()
    assert pairs(0.86) < 900  # of 1,800


def test_similarity_lookup_equals_brute_force(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "cells", "surface", "interval", "share"]
    ask = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 9)))
    base = [ask() for _ in range(40)]
    good = "A long enough answer about limited evidence, for the area and its cells, with care taken."
    rows = [(q, i, "a" if i % 3 else "b") for i, q in enumerate(base)]
    new = spark.createDataFrame(rows, "question string, created_at long, area string").select(
        "question", "created_at", "area", F.lit("ask").alias("mode"), F.lit("en").alias("language"), F.lit("h").alias("evidence_hash"),
        F.lit(good).alias("answer"), F.array(F.lit("e")).alias("evidence_used"), F.array(F.lit("n")).alias("claim_boundary_notes"),
        F.array().cast("array<string>").alias("missing_artifacts"), F.lit(True).alias("fallback_used"),
        F.struct(F.lit("s").alias("summary"), F.array(F.lit("e")).alias("evidence"), F.array(F.lit("c")).alias("cautions"), F.array(F.lit("n")).alias("next_checks")).alias("structured_sections"),
    )
    new = new.withColumn("cache_id", X.request_key(F.col("area"), F.col("mode"), F.col("language"), F.col("question"), F.col("evidence_hash")))
    store = R.store_answers(new, None)
    asks = [(f"r{i}", "a" if i % 2 else "b", (base[i] if i % 4 == 0 else base[i][1:] + " x")) for i in range(40)]
    req = spark.createDataFrame(asks, "request_id string, area string, question string").select("*", F.lit("ask").alias("mode"), F.lit("en").alias("language"), F.lit("h").alias("evidence_hash"))
    got = {r.request_id: r for r in R.lookup_answers(req, store).collect()}
    held = [(r.area_norm, r.question_norm) for r in store.collect()]
    assert len(got) == 40
    for rid, area, q in asks:
        norm = " ".join(q.split())
        best = max([1.0 if norm == t else difflib.SequenceMatcher(None, norm, t).ratio() for a, t in held if a == area], default=0)
        assert got[rid].hit == (best >= 0.86)
        if got[rid].hit:
            assert got[rid].similarity == pytest.approx(best, abs=1e-4)


def test_unsafe_answers_are_not_stored(spark):
    from suite.fact import _new_answers  # noqa: F401 - the suite shares the shape

    base = spark.createDataFrame([("q", 1, "short")], "question string, created_at long, answer string").select(
        "*", F.lit("a").alias("area"), F.lit("ask").alias("mode"), F.lit("en").alias("language"), F.lit("h").alias("evidence_hash"), F.lit("k").alias("cache_id"),
        F.array(F.lit("e")).alias("evidence_used"), F.array(F.lit("n")).alias("claim_boundary_notes"), F.array().cast("array<string>").alias("missing_artifacts"),
        F.lit(True).alias("fallback_used"), F.lit(None).cast(X.SECTION_TYPE).alias("structured_sections"),
    )
    assert R.store_answers(base, None).count() == 0


def brute_retrieval(qs, docs, k, sequence=0.25):
    out = {}
    for qid, q, area in qs:
        scored = []
        for eid, title, text, _, darea, _ in docs:
            if not q or (area and darea and area != darea):
                continue
            s = f"{title} {text}".strip()
            if q in s:
                scored.append((1.0, True, eid))
                continue
            share = len(set(q.split()) & set(s.split())) / len(set(q.split()))
            ratio = difflib.SequenceMatcher(None, q, s[: max(200, len(q) * 4)]).ratio() if sequence else 0.0
            scored.append((min(0.99, (1 - sequence) * share + sequence * ratio), False, eid))
        best = sorted((v for v in scored if v[0] > 0), key=lambda v: (-v[0], not v[1], v[2]))[:k]
        if best:
            out[qid] = [(v[2], int(v[0] * 10_000 + 0.5) / 10_000, v[1]) for v in best]
    return out


@pytest.mark.parametrize("sequence", [0.25, 0.0])
@pytest.mark.parametrize("vocabulary", [10, 400, 30_000])
def test_retrieval_equals_brute_force(spark, vocabulary, sequence):
    """Few, some and many words: frequent terms alone, mixed ones, and queries that share no term with k entries."""
    rnd = random.Random(vocabulary)
    syllables = ["ce", "ll", "ar", "ea", "to", "tal", "gr", "id", "ho", "t", "sp", "ot"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5))) for _ in range(vocabulary)]
    docs = [(f"d{i}", f"t{i}", " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 2, 9, 120, 400]))), "s", None if i % 3 else "a", "c") for i in range(120)]
    qs = [(f"q{i}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))), "a" if i % 2 else None) for i in range(15)]
    qs += [("part", docs[3][2][5:60].strip(), None), ("one", "tal", None), ("two", "ot ce", "a"), ("letter", "g", None), ("none", "", None), ("odd", "zzz", None), ("b", "ce ce", "b")]
    corpus = spark.createDataFrame(docs, "entry_id string, title string, text string, source string, area string, category string")
    queries = spark.createDataFrame(qs, "query_id string, query string, area string")
    got = {}
    for r in sorted(R.retrieve(queries, corpus, 4, sequence=sequence).collect()):
        got.setdefault(r.query_id, []).append((r.position, r.entry_id, r.score, r.is_exact))
    assert {q: [v[1:] for v in sorted(x)] for q, x in got.items()} == brute_retrieval(qs, docs, 4, sequence)


def test_retrieval_of_nothing(spark):
    none = spark.createDataFrame([], "query_id string, query string, area string")
    corpus = spark.createDataFrame([("d", "t", None, "s", None, "c")], "entry_id string, title string, text string, source string, area string, category string")
    assert R.retrieve(none, corpus).count() == 0
    assert R.retrieve(spark.createDataFrame([("q", "t", None)], none.schema), corpus.where("false")).count() == 0
    assert R.retrieve(spark.createDataFrame([("q", "t", None)], none.schema), corpus).collect()[0].score == 1.0


def test_snippet(spark):
    text = "a " * 200 + "needle " + "b " * 400
    df = spark.createDataFrame([(text,)], "t string")
    out = df.select(R.snippet(F.col("t"), F.lit("the NEEDLE?"))).first()[0]
    assert out.startswith("...") and out.endswith("...") and "needle" in out and len(out) == 426


def test_rules_cover_all_kinds():
    assert set(AR.KINDS) | {"ask", "claim_checker"} == set(A.ANSWER_MODES)
    assert all([x.when for x in AR.rules_of(k, "summary")][-1] == "any" for k in AR.KINDS)
    assert {x.section for x in AR.RULES} == set(AR.SECTIONS)


def _pack(level, **parts):
    facts = {"support_level": level, "official_total": 1234567.0, "cell_count": 10, "allowed": ["Yes."], "caution": ["No."]}
    hot = {"n_priority_cells": 3, "interpretation": "Look first.", "stable_examples": [{"cell_id": "z1"}, {"cell_id": "z2"}], "caution_examples": []}
    return {"area_name": "Town", "city_summary": facts, "hotspot_summary": hot, "evidence_sources": ["registry"], **parts}


_PACK = (
    "request_id string, mode string, language string, question string, area_name string, evidence_sources array<string>, missing_artifacts array<string>, "
    "city_summary struct<support_level: string, official_total: double, cell_count: long, allowed: array<string>, caution: array<string>>, "
    "hotspot_summary struct<n_priority_cells: long, interpretation: string, stable_examples: array<struct<cell_id: string>>, caution_examples: array<struct<cell_id: string>>>, "
    "cell_evidence struct<found: boolean, requested_cell: string, p50: double, reason: string>, city_comparison struct<highest_confidence: string, highest_uncertainty: string>"
)


def _render(spark, rows):
    names = [x.name for x in spark.createDataFrame([], _PACK).schema]
    return {r.request_id: r for r in A.render_answers(spark.createDataFrame([{n: x.get(n) for n in names} for x in rows], _PACK)).collect()}


def test_sections_follow_support_and_evidence(spark):
    rows = [dict(_pack(level), request_id=f"{level}-{mode}", mode=mode, language="en", question="q") for level in ("full", "basic", "partial", "unknown") for mode in ("city_brief", "hotspot_review")]
    rows.append({"request_id": "bare", "mode": "explain_cell"})
    rows.append(dict(_pack("full"), request_id="lost", mode="city_brief", language="de", missing_artifacts=["a", "b"]))
    got = _render(spark, rows)
    full = got["full-city_brief"].answer
    assert [x for x in full.split("\n\n")][0] == "Summary:\nTown: estimates by cell come with intervals, confidence bands and screening classes."
    assert [x.split(":\n")[0] for x in full.split("\n\n")] == ["Summary", "Evidence", "Reading the classes", "Reading the intervals", "Fit to say", "Not fit to say", "Limits", "What to check next"]
    assert "- Total that the cells add up to: 1,234,567." in full and "no value of cells high" in full
    assert len(got["full-city_brief"].structured_sections.evidence) == 6 and len(got["basic-city_brief"].structured_sections.evidence) == 3
    assert len({got[f"{x}-city_brief"].structured_sections.summary for x in ("full", "basic", "partial", "unknown")}) == 4
    assert "Stable examples:\n- z1\n- z2\n\nLimits" in got["full-hotspot_review"].answer  # no caution examples, no heading
    assert got["basic-hotspot_review"].structured_sections.evidence == []
    assert got["bare"].structured_sections.summary == "This area: the cell was not found. no value"
    assert "Some evidence is missing: a, b." in got["lost"].claim_boundary_notes and "is in English" in got["lost"].answer
    assert [got[x].confidence_of_answer for x in ("full-city_brief", "basic-city_brief", "partial-city_brief", "lost")] == ["high", "medium", "low", "medium"]


def test_answers_pass_their_own_check(spark):
    cell = {"found": True, "requested_cell": "z1", "p50": 2.5, "reason": None}
    rows = [
        dict(_pack(level, cell_evidence=cell, city_comparison={"highest_confidence": "A", "highest_uncertainty": "B"}), request_id=f"{level}-{mode}-{language}", mode=mode, language=language, question="policy", missing_artifacts=["x"])
        for level in ("full", "basic", "partial", "unknown") for mode in A.ANSWER_MODES for language in ("en", "ru")
    ]
    names = [x.name for x in spark.createDataFrame([], _PACK).schema]
    out = X.check_responses(A.render_answers(spark.createDataFrame([{n: x.get(n) for n in names} for x in rows], _PACK)))
    assert [(r.request_id, r.violations, r.grounding_issues) for r in out.where("not passed").collect()] == []


def test_close_texts_lose_no_similar_pair(spark):
    """Whatever reaches the threshold is left by lengths, characters and subsequences, each pair once; most other pairs are not, and no
    pair is made by more than one key."""
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh é\U00010400") for _ in range(rnd.choice([1, 2, 5, 13, 63, 64, 65, 130, 300]))) for _ in range(80)]

    def edit(t):
        out = list(t)
        for _ in range(rnd.randint(0, max(1, len(t) // 6))):
            i = rnd.randrange(len(out) + 1)
            out[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        return "".join(out) or "a"

    a = [(str(i % 2), f"a{i}", t) for i, t in enumerate(base)]
    b = [(str(i % 2), f"b{i}", edit(t)) for i, t in enumerate(base)]
    left, right = (spark.createDataFrame(x, "_ctx string, id string, text string") for x in (a, b))
    for threshold in (0.86, 0.6):
        rows = R.close_texts(left, right, threshold).collect()
        got = {(r.a, r.b) for r in rows}
        alike = {(i, j): v for c, i, t in a for d, j, u in b if c == d and (v := difflib.SequenceMatcher(None, t, u).ratio()) >= threshold}
        assert len(alike) > 20 and set(alike) <= got and len(got) == len(rows)
        most = R._matchable([r.asked for r in rows], [r.stored for r in rows])
        for r, m in zip(rows, most):
            assert 2 * m >= alike.get((r.a, r.b), 0) * (len(r.asked) + len(r.stored)) - 1e-9
    assert len(R.close_texts(left, right, 0.86).collect()) < 1600  # of 3,200


def test_a_long_run_of_pairs_is_scored_where_it_is_met(spark):
    """F2: nothing between the join of the texts and their scores is shuffled or made distinct, so pairs take no disk."""
    left = spark.createDataFrame([("c", f"a{i}", f"which cells are meant by number {i}") for i in range(300)], "_ctx string, id string, text string")
    right = left.withColumn("id", F.concat(F.lit("b"), "id"))
    scored = R.close_texts(left, right, 0.86).mapInPandas(R._best_pairs(0.86), "request_id string, cache_id string, similarity double")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Aggregate" not in plan.split("Join")[0]
    assert "Exchange" not in plan.split("Join")[0]
    best = scored.groupBy("request_id").agg(F.max_by("cache_id", "similarity").alias("b")).collect()
    assert all(r.b == "b" + r.request_id for r in best) and len(best) == 300
