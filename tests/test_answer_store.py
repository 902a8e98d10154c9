"""The store on disk: last write wins, repeats change nothing, untouched buckets keep their files."""

from pathlib import Path

import pytest

from gridspark.operators import answer_store as ST

SCHEMA = "cache_id string, created_at long, answer string"


def _files(path):
    return {str(x.relative_to(path)): x.stat().st_mtime_ns for x in Path(path).rglob("*.parquet")}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    held = lambda: sorted((r.cache_id, r.created_at, r.answer) for r in ST.read_store(spark, path).collect())
    assert ST.read_store(spark, path) is None
    assert ST.upsert(make([]), path, 8) == 0
    first = [(f"k{i}", 1, "a") for i in range(40)] + [("k0", 1, "b"), ("k1", 0, "old"), (None, 1, "no key")]
    assert ST.upsert(make(first), path, 8) == 8
    want = sorted([("k0", 1, "b")] + [(f"k{i}", 1, "a") for i in range(1, 40)])
    assert held() == want
    before = _files(path)
    assert ST.upsert(make(first), path, 8) == 0 and _files(path) == before
    assert ST.upsert(make([("k5", 0, "late")]), path, 8) == 0 and held() == want  # older than what is held
    assert ST.upsert(make([("k5", 2, None), ("k6", 1, "a")]), path, 8) == 1
    after = _files(path)
    folders = {x.split("/")[0] for x in set(before.items()) ^ set(after.items()) for x in [x[0]]}
    assert len(folders) == 1
    assert held() == sorted([x for x in want if x[0] != "k5"] + [("k5", 2, None)], key=str)  # noqa: C414


def test_other_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    ST.upsert(spark.createDataFrame([("k", 1, "a")], SCHEMA), path, 4)
    with pytest.raises(ValueError, match="columns"):
        ST.upsert(spark.createDataFrame([("k", 1, "a", "x")], SCHEMA + ", more string"), path, 4)


def test_a_batch_is_answered_once(spark):
    """What reads a batch reads a table: neither store entries nor scores render templates and check them again."""
    from gridspark.operators import answers as A

    row = ("r1", 1, "a", "Area", "city_brief", "en", "What is shown?", "h", ["registry"], [], ("full",))
    schema = "request_id string, area_id long, area string, area_name string, mode string, language string, question string, evidence_hash string, evidence_sources array<string>, missing_artifacts array<string>, city_summary struct<support_level:string>"
    answered = A.answer_batch(spark.createDataFrame([row], schema))
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Relation" in plan
    assert [(r.request_id, r.provider_used) for r in answered.collect()] == [("r1", "fallback")]


def test_only_open_requests_are_rendered(spark, monkeypatch):
    """Requests that the store or a safe output answers get no template; a null request is none."""
    from gridspark.operators import answers as A

    schema = "request_id string, area_id long, area string, area_name string, mode string, language string, question string, evidence_hash string, evidence_sources array<string>, missing_artifacts array<string>, city_summary struct<support_level:string>"
    row = lambda i: (i, 1, "a", "Area", "city_brief", "en", f"What is shown by {i}?", "h", ["registry"], [], ("full",))
    packs = spark.createDataFrame([row("r1"), row("r2"), row("r3"), row(None)], schema)
    first = A.answer_batch(packs.where("request_id = 'r1'"))
    from pyspark.sql import functions as F

    store = ST.batch_entries(first, packs, F.lit(1))
    text = '{"answer": "A bounded reading of limited evidence for the area; values are proxy estimates and need manual review before use.", "claim_boundary_notes": ["limited"]}'
    outputs = spark.createDataFrame([("r2", text)], "request_id string, raw_text string")
    rendered, render = [], A.render_answers
    monkeypatch.setattr(A, "render_answers", lambda df: rendered.extend(r.request_id for r in df.collect()) or render(df))
    monkeypatch.setattr(A, "lookup_answers", lambda requests, held: _exact(requests, held))
    got = {r.request_id: r.provider_used for r in A.answer_batch(packs, store, outputs).collect()}
    assert got == {"r1": "cache", "r2": "model", "r3": "fallback"}
    assert sorted(rendered, key=str) == ["r3"] or sorted(rendered, key=str) == [None, "r3"]


def _exact(requests, held):
    from pyspark.sql import functions as F

    from gridspark.functions.scalars import norm_question

    asked = requests.select("request_id", norm_question(F.col("question")).alias("question_norm"))
    fields = ["answer", "evidence_used", "claim_boundary_notes", "missing_artifacts", "structured_sections", "fallback_used"]
    return asked.join(held, "question_norm").select("request_id", *fields, F.lit(True).alias("hit"), F.lit("exact").alias("match_type"), F.lit(1.0).alias("similarity"))


def test_evaluation_sends_no_table_to_the_driver(spark, monkeypatch):
    """Neither answers nor requests are broadcast, however small their files are."""
    from pyspark.sql import functions as F

    from gridspark.operators import answers as A

    fields = "question_id string, area_id long, mode string, language string, question string, category string, must_mention string, forbidden_claim_trigger string"
    cases = spark.createDataFrame([(f"q{i}", 1, "city_brief", "en", f"What is shown by {i}?", "brief", "", "") for i in range(4)], fields)
    more = {
        "area": F.lit("a"),
        "area_name": F.lit("Area"),
        "evidence_hash": F.lit("h"),
        "evidence_sources": F.array(F.lit("registry")),
        "missing_artifacts": F.array().cast("array<string>"),
        "city_summary": F.struct(F.lit("full").alias("support_level")),
    }
    packs_of = lambda asked: asked.withColumns(more)
    even = packs_of(cases.where("question_id in ('q0', 'q2')").withColumn("request_id", F.col("question_id")))
    store = A.materialize(ST.batch_entries(A.answer_batch(even), even, F.lit(1)))
    text = '{"answer": "A bounded reading of limited evidence for the area; values are proxy estimates and need manual review before use.", "claim_boundary_notes": ["limited"]}'
    outputs = spark.createDataFrame([("q0", text), ("q1", text)], "question_id string, raw_text string")
    plans, write = [], A.materialize
    plan_of = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(A, "materialize", lambda df: plans.append(plan_of(df)) or write(df))
    monkeypatch.setattr(A, "lookup_answers", lambda requests, held: write(_exact(requests, held)))
    scored = A.run_eval(cases, packs_of, store=store, outputs=outputs)
    joins = [line.strip()[:90] for plan in [*plans, plan_of(scored)] for line in plan.splitlines() if "Join" in line]
    assert len(joins) >= 8 and [x for x in joins if "Broadcast" in x] == []
    got = sorted((r["config"], r["provider_used"]) for r in scored.collect())
    assert got == sorted(
        [("fallback_only", "fallback")] * 4
        + [("model_with_fallback", "model")] * 2
        + [("model_with_fallback", "fallback")] * 2
        + [("fallback_with_cache", "cache")] * 2
        + [("fallback_with_cache", "fallback")] * 2
        + [("claim_checker_only", "fallback")] * 4
    )


def test_lookup_sends_no_table_to_the_driver(spark):
    """Only the grid of blocks, a few numbers a context and band, may be broadcast."""
    from pyspark.sql import functions as F

    from gridspark.operators import retrieval as R

    context = {"area": F.lit("a"), "mode": F.lit("ask"), "language": F.lit("en"), "evidence_hash": F.lit("h")}
    asked = spark.range(4).select(F.col("id").cast("string").alias("request_id"), F.format_string("what is shown by the map %s", "id").alias("question")).withColumns(context)
    store = spark.range(2).select(
        F.format_string("k%s", "id").alias("cache_id"),
        F.lit(1).alias("created_at"),
        F.lit("a").alias("area_norm"),
        *[F.lit(v).alias(n) for n, v in (("mode", "ask"), ("language", "en"), ("evidence_hash", "h"))],
        F.format_string("what is shown by the map %s", "id").alias("question_norm"),
        F.lit("A bounded reading of limited evidence.").alias("answer"),
        *[F.array(F.lit("x")).alias(n) for n in ("evidence_used", "claim_boundary_notes", "missing_artifacts")],
        F.struct(F.lit("s").alias("summary"), *[F.array(F.lit("e")).alias(n) for n in ("evidence", "cautions", "next_checks")]).alias("structured_sections"),
        F.lit(True).alias("fallback_used"),
    )
    plan = R.lookup_answers(asked, store).where("hit")._jdf.queryExecution().sparkPlan().toString()
    joins = [line.strip() for line in plan.splitlines() if "Join" in line]
    assert len(joins) >= 6 and [x for x in joins if "Broadcast" in x and "band#" not in x] == []


def test_cases_meet_the_figures_of_their_area_without_being_sent(spark, monkeypatch):
    from suite import answers_q as Q

    seen = []
    monkeypatch.setattr(Q.A, "answer_batch", lambda packs: seen.append(packs))
    monkeypatch.setattr(Q.ST, "batch_entries", lambda *_: None)
    monkeypatch.setattr(Q.A, "run_eval", lambda *_, **__: spark.createDataFrame([], "config string, provider_used string, passed boolean"))
    Q.x16(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "area_id" in first and "BuildRight" in first
