import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.contracts import MODEL_FEATURES
from gridspark.functions import scalars as N
from gridspark.operators import hotspots as H
from gridspark.operators import quality as Q
from gridspark.operators import scaling as S
from gridspark.operators import stats as B
from gridspark.operators import training as T
from gridspark.operators import uncertainty as U
from gridspark.scope import AREA, Scope
from gridspark.sources import tables as IO


def one(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_minmax_constant_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0), (1, "b", 2.0, 5.0), (1, "c", 3.0, 5.0)], "area_id long, cell_id string, a double, b double")
    out = S.minmax(df, ["a", "b"]).orderBy("cell_id").collect()
    assert [r.a_scaled for r in out] == [0.0, 0.5, 1.0] and {r.b_scaled for r in out} == {0.0}
    assert set(one(S.combined_index(df, ["nope"]), "combined_index")) == {0.0}


@pytest.mark.parametrize("measured", [True, False])
def test_allocation_and_calibration_conserve(spark, measured):
    rows = [(a, f"c{i}", float(i * a + 1), float(i % 3), 100.0 * a) for a in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "area_id long, cell_id string, total_floor_area double, building_count double, official_total double")
    scope = Scope.measured(df) if measured else AREA
    sums = S.allocate(df, scope=scope).groupBy("area_id").agg(F.sum("weak_target"), F.sum("weak_share")).collect()
    for r in sums:
        assert abs(r[1] - 100.0 * r[0]) < 1e-6 and abs(r[2] - 1) < 1e-9
    cal = S.calibrate(df.withColumn("p", F.lit(-1.0)), "p", "official_total", scope).groupBy("area_id").agg(F.sum("calibrated")).collect()
    assert all(abs(r[1] - 100.0 * r[0]) < 1e-6 for r in cal)


def test_calibration_fixture(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 30.0), (1, "b", 2.0, 30.0), (2, "c", 3.0, 70.0), (2, "d", 4.0, 70.0)], "area_id long, cell_id string, p double, t double")
    out = {r.cell_id: r.calibrated for r in S.calibrate(df, "p", "t").collect()}
    assert out["a"] == pytest.approx(10) and out["b"] == pytest.approx(20) and out["c"] == pytest.approx(30) and out["d"] == pytest.approx(40)


def test_seeds_and_bands(spark):
    assert one(U.member_seeds(spark, 42, 3).orderBy("member_id"), "seed") == [42, 1051, 2060]
    df = spark.createDataFrame([(1, "a", 0.1, "moderate"), (1, "b", 0.3, "moderate"), (1, "c", 0.9, "moderate")], "area_id long, cell_id string, relative_uncertainty double, completeness_label string")
    assert one(U.band_by_rank(df).orderBy("cell_id"), "rank_band") == ["medium", "low", "low"]
    s = spark.createDataFrame([(0.7,), (0.39,), (0.4,), (None,)], "s double")
    assert one(s, U.band(F.col("s"))) == ["high", "low", "medium", "low"]


def test_bootstrap_exact_size_and_stable(spark):
    df = spark.createDataFrame([(i % 3, f"c{i}") for i in range(90)], "area_id long, cell_id string")
    a = {(r.area_id, r.cell_id): r.draws for r in U.bootstrap(df, F.lit(7).cast("long")).collect()}
    b = {(r.area_id, r.cell_id): r.draws for r in U.bootstrap(df.repartition(5), F.lit(7).cast("long"), Scope.measured(df)).collect()}
    assert a == b and sum(a.values()) == 90
    for area in range(3):
        assert sum(v for (k, _), v in a.items() if k == area) == 30


def test_interval_alignment(spark):
    rows = [(1, c, m, p) for c, ps in (("a", (10.0, 12.0, 11.0)), ("b", (20.0, 18.0, 24.0))) for m, p in zip("xyz", ps)]
    members = spark.createDataFrame(rows, "area_id long, cell_id string, member_id string, pred_calibrated double")
    summary = U.summarize_members(members).withColumn("official_total", F.lit(50.0))
    out = U.align_to_total(summary).collect()
    assert sum(r.p50 for r in out) == pytest.approx(50) and all(r.p10 <= r.p50 <= r.p90 and r.surface_value == r.p50 for r in out)


def test_hotspot_class_gap(spark):
    df = spark.createDataFrame([(1, "a", 10.0, "low"), (1, "b", 20.0, "high"), (1, "c", 30.0, "high"), (1, "d", 40.0, "medium")], "area_id long, cell_id string, p50 double, confidence_band string")
    out = {r.cell_id: (r.hotspot_rank, r.hotspot_priority_class) for r in H.hotspot_class(df).collect()}
    assert out["d"] == (1, "not_priority") and out["a"] == (4, "low_value_high_uncertainty")
    assert {r.cell_id for r in H.hotspots(df, 0.5).collect()} == {"c", "d"}


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "b", 1.0, 3.0), (2, "c", 1.0, None), (3, "d", 1.0, 4.0), (3, "e", 2.0, 9.0), (3, "f", 3.0, 11.0)], "area_id long, cell_id string, x double, y double")
    out = {r.area_id: r for r in B.correlations(df, {"p": ("x", "y", "pearson"), "s": ("x", "y", "spearman")}).collect()}
    assert out[1].p is None and out[2].p is None and out[3].s == pytest.approx(1.0)


def test_equal_frequency_buckets(spark):
    n, q = 16132, 5
    df = spark.range(n).select(F.lit(1).alias("area_id"), F.format_string("%06d", "id").alias("cell_id"), (F.col("id") * 1.0).alias("relative_uncertainty"), (F.col("id") * 2.0).alias("absolute_error_p50"))
    buckets = B.monotonicity_buckets(df, bins=q)
    assert [r.row_count for r in buckets.orderBy("uncertainty_bucket").collect()] == [3227, 3226, 3226, 3226, 3227]
    m = B.monotonicity_metrics(df, buckets).first()
    assert m.monotonic_non_decreasing == 1.0 and m.error_uncertainty_spearman == pytest.approx(1.0)


def test_validator_codes(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0, 5.0), (1, None, None, 1.0, 0.0), (1, "a", 2.0, 2.0, -1.0)], "area_id long, cell_id string, latitude double, longitude double, surface_value double")
    codes = {r.code: r.affected_rows for r in Q.validate_surface(df).collect()}
    assert codes["missing_cell_id"] == 1 and codes["missing_coordinates"] == 1 and codes["duplicate_cell_id"] == 1 and codes["non_positive_value"] == 2 and "missing_columns" in codes


def test_completeness_fixture(spark):
    row = {c: 1.0 for c in MODEL_FEATURES}
    df = spark.createDataFrame([(1, *row.values()), (1, *row.values())], "area_id long, " + ", ".join(f"{c} double" for c in MODEL_FEATURES))
    out = Q.completeness(df).first()
    assert out.completeness_score == 100.0 and out.completeness_label == "excellent" and out.optional_nonempty_layers == 5


def test_name_keys(spark):
    df = spark.createDataFrame([("Ust-Kamenogorsk", "1_ust-kamenogorsk_.csv"), ("  Éß Ølo_x ", "/a/b/2-x.y.csv")], "n string, f string")
    assert one(df, N.norm_name(F.col("n"))) == ["ust kamenogorsk", "e lo x"]
    assert one(df, N.name_from_file(F.col("f"))) == ["ust kamenogorsk", "x y"]
    q = spark.createDataFrame([("  Explain   CONFIDENCE_score / P10-P90?  ",)], "q string")
    assert one(q, N.norm_question(F.col("q"))) == ["explain confidence_score / p10-p90"]
    b = spark.createDataFrame([("Алматы_Ауданы",), ("Бостандық ауданы",), ("Nura District!",)], "b string")
    assert one(b, N.norm_boundary(F.col("b"))) == ["алматы", "бостандык", "nura"]


def test_broken_totals(spark):
    lines = spark.createDataFrame([(2, '"Almaty,\t2292333"'), (3, "Shymkent,0"), (4, "Moscow,13100000"), (5, "nothing")], "line_no int, line string")
    good, bad = IO.parse_total_lines(lines)
    assert {r.normalized_city_name: r.population for r in good.collect()} == {"almaty": 2292333, "moscow": 13100000}
    assert {r.line_no for r in bad.collect()} == {3, 5}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "1_town-a_.csv").write_text("cell_id,latitude,longitude," + ",".join(MODEL_FEATURES) + "\nZ1,1,2," + ",".join(["3"] * 16 + ["bad"]) + "\n")
    r = IO.read_cells(spark, str(tmp_path)).first()
    assert r.area_key == "town a" and r.building_count == 3.0 and r.combined_index is None
    (tmp_path / "q.txt").write_text("\ufeffquestion_id,question\nQ1,hello\n", encoding="utf-8")
    assert IO.read_questions(spark, str(tmp_path / "q.txt")).columns == ["question_id", "question"]
    (tmp_path / "t.txt").write_text('city,pop\n"A,\t5"\nB\n')
    good, bad = IO.read_totals_lenient(spark, str(tmp_path / "t.txt"))
    assert good.first().population == 5 and bad.first().line_no == 3


def test_options(spark):
    html = '<select name="name"><option value="1">District A population</option><option value="2">District B area</option><option value="">x</option></select>'
    df = spark.createDataFrame([("p", html)], "page string, html string")
    assert one(IO.extract_options(df, "district", ["population"]), "option_id") == ["1"]


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = x @ [1.0, -0.5, 3.0] + 2
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, t double")
    model = T.fit_ridge(df, ["a", "b", "c"], "t", 1.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(model.weights, w) and model.intercept == pytest.approx(y.mean())


def test_block_folds_balanced(spark):
    df = spark.createDataFrame([(f"b{i % 7}", i) for i in range(100)], "block string, i long")
    sizes = [r["count"] for r in T.folds_blocks(df, 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 100
    together = T.folds_blocks(df, 5).groupBy("block").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0]
    assert together == 1


def test_ablation_winner_is_deterministic(spark):
    rows = [(n, 1.0, 3.0, 0.1, 1.0, r, 0.2) for n, r in (("full_features", 1.0), ("built_form_only", 2.0), ("transport_only", 2.0), ("poi_services_only", 2.0))]
    folds = spark.createDataFrame(rows, "ablation_name string, raw_mae double, raw_rmse double, raw_r2 double, calibrated_mae double, calibrated_rmse double, calibrated_r2 double")
    assert one(T.ablation_summary(folds).where("is_selected_non_full_winner"), "ablation_name") == ["built_form_only"]


def test_save_and_load_ridge(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i), float(i * 2)) for i in range(30)], "area_id long, a double, weak_target double")
    config = T.TrainingConfig(model="ridge", features=("a",))
    model = T.train(df, config, str(tmp_path / "m"))
    back, meta = T.load_model(spark, str(tmp_path / "m"))
    assert back.weights == pytest.approx(model.weights) and meta.first().rows == 30
