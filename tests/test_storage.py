import pytest
from pyspark.sql import functions as F

from gridspark.operators import ensemble as E
from gridspark.operators import training as T
from gridspark.operators import uncertainty as U
from gridspark.sources import tables as IO


def test_surface_files_and_runs(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame([(1, "a", 2.5, ring), (2, "b", 3.5, ring)], "area_id long, cell_id string, surface_value double, geom ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    IO.write_surface(df, str(tmp_path / "s"))
    back = IO.read_runs(spark, str(tmp_path / "s" / "csv"), "csv", spark.createDataFrame([(2,)], "area_id long")).collect()
    assert [r.cell_id for r in back] == ["b"] and "area_id=2" in back[0].source_path
    text = spark.read.text(str(tmp_path / "s" / "geojson")).where("area_id = 1").first().value
    assert '"type":"Polygon"' in text and text.count("[0.0,0.0]") == 2


def test_internal_support(spark):
    areas = spark.createDataFrame([(1,), (2,), (3,)], "area_id long")
    district = spark.createDataFrame([(1, 0.9, 0.8, 0), (2, -0.5, 0.1, 2)], "area_id long, pearson_r double, spearman_r double, boundary_warning_count long")
    out = {r.area_id: r for r in U.internal_support(areas, district).collect()}
    assert out[1].internal_support_score == pytest.approx(0.45 * 0.9 + 0.35 * 0.8 + 0.2) and out[1].district_support_flag == "strong"
    assert out[2].internal_support_score == pytest.approx(0.135) and out[2].district_support_flag == "mixed"
    assert out[3].internal_support_score == 0.5 and out[3].district_support_flag == "not_available"


def test_ensemble_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, f"c{i}", float(i), float(3 * i)) for i in range(40)], "area_id long, cell_id string, a double, weak_target double")
    config = T.TrainingConfig(model="ridge", features=("a",))
    models, manifest = E.train_ensemble(df, config, 2)
    E.save_ensemble(models, manifest, str(tmp_path / "e"))
    back, listed = E.load_ensemble(spark, str(tmp_path / "e"))
    assert sorted(back) == ["member_01", "member_02"] and [r.seed for r in listed.orderBy("member_id").collect()] == [42, 1051]
    a = E.predict_members(models, df, config).agg(F.sum("pred")).first()[0]
    assert E.predict_members(back, df, config).agg(F.sum("pred")).first()[0] == pytest.approx(a)
