"""The distributed way must equal the window way, with a hot group and hot values."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.scope import AREA, Scope, attach, quantiles, top_k, with_group, with_quantiles, with_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(1500):
        area = 1 if i % 3 == 0 else i % 40 + 2
        value = 0.0 if rnd.random() < 0.35 else round(rnd.uniform(-5, 50), 1)
        rows.append((area, f"c{i:05d}", value, None if i % 11 == 0 else float(i % 7)))
    return spark.createDataFrame(rows, "area_id long, cell_id string, v double, w double")


def _pdf(df):
    return df.toPandas().sort_values(["area_id", "cell_id"]).reset_index(drop=True)


@pytest.mark.parametrize("method", ["row", "dense", "min", "average"])
def test_rank_paths_agree(skewed, method):
    small = Scope.measured(skewed)
    assert small.small_groups and small.few_groups
    a = _pdf(with_rank(skewed, small, [("v", False)], "r", method))
    b = _pdf(with_rank(skewed, AREA, [("v", False)], "r", method))
    pd.testing.assert_frame_equal(a[["cell_id", "r"]], b[["cell_id", "r"]], check_dtype=False)
    if method != "row":
        want = _pdf(skewed).groupby("area_id").v.rank(method=method, ascending=False)
        assert (a.r - want).abs().max() == 0


def test_quantile_paths_agree_with_pandas(skewed):
    wanted = {"q10": ("v", 0.1), "q50": ("v", 0.5), "q97": ("v", 0.97), "w50": ("w", 0.5)}
    a = quantiles(skewed, Scope.measured(skewed), wanted).toPandas().sort_values("area_id").reset_index(drop=True)
    b = quantiles(skewed, AREA, wanted).toPandas().sort_values("area_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])
    want = skewed.toPandas().groupby("area_id").v.quantile(0.97)
    assert (b.set_index("area_id").q97 - want).abs().max() < 1e-9


def test_group_values_and_top_k(skewed):
    small = Scope.measured(skewed)
    for scope in (small, AREA):
        out = _pdf(with_group(skewed, scope, {"s": F.sum("v"), "n": F.count(F.lit(1))}))
        want = _pdf(skewed).groupby("area_id").v.transform("sum")
        assert (out.s - want).abs().max() < 1e-9
        q = _pdf(with_quantiles(skewed, scope, {"m": ("v", 0.5)}))
        assert (q.m - _pdf(skewed).groupby("area_id").v.transform("median")).abs().max() < 1e-9
        top = top_k(skewed, scope, [("v", False)], 3).toPandas()
        assert top.groupby("area_id").size().max() == 3
        best = _pdf(skewed).sort_values(["area_id", "v", "cell_id"], ascending=[True, False, True]).groupby("area_id").head(3)
        assert set(top.cell_id) == set(best.cell_id)


def test_attach_salted_keeps_rows(skewed):
    stats = skewed.groupBy("area_id").agg(F.max("v").alias("m")).where("area_id <> 5")
    for how, lost in (("left", 0), ("inner", skewed.where("area_id = 5").count())):
        assert attach(skewed, stats, AREA, how).count() == skewed.count() - lost


def test_global_scope_rank(skewed):
    glob = Scope(keys=(), row_id=("area_id", "cell_id"))
    out = with_rank(skewed, glob, [("v", True)], "r", "row").toPandas()
    assert sorted(out.r) == list(range(1, len(out) + 1))


@pytest.fixture(scope="module")
def holes(spark):
    nan, inf = float("nan"), float("inf")
    values = [1.0, nan, 3.0, None, 3.0, inf, -inf, 0.0, -0.0, None, nan]
    rows = [(a, i, v) for a in (1, 2) for i, v in enumerate(values[a - 1 :])] + [(3, 0, None), (3, 1, nan)]
    return spark.createDataFrame(rows, "area_id long, cell_id long, v double")


@pytest.mark.parametrize("method", ["dense", "min", "average", "row"])
def test_both_ways_rank_nulls_and_nan_alike(holes, method):
    out = [{(r.area_id, r.cell_id): r.r for r in with_rank(holes, s, [("v", True)], "r", method).collect()} for s in (Scope.measured(holes), AREA)]
    assert out[0] == out[1]
    if method != "row":
        assert {k for k, r in out[0].items() if r is None} == {(r.area_id, r.cell_id) for r in holes.where("v is null or isnan(v)").collect()}


def test_both_ways_take_quantiles_of_numbers_only(spark, holes):
    for s in (Scope.measured(holes), AREA):
        got = {r.area_id: (r.m, r.top) for r in quantiles(holes, s, {"m": ("v", 0.5), "top": ("v", 1.0)}).collect()}
        assert got == {1: (1.0, float("inf")), 2: (1.5, float("inf")), 3: (None, None)}
    few = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("nan")), (1, 2, 3.0), (1, 3, None)], "area_id long, cell_id long, v double")
    for s in (Scope.measured(few), AREA):
        assert quantiles(few, s, {"m": ("v", 0.5)}).first().m == 2.0 and {r.m for r in with_quantiles(few, s, {"m": ("v", 0.5)}).collect()} == {2.0}


def test_both_ways_correlate_alike(spark):
    from gridspark.operators.stats import correlations

    rows = [(a, i, float((i * 7) % 5) if i % 11 else None, float((i * i) % 13) if i % 7 else float("nan"), float(i % 3)) for a in (1, 2) for i in range(60)]
    df = spark.createDataFrame([*rows, (3, 0, 1.0, 1.0, 1.0)], "area_id long, cell_id long, x double, y double, z double")
    pairs = {"xy": ("x", "y", "spearman"), "xz": ("x", "z", "spearman"), "p": ("x", "y", "pearson"), "xx": ("x", "x", "spearman")}
    out = [{r.area_id: tuple(r)[1:] for r in correlations(df, pairs, s).collect()} for s in (Scope.measured(df), AREA)]
    pdf = df.toPandas()
    for area, got in out[0].items():
        own = pdf[pdf.area_id == area]
        ranked = lambda a, b: own[[a, b]].dropna().rank().corr().iloc[0, 1]  # noqa: B023
        want = [ranked("x", "y"), ranked("x", "z"), own.x.corr(own.y), 1.0] if area < 3 else [None] * 4
        assert got == pytest.approx(want, abs=1e-9) and out[1][area] == pytest.approx(want, abs=1e-9)
