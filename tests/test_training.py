"""Block folds against a plain heap, and given tree depths."""

import heapq
import random
from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import ensemble as E
from gridspark.operators import training as T

from gridspark.operators.training import _greedy_plan, folds_blocks, make_estimator


def heap_folds(blocks, k):
    heap, out = [(0, i) for i in range(1, k + 1)], {}
    for name, size in sorted(blocks.items(), key=lambda b: (-b[1], b[0])):
        load, i = heapq.heappop(heap)
        out[name] = i
        heapq.heappush(heap, (load + size, i))
    return out


def test_plan_is_the_greedy_choice():
    rnd = random.Random(1)
    for _ in range(500):
        k = rnd.randrange(2, 7)
        sizes = sorted({rnd.choice([1, 2, 3, 5, 7, 50, 1000]) for _ in range(rnd.randrange(1, 6))}, reverse=True)
        counted = [(s, rnd.randrange(1, 40)) for s in sizes]
        want = heap_folds({(s, j): s for s, c in counted for j in range(c)}, k)
        plan = _greedy_plan(counted, k)
        for s, c in counted:
            assert sum(p[0] == s for p in plan) <= k
            for j in range(c):
                ((first, cycle),) = [(first, cycle) for size, first, last, cycle in plan if size == s and first <= j <= last]
                assert cycle[(j - first) % len(cycle)] == want[s, j]


def test_plan_of_very_many_blocks_is_short():
    assert len(_greedy_plan([(10**9, 3), (7, 10**12), (1, 10**15)], 5)) <= 15


def test_folds_of_a_table(spark):
    sizes = {f"b{i:03d}": 1 + i * i % 17 for i in range(120)}
    df = spark.createDataFrame([(b, n) for b, n in sizes.items()], "block string, n int").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n"))))
    got = {r.block: r.fold for r in folds_blocks(df, 4).select("block", "fold").distinct().collect()}
    assert got == heap_folds(sizes, 4)


def test_given_depth_is_used(spark):
    depth = lambda model, d: make_estimator(model, ["a"], max_depth=d).getStages()[-1].getMaxDepth()
    assert [depth("boosted_trees", 12), depth("boosted_trees", None), depth("random_forest", 9), depth("random_forest", None)] == [12, 6, 9, 12]


@pytest.mark.parametrize("holes", [0, 3, 7])
def test_one_pass_ridge_equals_fits_fold_by_fold(spark, holes):
    """Held-out predictions from moments against a fit of each training part, also for a part of the features."""
    rnd = random.Random(7)
    rows = [(a, f"c{a}_{i}", 1.0 + a + 0.1 * i, 2.0 + i % 5, rnd.random() * 1e6, float(rnd.randrange(9)), 1.0, abs(rnd.gauss(50, 20)), 100.0 * a + 50) for a in range(1, 6) for i in range(30)]
    if holes:  # ties, an area with none of a feature, and odd and even counts
        rows = [(*r[:4], None if i % holes == 0 else r[4], None if r[0] == 2 or i % 4 == 1 else r[5], *r[6:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "area_id long, cell_id string, latitude double, longitude double, p double, q double, constant double, weak_target double, official_total double")
    config = T.TrainingConfig(model="ridge", features=("p", "q", "constant"))
    folded, unit = T._folded(df, config, T.AREA)
    moments = T._training_moments(folded, config, ["p", "q", "constant"])
    for features in (("p", "q", "constant"), ("q",)):
        c = replace(config, features=features)
        quick = {r.cell_id: r.prediction_raw for r in T._ridge_out_of_fold(folded, c, moments).collect()}
        slow = {}
        for fold in range(1, 6):
            model = T.fit(folded.where(F.col("fold") != fold), c)
            scored = T.predict_raw(model, folded.where(F.col("fold") == fold), c.features, c.log_target, "prediction_raw")
            slow |= {r.cell_id: r.prediction_raw for r in scored.collect()}
        assert quick == pytest.approx(slow, rel=1e-8) and len(quick) == len(rows)


@pytest.mark.parametrize("holes", [0, 3])
def test_members_from_weighted_moments_equal_fits_on_copies(spark, holes):
    """U03 and U15: the same draws as row copies, fitted member by member and fold by fold."""
    rnd = random.Random(5)
    value = lambda i: None if holes and i % holes == 0 else rnd.random() * 50
    rows = [(a, f"c{a}_{i}", value(i), float(rnd.randrange(5)), abs(rnd.gauss(50, 20)), 3000.0) for a in range(1, 5) for i in range(25)]
    df = spark.createDataFrame(rows, "area_id long, cell_id string, p double, q double, weak_target double, official_total double")
    config = T.TrainingConfig(model="ridge", features=("p", "q"))
    on = T.folds_loco(df).persist()

    def copies(train, i):
        seed = config.seed + E.SEED_STEP * i
        drawn = E.bootstrap(train.withColumn("member_id", F.lit(E.member_id(i + 1))), F.lit(seed).cast("long"), extra_keys=("member_id",))
        return T.fit(drawn.withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.col("draws").cast("int")))), replace(config, seed=seed))

    models, _ = E.train_ensemble(df, config, 2)
    quick = {(r.member_id, r.cell_id): r.pred for r in E.predict_members(models, df, config).collect()}
    plain = {E.member_id(i + 1): copies(df, i) for i in range(2)}
    assert quick == pytest.approx({(r.member_id, r.cell_id): r.pred for r in E.predict_members(plain, df, config).collect()}, rel=1e-8)

    diag, _ = E.cv_uncertainty(df, config, 2)
    got = {r.cell_id: (r.p10, r.p90) for r in diag.collect()}
    long = []
    for fold in range(1, 5):
        train, held = on.where(F.col("fold") != fold), on.where(F.col("fold") == fold)
        for i in range(2):
            scored = T.predict_raw(copies(train, i), held, config.features, config.log_target)
            long.append(scored.select("area_id", "cell_id", "pred", F.lit(E.member_id(i + 1)).alias("member_id"), F.col("official_total").alias("fold_total")))
    cal = E.calibrate(reduce(DataFrame.unionByName, long), "pred", "fold_total", E.Scope(("area_id", "member_id"), ("cell_id",)), "pred_calibrated")
    want = {r.cell_id: (r.p10, r.p90) for r in E.align_to_total(E.summarize_members(cal, keep=("fold_total",)), "fold_total").collect()}
    assert got.keys() == want.keys()
    for c, (low, high) in got.items():
        assert low == pytest.approx(want[c][0], rel=1e-6) and high == pytest.approx(want[c][1], rel=1e-6)


def test_training_rows_are_read_not_derived_again(spark):
    """Fits and predictions read written rows: no order line is joined again. Doubles and whole numbers turn into numbers as their texts do."""
    from gridspark.functions.scalars import to_num, to_num_of
    from suite.train import labelled

    rows, _ = labelled(spark, "/root/testdata/sf0.001")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    df = spark.sql("select * from values (0.1d, 7L), (double('NaN'), -3L), (double('inf'), null), (null, 9007199254740993L), (1e-300d, 0L) t(a, b)")
    assert df.where(~to_num_of(df, "a").eqNullSafe(to_num(df["a"])) | ~to_num_of(df, "b").eqNullSafe(to_num(df["b"]))).count() == 0


def test_boosted_query_fits_the_whole_of_its_config(spark, monkeypatch):
    """No fewer trees and no less depth than the config has by default."""
    from suite import train as Q

    seen, rows = [], spark.range(1).withColumn("area_id", F.lit(1))
    monkeypatch.setattr(Q, "labelled", lambda *_: (rows, None))
    monkeypatch.setattr(Q.T, "fit", lambda df, config: seen.append(config))
    monkeypatch.setattr(Q.T, "predict_raw", lambda model, df, features: df)
    monkeypatch.setattr(Q.T, "reg_metrics", lambda df, *_: df)
    Q.t05(spark, "")
    assert seen == [T.TrainingConfig(model="boosted_trees")] and (seen[0].trees, seen[0].max_depth) == (400, None)
