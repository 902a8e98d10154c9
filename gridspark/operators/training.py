"""Training sets, folds, fits, cross-validation, ablation and grid-size studies."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import MODEL_FEATURES
from gridspark.functions.scalars import clip, forward_target, inverse_target, log_distance, to_num_of
from gridspark.operators.moments import Moments, training_moments
from gridspark.operators.quality import sanitize, validate
from gridspark.operators.scaling import allocate, calibrate
from gridspark.operators.spatial import spatial_blocks
from gridspark.operators.stats import concentration
from gridspark.scope import AREA, Scope, attach, group_agg, materialize, quantiles, with_group, with_rank
from gridspark.storage import shared_dir


@dataclass(frozen=True)
class TrainingConfig:
    model: str = "random_forest"
    features: tuple[str, ...] = MODEL_FEATURES
    target: str = "weak_target"
    total: str = "official_total"
    protocol: str = "leave_one_city_out"
    block_size_m: float = 2000.0
    block_splits: int = 5
    min_areas: int = 3
    seed: int = 42
    trees: int = 400
    min_leaf: int = 2
    max_depth: int | None = None  #: None: 12 for forests, 6 for boosted trees
    alpha: float = 1.0
    log_target: bool = True
    parallel_fits: int = 4


def training_set(cells: DataFrame, totals: DataFrame, allowed: DataFrame | None = None, scope: Scope = AREA, cols: Sequence[str] = MODEL_FEATURES) -> tuple[DataFrame, DataFrame]:
    """T01. Labelled cells of all usable areas, and the skipped areas with a reason. One plan, no area loop."""
    keys = list(scope.keys)
    present = cells.select(*keys).distinct()
    reason = lambda df, text: df.select(*keys, F.lit(text).alias("reason"))
    skipped = []
    usable = present
    if allowed is not None:
        skipped.append(reason(usable.join(allowed.select(*keys).distinct(), keys, "left_anti"), "outside the requested training subset"))
        usable = usable.join(allowed.select(*keys).distinct(), keys, "left_semi")
    skipped.append(reason(usable.join(totals.select(*keys), keys, "left_anti"), "no official total found"))
    usable = usable.join(totals.select(*keys), keys, "left_semi")
    clean = sanitize(cells, cols)
    required = (*keys, "latitude", "longitude", *cols)
    bad = validate(clean, required, cols, scope=scope).where(F.col("level") == "error").select(*keys).distinct()
    skipped.append(reason(usable.join(bad, keys, "left_semi"), "feature validation failed"))
    usable = usable.join(bad, keys, "left_anti")
    kept = attach(attach(clean, usable, scope, "left_semi" if scope.few_groups else "inner"), totals, scope, "inner")
    return allocate(kept, scope=scope), reduce(DataFrame.unionByName, skipped)


@dataclass
class RidgeModel:
    """Closed-form ridge on standardised features; the prediction is one column expression."""

    features: tuple[str, ...]
    median: list[float]
    mean: list[float]
    std: list[float]
    weights: list[float]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [
            (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mu) / s * w
            for c, m, mu, s, w in zip(self.features, self.median, self.mean, self.std, self.weights)
        ]
        return df.withColumn("prediction", reduce(lambda a, b: a + b, terms) + self.intercept)


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> RidgeModel:
    """T02 + T03. Median imputation, population scaling, then a solve on the moment matrix.

    One aggregate brings back counts, nulls and means; medians are computed only for columns with nulls.
    Second moments about the means are summed per Arrow batch and then across partitions, so about
    ``p * p`` numbers reach the driver whatever the number of rows.
    """
    p = len(features)
    raw = [F.col(c).cast("double") for c in features]
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("ybar"),
        *[F.count(c).alias(f"k{i}") for i, c in enumerate(raw)],
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(raw)],
    ).first()
    n, ybar = first["n"], float(first["ybar"])
    holes = {f"_m{i}": (c, 0.5) for i, c in enumerate(features) if first[f"k{i}"] < n}
    median = [0.0] * p
    if holes:
        scope = Scope(keys=(), row_id=tuple(features), groups=1, max_rows=n)
        found = quantiles(df, scope, holes).first()
        for i in range(p):
            median[i] = float(found[f"_m{i}"] or 0.0) if f"_m{i}" in holes else 0.0
    mean = [((first[f"s{i}"] or 0.0) + median[i] * (n - first[f"k{i}"])) / n for i in range(p)]
    center = np.array([*mean, ybar])
    filled = [F.coalesce(c, F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(raw, median))]

    def moments(batches):
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            z = batch.to_numpy(dtype=float) - center
            total += z.T @ z
        i, j = np.triu_indices(p + 1)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    rows = df.select(*filled, F.col(label).cast("double").alias("y")).mapInPandas(moments, "i int, j int, v double")
    second = np.zeros((p + 1, p + 1))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (p + 1)(p + 2) / 2 rows
        second[r["i"], r["j"]] = second[r["j"], r["i"]] = r["v"]
    std = np.sqrt(np.maximum(np.diag(second)[:p] / n, 0.0))
    std[std == 0] = 1.0
    gram = second[:p, :p] / np.outer(std, std)
    moment = second[:p, p] / std
    w = np.linalg.solve(gram + alpha * np.eye(p), moment)
    return RidgeModel(tuple(features), median, mean, std.tolist(), w.tolist(), ybar)


def prep_stages(features: Sequence[str], scale: bool) -> list:
    """T02. Median imputation, assembling, optional scaling as ML stages."""
    filled = [f"_f_{c}" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "features"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return stages


def make_estimator(name: str, features: Sequence[str], seed: int = 42, trees: int = 400, min_leaf: int = 2, max_depth: int | None = None):
    """T04, T05, T06. Tree estimators by name; ridge is fitted by ``fit_ridge``. A depth that is given is used as it is."""
    common = {"featuresCol": "features", "labelCol": "_label", "seed": seed, "maxDepth": max_depth or (12 if name == "random_forest" else 6)}
    if name == "random_forest":
        model = RandomForestRegressor(numTrees=trees, minInstancesPerNode=min_leaf, featureSubsetStrategy="all", **common)
    elif name in ("boosted_trees", "catboost"):
        model = GBTRegressor(maxIter=trees, minInstancesPerNode=min_leaf, **common)
    else:
        raise ValueError(f"unsupported model: {name}")
    return Pipeline(stages=[*prep_stages(features, False), model])


def fit(df: DataFrame, config: TrainingConfig):
    """Fit on the transformed target; returns an object with ``transform``."""
    labelled = df.select(*config.features, forward_target(F.col(config.target).cast("double"), config.log_target).alias("_label"))
    if config.model == "ridge":
        return fit_ridge(labelled, config.features, "_label", config.alpha)
    context = df.sparkSession.sparkContext
    if config.model != "random_forest" and context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))  # each tree adds to the lineage of the next; MLlib cuts it every ten trees
    return make_estimator(config.model, config.features, config.seed, config.trees, config.min_leaf, config.max_depth).fit(labelled)


def predict_raw(model, cells: DataFrame, features: Sequence[str] = MODEL_FEATURES, log_target: bool = True, out: str = "pred") -> DataFrame:
    """I01. Features to number (null to 0), prediction, inverse transform, clip at 0."""
    lost = [c for c in features if c not in cells.columns]
    if lost:
        raise ValueError("cells are missing model columns: " + ", ".join(lost))
    ready = cells.withColumns({c: F.coalesce(to_num_of(cells, c), F.lit(0.0)) for c in features})
    scored = model.transform(ready)
    helpers = [c for c in scored.columns if c.startswith("_f_") or c in ("_raw", "features", "prediction")]
    return scored.withColumn(out, clip(inverse_target(F.col("prediction"), log_target))).drop(*helpers)


def folds_loco(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """T07. Fold number = rank of the area; group = area."""
    areas = df.select(*scope.keys).distinct()
    one = Scope(keys=(), row_id=scope.keys, groups=1, max_rows=scope.groups)
    numbered = with_rank(areas, one, [(k, True) for k in scope.keys], "fold", "row")
    return attach(df, numbered, scope).withColumn("fold_group", F.concat_ws("|", *scope.keys))


def _greedy_plan(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Which fold takes the j-th block of each size if blocks go, largest first, to the lightest fold (ties: the first).

    ``sizes`` are ``(size, blocks)``, the largest first. Folds are picked in the order of ``(load + t * size, fold)``
    over all t, so the picks of one size are a few runs, each a fixed cycle over some folds: rows
    ``(size, first, last, cycle)``, ``first`` and ``last`` being ranks from 0. At most k runs a size.
    """
    load, plan = [0] * (k + 1), []
    for size, count in sizes:
        by_level = sorted(range(1, k + 1), key=lambda i: load[i] // size)
        done, m = 0, 0
        while done < count:
            level = load[by_level[m]] // size
            while m < k and load[by_level[m]] // size == level:
                m += 1
            upto = load[by_level[m]] // size if m < k else None
            cycle = sorted(by_level[:m], key=lambda i: (load[i] % size, i))
            picks = count - done if upto is None else min(count - done, (upto - level) * m)
            plan.append((size, done, done + picks - 1, cycle))
            for n, i in enumerate(cycle):
                load[i] += size * (picks // m + (n < picks % m))
            done += picks
    return plan


def folds_blocks(df: DataFrame, k: int = 5, block: str = "block") -> DataFrame:
    """T08. Group k-fold: blocks by size (ties by name), each to the lightest fold; k = min(max(2, k), blocks).

    Exactly the greedy result at any number of blocks: the driver sees only how many blocks have each size (n rows make
    at most sqrt(2 n) different sizes), and a block finds its fold by its rank among the blocks of its size.
    """
    sizes = materialize(df.groupBy(block).agg(F.count(F.lit(1)).alias("_n")))
    counted = sorted(((r["_n"], r["n"]) for r in sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()), reverse=True)
    n = sum(c for _, c in counted)
    if n < 2:
        raise ValueError("block folds need at least two blocks")
    plan = df.sparkSession.createDataFrame(_greedy_plan(counted, min(max(2, int(k)), n)), "_n long, _first long, _last long, _cycle array<long>")
    ranked = with_rank(sizes, Scope(keys=("_n",), row_id=(block,)), [(block, True)], "_r", "row").withColumn("_r", F.col("_r") - 1)
    placed = ranked.join(plan, "_n").where((F.col("_r") >= F.col("_first")) & (F.col("_r") <= F.col("_last")))
    fold = F.element_at("_cycle", (F.pmod(F.col("_r") - F.col("_first"), F.size("_cycle").cast("long")) + 1).cast("int"))
    return df.join(placed.select(block, fold.alias("fold")), block).withColumn("fold_group", F.col(block))


def with_folds(df: DataFrame, config: TrainingConfig, scope: Scope = AREA) -> tuple[DataFrame, str]:
    protocol = config.protocol.strip().lower().replace("-", "_").replace(" ", "_")
    if protocol in ("leave_one_city_out", "leave_one_group_out", "loco"):
        return folds_loco(df, scope), "city"
    if protocol in ("spatial_block", "spatial_block_cv"):
        return folds_blocks(spatial_blocks(df, config.block_size_m, scope), config.block_splits), "spatial_block"
    raise ValueError(f"unsupported validation protocol: {config.protocol}")


def _fold_total(df: DataFrame, config: TrainingConfig, unit: str) -> DataFrame:
    """Calibration total: the official total of the area, or the held-out block's own target sum."""
    if unit == "city":
        return df.withColumn("fold_total", F.col(config.total).cast("double"))
    return with_group(df, Scope(("fold", "fold_group"), ("cell_id",)), {"fold_total": F.sum(F.col(config.target).cast("double"))})


def over_folds(df: DataFrame, config: TrainingConfig, run) -> list[DataFrame]:
    """Run ``run(train, held_out, fold)`` for each fold with a bounded number of concurrent fits."""
    folds = [r["fold"] for r in df.select("fold").distinct().orderBy("fold").toLocalIterator()]
    with ThreadPoolExecutor(max_workers=max(1, config.parallel_fits)) as pool:
        return list(pool.map(lambda f: run(df.where(F.col("fold") != f), df.where(F.col("fold") == f), f), folds))


def _training_moments(rows: DataFrame, config: TrainingConfig, features: Sequence[str]) -> Moments:
    """Moments of the rows *outside* each fold, from one pass whatever the number of folds, nulls or not."""
    label = forward_target(F.col(config.target).cast("double"), config.log_target)
    wide = rows.select(F.lit("").alias("group"), "fold", F.lit(1).alias("weight"), *[F.col(c).cast("double").alias(c) for c in features], label.alias("y"))
    return training_moments(wide, features)


def predict_linear(rows: DataFrame, models: DataFrame, config: TrainingConfig, keys: Sequence[str], out: str) -> DataFrame:
    """Predictions by ``intercept`` and ``slopes`` of the model that the keys name: one join for all models."""
    chosen = models.select(*keys, F.col("intercept").alias("_b"), F.col("slopes").alias("_w"))
    ready = rows.withColumns({c: F.coalesce(to_num_of(rows, c), F.lit(0.0)) for c in config.features})
    ready = attach(ready, chosen, Scope(tuple(keys), ("cell_id",)), "inner")
    linear = reduce(lambda a, b: a + b, [F.col("_w")[i] * F.col(c) for i, c in enumerate(config.features)], F.col("_b"))
    return ready.withColumn(out, clip(inverse_target(linear, config.log_target))).drop("_b", "_w")


def _ridge_out_of_fold(rows: DataFrame, config: TrainingConfig, moments: Moments) -> DataFrame:
    """Held-out predictions of all folds."""
    return predict_linear(rows, moments.ridge(config.features, config.alpha), config, ("fold",), "prediction_raw")


def cross_validate(df: DataFrame, config: TrainingConfig, scope: Scope = AREA) -> DataFrame:
    """T09. Out-of-fold rows with raw and calibrated predictions (``fold, fold_group, prediction_*``).

    Ridge takes one pass and one join for all folds; tree models are fitted fold by fold.
    """
    rows, unit = _folded(df, config, scope)
    if config.model == "ridge":
        scored = _ridge_out_of_fold(rows, config, _training_moments(rows, config, config.features))
    else:
        run = lambda train, held, _: predict_raw(fit(train, config), held, config.features, config.log_target, "prediction_raw")
        scored = reduce(DataFrame.unionByName, over_folds(rows, config, run))
    return _calibrated_folds(scored, config, unit)


def _folded(df: DataFrame, config: TrainingConfig, scope: Scope) -> tuple[DataFrame, str]:
    """Rows with fold and fold total, written once."""
    df = materialize(df)
    n = df.select(*scope.keys).distinct().count()
    if n < config.min_areas:
        raise ValueError(f"need at least {config.min_areas} areas for training; got {n}")
    folded, unit = with_folds(df, config, scope)
    rows = materialize(_fold_total(folded, config, unit))  # every fold reads it twice
    return rows, unit


def _calibrated_folds(scored: DataFrame, config: TrainingConfig, unit: str) -> DataFrame:
    out = calibrate(scored, "prediction_raw", "fold_total", Scope(("fold", "fold_group"), ("cell_id",)), "prediction_calibrated")
    return out.withColumns({"validation_protocol": F.lit(config.protocol), "calibration_unit": F.lit(unit)})


def _metrics(true: Column, pred: Column, prefix: str) -> list[Column]:
    err = pred - true
    sse, n = F.sum(err * err), F.count(F.lit(1))
    sst = F.var_pop(true) * n
    return [
        F.avg(F.abs(err)).alias(f"{prefix}mae"),
        F.sqrt(F.avg(err * err)).alias(f"{prefix}rmse"),
        F.when(n > 1, 1.0 - F.try_divide(sse, sst)).alias(f"{prefix}r2"),
    ]


def reg_metrics(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """T10. MAE, RMSE and R2 (null for one row) per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *_metrics(F.col(true).cast("double"), F.col(pred).cast("double"), ""))


def fold_report(oof: DataFrame, config: TrainingConfig, area: str = "area_id") -> DataFrame:
    """T11. One row of metrics per fold, with the (distinct, few) areas it held out."""
    true = F.col(config.target).cast("double")
    return oof.groupBy("fold", "validation_protocol", "calibration_unit").agg(
        F.array_join(F.sort_array(F.collect_set(F.col(area).cast("string"))), ", ").alias("areas"),
        F.count_distinct("fold_group").alias("validation_group_count"),
        F.count(F.lit(1)).alias("rows"),
        *_metrics(true, F.col("prediction_raw"), "raw_"),
        *_metrics(true, F.col("prediction_calibrated"), "calibrated_"),
    )


def save_model(model, path: str, meta: DataFrame) -> None:
    """T12. ML pipeline folder (or ridge coefficients as a table) and a metadata table."""
    if isinstance(model, RidgeModel):
        spark = meta.sparkSession
        rows = [(c, *map(float, v)) for c, *v in zip(model.features, model.median, model.mean, model.std, model.weights)]
        table = spark.createDataFrame(rows, "feature string, median double, mean double, std double, weight double")
        table.withColumn("intercept", F.lit(model.intercept)).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark, path: str):
    meta = spark.read.parquet(f"{path}/meta")
    if meta.first()["model"] != "ridge":
        return PipelineModel.load(f"{path}/model"), meta
    rows = spark.read.parquet(f"{path}/model").collect()  # one row per feature
    col = lambda c: [r[c] for r in rows]
    return RidgeModel(tuple(col("feature")), col("median"), col("mean"), col("std"), col("weight"), rows[0]["intercept"]), meta


def train(df: DataFrame, config: TrainingConfig, path: str | None = None):
    """T12. Final fit on all rows; saved when a path is given."""
    model = fit(df, config)
    if path is not None:
        meta = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("area_id").alias("areas")).withColumns(
            {"model": F.lit(config.model), "features": F.array(*[F.lit(c) for c in config.features]), "log_target": F.lit(config.log_target), "seed": F.lit(config.seed)}
        )
        save_model(model, path, meta)
    return model


METRICS = tuple(f"{p}_{m}" for p in ("raw", "calibrated") for m in ("mae", "rmse", "r2"))


def compare_runs(folds: DataFrame, by: Sequence[str] = ("model_name", "validation_protocol")) -> DataFrame:
    """T14. Mean and median fold metrics per run, best calibrated RMSE first (a few rows)."""
    return folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
        *[F.median(m).alias(f"median_{m}") for m in ("calibrated_rmse", "calibrated_r2")],
    ).orderBy("mean_calibrated_rmse", *by)


@dataclass(frozen=True)
class AblationSpec:
    name: str
    description: str
    features: tuple[str, ...] = field(default=())
    tie_order: int = 999


# Feature families of the ablation study.
ABLATIONS = (
    AblationSpec("full_features", "All model features.", MODEL_FEATURES, 999),
    AblationSpec(
        "built_form_only",
        "Built form and morphology only.",
        (
            "building_count",
            "building_area",
            "residential_area",
            "commercial_area",
            "retail_area",
            "public_area",
            "building_with_levels_count",
            "mean_building_levels",
            "total_floor_area",
        ),
        0,
    ),
    AblationSpec("transport_only", "Transport intensity only.", ("road_length", "bus_stop_count"), 2),
    AblationSpec(
        "poi_services_only",
        "POI and service access only.",
        ("park_area", "schools_count", "hospitals_count", "parks_shops_count", "poi_access_index"),
        1,
    ),
)


def check_ablations(specs: Sequence[AblationSpec] = ABLATIONS) -> None:
    seen = set()
    for s in specs:
        if s.name in seen:
            raise ValueError(f"duplicate ablation name: {s.name}")
        seen.add(s.name)
        unknown = [c for c in s.features if c not in MODEL_FEATURES]
        if unknown:
            raise ValueError(f"{s.name} uses unknown features: {unknown}")
        if (s.name == "full_features") != ("combined_index" in s.features):
            raise ValueError("the combined index belongs to full_features and to no other family")


def ablation_summary(folds: DataFrame, specs: Sequence[AblationSpec] = ABLATIONS) -> DataFrame:
    """T15. Mean metrics per family, gains, deltas to the full family, and the winner among the rest.

    ``folds`` holds fold metrics with ``ablation_name``.
    """
    check_ablations(specs)
    spark = folds.sparkSession
    table = spark.createDataFrame(
        [(s.name, s.description, len(s.features), "|".join(s.features), i, s.tie_order) for i, s in enumerate(specs)],
        "ablation_name string, description string, feature_count long, feature_columns string, display_order long, _tie long",
    )
    means = folds.groupBy("ablation_name").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
        F.median("calibrated_rmse").alias("median_calibrated_rmse"),
        F.median("calibrated_r2").alias("median_calibrated_r2"),
    )
    rows = means.join(F.broadcast(table), "ablation_name")
    full = rows.where(F.col("ablation_name") == "full_features").select(F.col("mean_calibrated_rmse").alias("_fr"), F.col("mean_calibrated_r2").alias("_f2"))
    best = rows.where(F.col("ablation_name") != "full_features").agg(
        F.min_by("ablation_name", F.struct("mean_calibrated_rmse", -F.col("mean_calibrated_r2"), "_tie")).alias("_win")
    )
    return (
        rows.crossJoin(F.broadcast(full))  # one row each
        .crossJoin(F.broadcast(best))
        .withColumns(
            {
                "calibration_rmse_gain": F.col("mean_raw_rmse") - F.col("mean_calibrated_rmse"),
                "calibration_r2_gain": F.col("mean_calibrated_r2") - F.col("mean_raw_r2"),
                "delta_vs_full_calibrated_rmse": F.col("mean_calibrated_rmse") - F.col("_fr"),
                "delta_vs_full_calibrated_r2": F.col("mean_calibrated_r2") - F.col("_f2"),
                "is_selected_non_full_winner": F.col("ablation_name") == F.col("_win"),
            }
        )
        .drop("_fr", "_f2", "_win", "_tie")
        .orderBy("display_order")
    )


def run_ablation(df: DataFrame, config: TrainingConfig, specs: Sequence[AblationSpec] = ABLATIONS, done: DataFrame | None = None, scope: Scope = AREA) -> DataFrame:
    """T16. Fold metrics of every family; families already in ``done`` are taken from there."""
    check_ablations(specs)
    finished = set() if done is None else {r[0] for r in done.select("ablation_name").distinct().collect()}
    parts = [] if done is None else [done]
    todo = [s for s in specs if s.name not in finished]
    union = list(dict.fromkeys(c for s in todo for c in s.features))
    df = materialize(df)
    moments = None
    if config.model == "ridge" and todo:  # the moments of a family are a part of those of all features
        rows, unit = _folded(df, config, scope)
        moments = _training_moments(rows, config, union)
    for s in todo:
        c = replace(config, features=s.features)
        oof = cross_validate(df, c, scope) if moments is None else _calibrated_folds(_ridge_out_of_fold(rows, c, moments), c, unit)
        parts.append(fold_report(oof, c).withColumn("ablation_name", F.lit(s.name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def size_runs(surfaces: DataFrame, totals: DataFrame, warnings: DataFrame, scope: Scope) -> DataFrame:
    """T17. One benchmark row per (area, cell size); requested pairs without a surface stay as failures.

    ``surfaces`` has ``area_id, cell_size_m, cell_id, raw_value, surface_value``; ``warnings`` the requested
    pairs with ``qa_warning_count, qa_error_count, layer_warning_count, runtime_seconds``.
    """
    keys = list(scope.keys)
    agg = group_agg(
        surfaces,
        scope,
        F.count(F.lit(1)).alias("zones"),
        F.sum("raw_value").alias("raw_sum"),
        F.sum("surface_value").alias("final_sum"),
    )
    v = F.coalesce(F.col("surface_value"), F.lit(0.0))
    qs = quantiles(surfaces, scope, {"median_cell_value": (v, 0.5), "p95_cell_value": (v, 0.95)})
    top = concentration(surfaces, "surface_value", scope).withColumnRenamed("top_share", "top_10pct_share")
    joined = warnings.join(agg, keys, "left").join(qs, keys, "left").join(top, keys, "left")
    joined = joined.join(totals.select("area_id", "official_total"), "area_id", "left")
    factor = F.when(F.col("raw_sum") > 0, F.try_divide("official_total", "raw_sum")).otherwise(F.when(F.col("raw_sum").isNotNull(), F.lit(0.0)))
    return joined.withColumn("calibration_factor", factor).withColumns(
        {
            "success": F.col("zones").isNotNull(),
            "zones": F.coalesce("zones", F.lit(0)),
            "cell_area_sq_km": F.col("cell_size_m") * F.col("cell_size_m") / 1e6,
            "calibration_distance": F.coalesce(log_distance(F.col("calibration_factor")), F.lit(float("inf"))),
        }
    )


def _size_score(distance: Column, qa: Column, layer: Column, seconds: Column) -> Column:
    return distance + 0.05 * qa + 0.10 * layer + 0.001 * seconds


def size_choice(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T18. Summary per size, best size per area, and the one global choice."""
    ok = runs.where("success")
    c = F.col
    per_area = (
        ok.withColumn("benchmark_score", _size_score(c("calibration_distance"), c("qa_warning_count"), c("layer_warning_count"), c("runtime_seconds")))
        .groupBy("area_id")
        .agg(
            F.min_by(
                F.struct("cell_size_m", "benchmark_score", "calibration_factor", "zones"),
                F.struct("benchmark_score", "qa_warning_count", "layer_warning_count", "runtime_seconds", "cell_size_m"),
            ).alias("_b")
        )
        .select("area_id", c("_b.cell_size_m").alias("recommended_cell_size_m"), "_b.benchmark_score", "_b.calibration_factor", "_b.zones")
    )
    summary = ok.groupBy("cell_size_m").agg(
        F.count_distinct("area_id").alias("areas"),
        F.count(F.lit(1)).alias("total_runs"),
        F.avg("runtime_seconds").alias("mean_runtime_seconds"),
        F.avg("zones").alias("mean_zones"),
        F.avg("calibration_factor").alias("mean_calibration_factor"),
        F.median("calibration_factor").alias("median_calibration_factor"),
        F.avg("calibration_distance").alias("mean_calibration_distance"),
        F.avg("qa_warning_count").alias("mean_qa_warning_count"),
        F.avg("layer_warning_count").alias("mean_layer_warning_count"),
        F.avg("top_10pct_share").alias("mean_top_10pct_share"),
    )
    scored = summary.withColumn(
        "benchmark_score",
        _size_score(c("mean_calibration_distance"), c("mean_qa_warning_count"), c("mean_layer_warning_count"), c("mean_runtime_seconds")),
    ).orderBy("benchmark_score", "cell_size_m")
    return scored, per_area, scored.limit(1)
