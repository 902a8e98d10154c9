"""Ensembles: member fits on bootstrap draws, member predictions, validation, persistence."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalars import forward_target
from gridspark.operators import training as T
from gridspark.operators.hotspots import hotspot_class
from gridspark.operators.moments import training_moments
from gridspark.operators.scaling import calibrate
from gridspark.operators.stats import correlations
from gridspark.operators.uncertainty import SEED_STEP, align_to_total, band, bootstrap, confidence, stability, summarize_members
from gridspark.scope import AREA, Scope, attach, materialize, stage


def member_id(i: int) -> str:
    return f"member_{i:02d}"


def _drawn(rows: DataFrame, config: T.TrainingConfig, seeds: dict[str, int], groups: Scope) -> DataFrame:
    """Every member's draws as ``group`` (the member), ``fold``, ``weight``, the features and ``y``."""
    listed = F.array(*[F.struct(F.lit(n).alias("member_id"), F.lit(s).cast("long").alias("_member_seed")) for n, s in seeds.items()])
    each = rows.withColumn("_m", F.explode(listed)).select("*", "_m.*").drop("_m")
    drawn = bootstrap(each, F.col("_member_seed"), groups, ("member_id",))
    fold = F.col("fold").cast("long") if "fold" in rows.columns else F.lit(0)
    label = forward_target(F.col(config.target).cast("double"), config.log_target)
    return drawn.select(F.col("member_id").alias("group"), fold.alias("fold"), F.col("draws").alias("weight"), *[F.col(c).cast("double").alias(c) for c in config.features], label.alias("y"))


def train_ensemble(df: DataFrame, config: T.TrainingConfig, members: int = 9, within_area: bool = True, scope: Scope = AREA) -> tuple[dict, DataFrame]:
    """U03. One model per member, each on its own bootstrap of the rows, and the member manifest.

    Ridge: draws are weights of moments that one pass sums per member; members are solved side by side, and the number of
    Spark jobs does not depend on theirs. Trees: draws become row copies, so weights and leaf sizes count them.
    """
    rows = materialize(df)
    groups = scope if within_area else Scope(keys=(), row_id=(*scope.keys, *scope.row_id))
    seeds = {member_id(i + 1): config.seed + SEED_STEP * i for i in range(members)}

    def fit_one(item):
        name, seed = item
        drawn = bootstrap(rows, F.lit(seed).cast("long"), groups)
        copies = drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("draws").cast("int")))).drop("_copy")
        return name, T.fit(copies, replace(config, seed=seed))

    if config.model == "ridge":
        fitted = training_moments(_drawn(rows, config, seeds, groups), config.features, whole=True).ridge(config.features, config.alpha)
        models = {r["group"]: T.RidgeModel(tuple(config.features), *(r[c] for c in ("median", "mean", "std", "weights", "center"))) for r in sorted(fitted.collect())}
    else:
        with ThreadPoolExecutor(max_workers=max(1, config.parallel_fits)) as pool:
            models = dict(pool.map(fit_one, seeds.items()))
    size = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("area_id").alias("area_count"))
    listed = df.sparkSession.createDataFrame([(n, int(s)) for n, s in seeds.items()], "member_id string, seed long")
    return models, listed.crossJoin(F.broadcast(size)).withColumn("bootstrap_within_area", F.lit(within_area))


def predict_members(models: dict, cells: DataFrame, config: T.TrainingConfig) -> DataFrame:
    """U04. Long member predictions: every cell once per member."""
    parts = [T.predict_raw(m, cells, config.features, config.log_target).withColumn("member_id", F.lit(n)) for n, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def cv_uncertainty(df: DataFrame, config: T.TrainingConfig, members: int = 9, context: DataFrame | None = None, scope: Scope = AREA) -> tuple[DataFrame, DataFrame]:
    """U15. Held-out cell diagnostics and fold metrics; stability and hotspot scopes are the *fold*.

    ``context`` (optional) has one row per area with ``completeness_support, completeness_label,
    internal_support_score``.
    """
    folded, unit = T.with_folds(df, config, scope)
    rows = materialize(T._fold_total(folded, config, unit))
    keep = ["area_id", "fold", "fold_group", "fold_total", "cell_id", config.target]

    def run(train, held, _):
        models, _m = train_ensemble(train, config, members, scope=scope)
        return predict_members(models, held, config).select(*keep, "member_id", "pred")

    if config.model == "ridge" and unit == "city":
        # a fold is an area and draws stay within areas: leaving a fold out takes its own draws from each member's moments
        seeds = {member_id(i + 1): config.seed + SEED_STEP * i for i in range(members)}
        models = training_moments(_drawn(rows, config, seeds, scope), config.features).ridge(config.features, config.alpha)
        asked = rows.withColumn("member_id", F.explode(F.array(*[F.lit(n) for n in seeds])))
        long = T.predict_linear(asked, models.withColumnRenamed("group", "member_id"), config, ("fold", "member_id"), "pred").select(*keep, "member_id", "pred")
    else:
        long = reduce(DataFrame.unionByName, T.over_folds(rows, replace(config, parallel_fits=1), run))
    long = materialize(long)
    groups = Scope(("fold", "fold_group"), ("area_id", "cell_id"))
    cal = calibrate(long, "pred", "fold_total", Scope(("fold", "fold_group", "member_id"), ("cell_id",)), "pred_calibrated")
    summary = stage(summarize_members(cal, scope=groups, keep=("fold_total", config.target)), groups)
    aligned = stage(align_to_total(summary, "fold_total", groups), groups)
    fold = Scope(("fold",), ("area_id", "cell_id"))
    steady = stability(aligned, fold)
    if context is not None:
        steady = attach(steady, context, scope)
    default = {"completeness_support": 0.0, "completeness_label": "unknown", "internal_support_score": 0.50}
    known = {n: F.coalesce(F.col(n), F.lit(v)) if n in steady.columns else F.lit(v) for n, v in default.items()}
    scored = confidence(steady.withColumns({**known, "external_agreement_score": F.lit(0.50)}))
    banded = stage(scored.withColumn("confidence_band", band(F.col("confidence_score"))), fold)
    t = F.col(config.target).cast("double")
    diag = hotspot_class(banded, fold).withColumns(
        {
            "weak_target": t,
            "protocol": F.lit("locov_like"),
            "validation_protocol": F.lit(config.protocol),
            "covered_by_interval": (t >= F.col("p10")) & (t <= F.col("p90")),
            "absolute_error_p50": F.abs(F.col("p50") - t),
        }
    )
    diag = materialize(diag)
    corr = correlations(
        diag,
        {
            "error_uncertainty_pearson": ("relative_uncertainty", "absolute_error_p50", "pearson"),
            "error_uncertainty_spearman": ("relative_uncertainty", "absolute_error_p50", "spearman"),
        },
        fold,
    )
    # low_band holds the rows of high confidence and the other way round, as in the published tables
    by_band = lambda b: F.avg(F.when(F.col("confidence_band") == b, F.col("absolute_error_p50")))
    metrics = diag.groupBy("fold", "validation_protocol").agg(
        F.count(F.lit(1)).alias("rows"), by_band("high").alias("low_band_mean_abs_error"), by_band("low").alias("high_band_mean_abs_error")
    )
    return diag, metrics.join(corr, "fold", "left")


def save_ensemble(models: dict, manifest: DataFrame, path: str) -> None:
    """U16. One model folder per member and the manifest table."""
    for name, model in models.items():
        kind = "ridge" if isinstance(model, T.RidgeModel) else "pipeline"
        T.save_model(model, f"{path}/{name}", manifest.where(F.col("member_id") == name).withColumn("model", F.lit(kind)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_ensemble(spark, path: str) -> tuple[dict, DataFrame]:
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [r["member_id"] for r in manifest.select("member_id").orderBy("member_id").collect()]  # one per member
    return {n: T.load_model(spark, f"{path}/{n}")[0] for n in names}, manifest
