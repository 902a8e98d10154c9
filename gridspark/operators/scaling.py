"""Per-area feature scaling, weak targets and calibration to official totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import COMBINED_COLUMNS, PROXY_EPSILON, PROXY_WEIGHTS
from gridspark.functions.scalars import clip
from gridspark.scope import AREA, Scope, stage, with_group


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _scaled(value: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(F.try_divide(value - lo, F.when(hi != lo, hi - lo)), F.lit(0.0))


def _with_scaled(df: DataFrame, scope: Scope, exprs: Mapping[str, Column]) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Attach min/max of each expression; returns the scaled columns and the helper names to drop."""
    bounds = {}
    for i, expr in enumerate(exprs.values()):
        bounds |= {f"_lo{i}": F.min(expr), f"_hi{i}": F.max(expr)}
    joined = with_group(df, scope, bounds)
    scaled = {n: _scaled(e, F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, (n, e) in enumerate(exprs.items())}
    return joined, scaled, list(bounds)


def minmax(df: DataFrame, cols: Sequence[str], scope: Scope = AREA, suffix: str = "_scaled") -> DataFrame:
    """F01. Min-max per group; constant columns and nulls scale to 0."""
    joined, scaled, helpers = _with_scaled(df, scope, {c: F.col(c).cast("double") for c in cols})
    return joined.withColumns({f"{c}{suffix}": scaled[c] for c in cols}).drop(*helpers)


def combined_index(df: DataFrame, cols: Sequence[str] = COMBINED_COLUMNS, scope: Scope = AREA) -> DataFrame:
    """F02. Sum of min-max scaled columns that are present."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df.withColumn("combined_index", F.lit(0.0))
    joined, scaled, helpers = _with_scaled(df, scope, {c: _num(c) for c in present})
    return joined.withColumn("combined_index", reduce(lambda a, b: a + b, scaled.values())).drop(*helpers)


def proxy_score(
    df: DataFrame,
    weights: Mapping[str, float] = PROXY_WEIGHTS,
    scope: Scope = AREA,
    log_transform: bool = True,
    clip_negative: bool = True,
) -> DataFrame:
    """F03. Weighted sum of min-max scaled log1p features."""
    present = [c for c in weights if c in df.columns]
    if not present:
        return df.withColumn("proxy_score", F.lit(0.0))

    def base(c):
        v = clip(_num(c)) if clip_negative else _num(c)
        return F.log1p(v) if log_transform else v

    joined, scaled, helpers = _with_scaled(df, scope, {c: base(c) for c in present})
    total = reduce(lambda a, b: a + b, [scaled[c] * float(weights[c]) for c in present])
    return joined.withColumn("proxy_score", clip(total)).drop(*helpers)


def allocate(df: DataFrame, total: str = "official_total", scope: Scope = AREA, epsilon: float = PROXY_EPSILON) -> DataFrame:
    """F04. Spread the group's total over its cells by proxy score; equal parts when the scores sum to 0."""
    scored = df if "proxy_score" in df.columns else proxy_score(df, scope=scope)
    adjusted = F.col("proxy_score") + epsilon
    joined = with_group(stage(scored, scope), scope, {"_sum": F.sum(adjusted), "_n": F.count(F.lit(1))})
    share = F.when(F.col("_sum") <= 0, 1.0 / F.col("_n")).otherwise(F.try_divide(adjusted, F.col("_sum")))
    return (
        joined.withColumn("weak_share", share)
        .withColumn("weak_target", F.col("weak_share") * F.col(total))
        .drop("_sum", "_n")
    )


def calibrate(df: DataFrame, pred: str, total: str, scope: Scope = AREA, out: str = "calibrated") -> DataFrame:
    """F05. Rescale non-negative predictions so that each group sums to its total."""
    value = clip(_num(pred))
    joined = with_group(df, scope, {"_sum": F.sum(value), "_n": F.count(F.lit(1))})
    fair = F.col(total) / F.col("_n")
    scaled = F.try_divide(value, F.col("_sum")) * F.col(total)
    return joined.withColumn(out, F.when(F.col("_sum") <= 0, fair).otherwise(scaled)).drop("_sum", "_n")


def calibration_factor(df: DataFrame, raw: str, total: str, scope: Scope = AREA) -> DataFrame:
    """F06. Total over raw sum per group, 0 when the raw sum is not positive."""
    joined = with_group(df, scope, {"_raw": F.sum(_num(raw))})
    factor = F.when(F.col("_raw") > 0, F.try_divide(F.col(total).cast("double"), F.col("_raw"))).otherwise(F.lit(0.0))
    return joined.withColumn("calibration_factor", factor).drop("_raw")
