"""Correlations, surface benchmarks, district metrics and uncertainty validation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.contracts import BANDS
from gridspark.functions.scalars import clip, safe_div, to_bool
from gridspark.operators.hotspots import stability_detail, stability_summary
from gridspark.scope import AREA, Scope, all_of, attach, group_agg, materialize, quantiles, running_totals, with_group, with_quantiles, with_rank

GLOBAL = Scope(keys=(), row_id=("area_id", "cell_id"))


def _finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _pearson(a: Column, b: Column) -> Column:
    """Guarded Pearson aggregate: null under two rows or when a side is constant (``corr`` would raise)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varied = (F.count(x) >= 2) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(df: DataFrame, pairs: Mapping[str, tuple[str, str, str]], scope: Scope = AREA) -> DataFrame:
    """B01. Named correlations per group. ``pairs`` maps a name to ``(column, column, method)``.

    A Spearman side is a column seen under a null mask (the rows in which both sides are numbers). Equal sides are
    ranked once. All sides are rows of one long table ``(group, side, value)`` that holds nothing else, so all of
    them are ranked in one go, after equal values were counted (a map-side combine); a pair's ranks meet again by
    its two values, of which equal ones are counted as well. The columns are written first: values that are sums of
    doubles differ in their last bits each time they are computed, and would not meet.
    """
    keys = list(scope.keys)
    columns = list(dict.fromkeys(c for a, b, _ in pairs.values() for c in (a, b)))
    number = {c: f"_c{i}" for i, c in enumerate(columns)}
    work = df.select(*keys, *[_finite(F.col(c)).alias(n) for c, n in number.items()])
    plain = {n: p for n, p in pairs.items() if p[2] == "pearson"}
    ranked = {n: p for n, p in pairs.items() if p[2] != "pearson"}
    if ranked:
        work = materialize(work)
    out = group_agg(work, scope, F.count(F.lit(1)).alias("_rows"), *[_pearson(F.col(number[a]), F.col(number[b])).alias(n) for n, (a, b, _) in plain.items()])
    if ranked:
        wide = _rank_correlations(work, {n: (number[a], number[b]) for n, (a, b, _) in ranked.items()}, scope)
        out = out.join(wide, keys, "left") if keys else out.crossJoin(F.broadcast(wide))  # without keys both have one row
    return out.select(*keys, *pairs)


def _rank_correlations(work: DataFrame, pairs: Mapping[str, tuple[str, str]], scope: Scope) -> DataFrame:
    keys = list(scope.keys)
    sides = {(c, "|".join(sorted(set(p)))): None for p in pairs.values() for c in p}  # column under a mask
    mask = lambda m: all_of([F.col(c).isNotNull() for c in m.split("|")])
    side = lambda c, m: F.struct(F.lit(f"{c}@{m}").alias("_side"), F.when(mask(m), F.col(c)).alias("_v"))
    long = work.select(*keys, F.inline(F.array(*[side(c, m) for c, m in sides]))).where(F.col("_v").isNotNull())
    values = long.groupBy(*keys, "_side", "_v").agg(F.count(F.lit(1)).alias("_m"))
    if scope.small_groups:
        earlier = Window.partitionBy(*keys, "_side").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        placed = values.withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    else:
        placed = running_totals(values, [*keys, "_side"], [("_v", True)], F.col("_m"))
    before = placed.select(*keys, "_side", "_v", (F.col("_before") + (F.col("_m") + 1) / F.lit(2.0)).alias("_rank"))
    before = before if scope.small_groups else materialize(before)  # both sides of each pair read it
    name = lambda n, p: F.struct(
        F.lit(n).alias("_name"),
        F.lit(f"{p[0]}@{'|'.join(sorted(set(p)))}").alias("_sa"),
        F.lit(f"{p[1]}@{'|'.join(sorted(set(p)))}").alias("_sb"),
        F.when(mask("|".join(p)), F.col(p[0])).alias("_x"),
        F.when(mask("|".join(p)), F.col(p[1])).alias("_y"),
    )
    met = work.select(*keys, F.inline(F.array(*[name(n, p) for n, p in pairs.items()]))).where(F.col("_x").isNotNull())
    met = met.groupBy(*keys, "_name", "_sa", "_sb", "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    as_side = lambda s, v, r: before.select(*keys, F.col("_side").alias(s), F.col("_v").alias(v), F.col("_rank").alias(r))
    both = met.join(as_side("_sa", "_x", "_ra"), [*keys, "_sa", "_x"]).join(as_side("_sb", "_y", "_rb"), [*keys, "_sb", "_y"])
    w, a, b = F.col("_w"), F.col("_ra"), F.col("_rb")
    # ranks have the known mean (n + 1) / 2, so one pass of centred sums is exact enough
    sums = both.groupBy(*keys, "_name").agg(
        *[F.sum(x).alias(n) for n, x in {"_n": w, "_sa": w * a, "_sb": w * b, "_saa": w * a * a, "_sbb": w * b * b, "_sab": w * a * b}.items()]
    )
    n = F.col("_n")
    cov = F.col("_sab") - F.col("_sa") * F.col("_sb") / n
    va, vb = F.col("_saa") - F.col("_sa") * F.col("_sa") / n, F.col("_sbb") - F.col("_sb") * F.col("_sb") / n
    rho = F.when((n >= 2) & (va > 0) & (vb > 0), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    scored = sums.select(*keys, "_name", rho.alias("_rho"))
    return scored.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_rho"))).alias(n) for n in pairs])


def top_set(df: DataFrame, column: str, fraction: float, scope: Scope = AREA, out: str = "in_top") -> DataFrame:
    """B03. Flag of the ceil(n * fraction) largest values (at least one); ties by row id."""
    clean = df.withColumn("_v", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
    ranked = with_rank(clean, scope, [("_v", False)], "_pos", "row")
    sized = with_group(ranked, scope, {"_n": F.count(F.lit(1))})
    limit = F.greatest(F.ceil(F.col("_n") * F.lit(fraction)), F.lit(1))
    return sized.withColumn(out, F.col("_pos") <= limit).drop("_v", "_pos", "_n")


def surface_metrics(
    df: DataFrame,
    bench: str,
    surface: str = "surface_value",
    scope: Scope = AREA,
    fraction: float = 0.10,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """B02. Surface against one benchmark: totals, gap, ratio, correlations, top overlap and IoU."""
    zero = F.lit(0.0)
    clean = df.withColumns(
        {"_s": F.coalesce(F.col(surface).cast("double"), zero), "_b": F.coalesce(F.col(bench).cast("double"), zero)}
    )
    flagged = top_set(top_set(clean, "_s", fraction, scope, "_ts"), "_b", fraction, scope, "_tb")
    totals = group_agg(
        flagged,
        scope,
        F.count(F.lit(1)).alias("cell_count"),
        F.sum("_s").alias("surface_total"),
        F.sum("_b").alias("benchmark_total"),
        F.count_if(F.col("_ts") & F.col("_tb")).alias("_both"),
        F.count_if(F.col("_ts") | F.col("_tb")).alias("_any"),
        F.count_if(F.col("_ts")).alias("_top"),
    )
    corr = correlations(clean, {"pearson_r": ("_s", "_b", "pearson"), "spearman_r": ("_s", "_b", "spearman")}, scope)
    joined = totals.join(corr, list(scope.keys), "left") if scope.keys else totals.crossJoin(F.broadcast(corr))
    if coverage is not None:
        joined = attach(joined, coverage, scope)
    else:
        joined = joined.withColumns({"raster_count": F.lit(1).cast("long"), "coverage_ok": F.lit(True)})
    return joined.select(
        *scope.keys,
        F.lit(bench).alias("benchmark_name"),
        "cell_count",
        "raster_count",
        "coverage_ok",
        "surface_total",
        "benchmark_total",
        F.abs(F.col("benchmark_total") - F.col("surface_total")).alias("absolute_gap_total"),
        F.when(F.col("surface_total") > 0, F.try_divide("benchmark_total", "surface_total")).alias("benchmark_ratio"),
        "pearson_r",
        "spearman_r",
        F.try_divide(F.col("_both"), F.greatest(F.col("_top"), F.lit(1))).alias("top_decile_overlap"),
        F.try_divide(F.col("_both"), F.col("_any")).alias("hotspot_iou"),
    )


def external_batch(df: DataFrame, benches: Sequence[str], surface: str = "surface_value", scope: Scope = AREA) -> tuple[DataFrame, DataFrame]:
    """B04. Metrics for every area and product, and their means by product."""
    metrics = None
    for bench in benches:
        part = surface_metrics(df, bench, surface, scope)
        metrics = part if metrics is None else metrics.unionByName(part)
    means = metrics.groupBy("benchmark_name").agg(
        *[F.avg(c).alias(c) for c in ("pearson_r", "spearman_r", "top_decile_overlap", "hotspot_iou")]
    )
    return metrics, means


def district_metrics(districts: DataFrame, scope: Scope, warnings: DataFrame | None = None) -> DataFrame:
    """B05. Errors over flagged districts; shares were computed over all districts of the group.

    Input rows carry ``use_in_metrics, official_population, predicted_population, official_share,
    predicted_share`` (see ``areal_interpolate``).
    """
    official = F.col("official_population").cast("double")
    used = districts.where(F.coalesce(F.col("use_in_metrics"), F.lit(False)) & official.isNotNull()).withColumns(
        {"_o": official, "_p": F.coalesce(F.col("predicted_population").cast("double"), F.lit(0.0))}
    )
    err = F.col("_p") - F.col("_o")
    share_err = F.col("predicted_share") - F.col("official_share")
    agg = group_agg(
        used,
        scope,
        F.count(F.lit(1)).alias("district_count_compared"),
        F.sum("_o").alias("official_total"),
        F.sum("_p").alias("predicted_total"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.try_divide(F.abs(err), F.when(F.col("_o") != 0, F.col("_o")))) * 100.0).alias("mape"),
        F.avg(F.abs(share_err)).alias("share_mae"),
        F.sqrt(F.avg(share_err * share_err)).alias("share_rmse"),
    )
    corr = correlations(used, {"pearson_r": ("_o", "_p", "pearson"), "spearman_r": ("_o", "_p", "spearman")}, scope)
    counts = group_agg(districts, scope, F.count(F.lit(1)).alias("district_count_total"))
    keys = list(scope.keys)
    out = counts.join(agg, keys).join(corr, keys, "left")
    if warnings is not None:
        out = attach(out, warnings, scope)
    else:
        out = out.withColumn("boundary_warning_count", F.lit(0).cast("long"))
    return out.withColumns(
        {
            "district_reference_row_count": F.col("district_count_total"),
            "boundary_warning_count": F.coalesce("boundary_warning_count", F.lit(0)).cast("long"),
            "absolute_gap_total": F.abs(F.col("predicted_total") - F.col("official_total")),
        }
    )


def interval_columns(districts: DataFrame) -> DataFrame:
    """B06. Width, relative width and covered flag from district sums of p10, p50 and p90."""
    width = F.col("predicted_p90") - F.col("predicted_p10")
    inside = (F.col("official_population") >= F.col("predicted_p10")) & (F.col("official_population") <= F.col("predicted_p90"))
    return districts.withColumns(
        {
            "interval_width": width,
            "relative_interval_width": width / F.greatest(F.coalesce("predicted_p50", F.lit(0.0)), F.lit(1e-6)),
            "covered_by_interval": F.coalesce(inside, F.lit(False)),
        }
    )


def district_interval_metrics(districts: DataFrame, scope: Scope) -> DataFrame:
    """B07. Coverage, median widths, p50 error and correlations over flagged districts."""
    districts = materialize(districts)  # every part reads it again
    used = districts.where(
        F.coalesce(F.col("use_in_metrics"), F.lit(False))
        & F.col("official_population").isNotNull()
        & F.col("predicted_p50").isNotNull()
    )
    err = F.col("predicted_p50") - F.col("official_population")
    agg = group_agg(
        used,
        scope,
        F.count(F.lit(1)).alias("district_count_compared"),
        F.avg(F.col("covered_by_interval").cast("double")).alias("coverage_rate"),
        F.sqrt(F.avg(err * err)).alias("p50_rmse"),
    )
    qs = quantiles(
        used,
        scope,
        {"median_interval_width": ("interval_width", 0.5), "median_relative_interval_width": ("relative_interval_width", 0.5)},
    )
    corr = correlations(
        used,
        {
            "p50_pearson_r": ("official_population", "predicted_p50", "pearson"),
            "p50_spearman_r": ("official_population", "predicted_p50", "spearman"),
        },
        scope,
    )
    keys = list(scope.keys)
    counts = group_agg(districts, scope, F.count(F.lit(1)).alias("district_count_total"))
    return counts.join(agg, keys).join(qs, keys, "left").join(corr, keys, "left")


PARTIAL_SOURCE = (
    "Partial carry-forward from a frozen district table. District intervals could not be rebuilt because "
    "the cell-to-district mapping is not part of the package."
)


def partial_district_rows(districts: DataFrame, keys: Sequence[str] = ("area_id",)) -> DataFrame:
    """B08 rows: p50-only district errors with empty interval columns."""
    none = F.lit(None).cast("double")
    err = F.abs(F.col("predicted_population") - F.col("official_population"))
    return districts.select(
        *keys,
        "district_name",
        F.col("official_population").alias("reference_population"),
        none.alias("predicted_p10"),
        F.col("predicted_population").alias("predicted_p50"),
        none.alias("predicted_p90"),
        none.alias("covered_by_interval"),
        err.alias("absolute_error_p50"),
        safe_div(err, F.col("official_population")).alias("relative_error_p50"),
        F.lit(PARTIAL_SOURCE).alias("source_note"),
    )


def partial_district_summary(areas: DataFrame, districts: DataFrame, scope: Scope) -> DataFrame:
    """B08 summary: one row per requested area; areas without a table stay as blocked rows."""
    err = F.abs(F.col("predicted_population") - F.col("official_population"))
    rel = err / F.greatest(F.col("official_population").cast("double"), F.lit(1e-6))
    used = districts.where(to_bool(F.col("use_in_metrics"))).withColumns({"_e": err, "_r": rel})
    agg = group_agg(
        used,
        scope,
        F.count(F.lit(1)).alias("_used"),
        F.avg("_e").alias("mean_absolute_error_p50"),
        F.avg("_r").alias("mean_relative_error_p50"),
    ).join(
        quantiles(used, scope, {"median_absolute_error_p50": ("_e", 0.5), "median_relative_error_p50": ("_r", 0.5)}),
        list(scope.keys),
        "left",
    )
    present = districts.select(*scope.keys).distinct().withColumn("_has", F.lit(True))
    return (
        areas.select(*scope.keys)
        .join(present, list(scope.keys), "left")
        .join(agg, list(scope.keys), "left")
        .withColumns(
            {
                "n_districts_compared": F.coalesce("_used", F.lit(0)).cast("long"),
                "n_districts_covered": F.lit(None).cast("double"),
                "district_interval_coverage_rate": F.lit(None).cast("double"),
                "interpretation_note": F.when(
                    F.col("_has"), "Only a partial district p50 comparison could be carried forward; interval coverage stays blocked."
                ).otherwise("District interval coverage is blocked because no district table was available."),
            }
        )
        .drop("_used", "_has")
    )


def _coverage_note(rate: Column) -> Column:
    return (
        F.when(rate >= 0.80, "The p10-p90 interval captures a large share of held-out targets, supporting bounded interval usefulness.")
        .when(rate >= 0.60, "The p10-p90 interval shows moderate held-out coverage; uncertainty is informative but not uniformly tight.")
        .otherwise("The p10-p90 interval covers a limited share of held-out targets, so uncertainty should be interpreted cautiously.")
    )


def interval_coverage(df: DataFrame, protocol: str, scope: Scope = AREA) -> DataFrame:
    """B09. Shares of targets inside, below and above the interval, with mean and median widths."""
    t, lo, hi = F.col("weak_target"), F.col("p10"), F.col("p90")
    valid = df.where(t.isNotNull() & lo.isNotNull() & hi.isNotNull())
    share = lambda cond: F.avg(cond.cast("double"))
    agg = group_agg(
        valid,
        scope,
        F.count(F.lit(1)).alias("n_cells"),
        share((t >= lo) & (t <= hi)).alias("coverage_p10_p90"),
        share(t < lo).alias("below_p10_share"),
        share(t > hi).alias("above_p90_share"),
        F.avg("uncertainty_width").alias("mean_interval_width"),
        F.avg("relative_uncertainty").alias("mean_relative_uncertainty"),
    )
    qs = quantiles(
        valid,
        scope,
        {"median_interval_width": ("uncertainty_width", 0.5), "median_relative_uncertainty": ("relative_uncertainty", 0.5)},
    )
    return agg.join(qs, list(scope.keys), "left").withColumns(
        {"protocol": F.lit(protocol), "interpretation_note": _coverage_note(F.col("coverage_p10_p90"))}
    )


def error_alignment(df: DataFrame, protocol: str, scope: Scope = AREA) -> DataFrame:
    """B10. Eight correlations of the error with uncertainty measures, and mean error by band."""
    against = {
        "uncertainty_width": "uncertainty_width",
        "relative_uncertainty": "relative_uncertainty",
        "confidence_score": "confidence_score",
        "model_stability": "model_stability_score",
    }
    pairs = {
        f"{method}_error_vs_{name}": ("absolute_error_p50", column, method)
        for name, column in against.items()
        for method in ("pearson", "spearman")
    }
    corr = correlations(df, pairs, scope)
    error = F.col("absolute_error_p50")
    agg = group_agg(
        df,
        scope,
        F.count(F.lit(1)).alias("n_cells"),
        F.count(error).alias("_known"),
        *[F.avg(F.when(F.col("confidence_band") == b, error)).alias(f"mean_error_{b}_confidence") for b in BANDS],
    )
    aligned = (F.col("spearman_error_vs_relative_uncertainty") > 0) | (F.col("spearman_error_vs_confidence_score") < 0)
    note = F.when(aligned, "Higher error generally concentrates in higher-uncertainty or lower-confidence cells.").otherwise(
        "Error-vs-uncertainty alignment is weak or mixed in this area and should be interpreted cautiously."
    )
    return (
        agg.where(F.col("_known") > 0)
        .join(corr, list(scope.keys), "left")
        .withColumns({"protocol": F.lit(protocol), "interpretation_note": note})
        .drop("_known")
    )


def monotonicity_buckets(
    df: DataFrame,
    uncertainty: str = "relative_uncertainty",
    error: str = "absolute_error_p50",
    bins: int = 5,
    scope: Scope = GLOBAL,
) -> DataFrame:
    """B11 buckets: equal-frequency buckets of first-come ranks, with mean uncertainty and error.

    The bucket of rank r in 1..n is ``greatest(ceil((r-1)*q/(n-1)) - 1, 0)``.
    """
    valid = df.where(F.col(uncertainty).isNotNull() & F.col(error).isNotNull())
    sizes = group_agg(
        valid, scope, F.count(F.lit(1)).alias("_n"), F.count_distinct(F.col(uncertainty)).alias("_d")
    ).select(
        *scope.keys, "_n", F.least(F.greatest(F.lit(2), F.lit(int(bins))), F.greatest(F.lit(2), F.col("_d"))).alias("_q")
    )
    ranked = attach(with_rank(valid, scope, [(uncertainty, True)], "_r", "row"), sizes, scope)
    step = F.try_divide((F.col("_r") - 1) * F.col("_q"), F.col("_n") - 1)
    bucket = F.coalesce(F.greatest(F.ceil(step) - 1, F.lit(0)), F.lit(0)).cast("long")
    return ranked.groupBy(*scope.keys, bucket.alias("uncertainty_bucket")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(uncertainty).alias("mean_uncertainty"),
        F.avg(error).alias("mean_abs_error"),
    )


def monotonicity_metrics(
    df: DataFrame,
    buckets: DataFrame,
    uncertainty: str = "relative_uncertainty",
    error: str = "absolute_error_p50",
    scope: Scope = GLOBAL,
) -> DataFrame:
    """B11 metrics: correlations, first and last bucket error, non-decreasing flag."""
    valid = df.where(F.col(uncertainty).isNotNull() & F.col(error).isNotNull())
    corr = correlations(
        valid,
        {
            "error_uncertainty_pearson": (uncertainty, error, "pearson"),
            "error_uncertainty_spearman": (uncertainty, error, "spearman"),
        },
        scope,
    )
    means = F.transform(F.array_sort(F.collect_list(F.struct("uncertainty_bucket", "mean_abs_error"))), lambda s: s["mean_abs_error"])
    flags = buckets.groupBy(*scope.keys).agg(
        F.min_by("mean_abs_error", "uncertainty_bucket").alias("mean_abs_error_lowest_bucket"),
        F.max_by("mean_abs_error", "uncertainty_bucket").alias("mean_abs_error_highest_bucket"),
        means.alias("_m"),  # at most `bins` values
    )
    flags = flags.withColumn("monotonic_non_decreasing", (F.col("_m") == F.array_sort("_m")).cast("double")).drop("_m")
    return flags.join(corr, list(scope.keys)) if scope.keys else flags.crossJoin(F.broadcast(corr))


def band_validation(df: DataFrame, scope: Scope = AREA) -> DataFrame:
    """B12. One row per area and confidence band."""
    fine = scope.finer("confidence_band", factor=len(BANDS) + 1)
    priority = F.col("hotspot_priority_class") != "not_priority"
    agg = group_agg(
        df,
        fine,
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("p50").alias("mean_p50"),
        F.avg("uncertainty_width").alias("mean_uncertainty_width"),
        F.avg("absolute_error_p50").alias("mean_error_if_available"),
        F.avg(priority.cast("double")).alias("share_hotspot_priority_cells"),
    )
    qs = quantiles(df, fine, {"median_p50": ("p50", 0.5), "median_relative_uncertainty": ("relative_uncertainty", 0.5)})
    sizes = agg.groupBy(*scope.keys).agg(F.sum("n_cells").alias("_n"))
    note = F.when(
        F.col("confidence_band").isin("high", "medium"),
        "This confidence band retains the expected bounded relationship between uncertainty burden and proxy usefulness.",
    ).otherwise("Low-confidence cells should be treated as review-oriented or caution-heavy within the proxy framework.")
    return (
        agg.join(qs, list(fine.keys), "left")
        .join(sizes, list(scope.keys))
        .withColumns({"share_cells": F.col("n_cells") / F.col("_n"), "interpretation_note": note})
        .drop("_n")
    )


def _product_rows(df: DataFrame, products: Sequence[str], surface: str, scope: Scope) -> DataFrame:
    items = [
        F.struct(
            F.lit(p).alias("benchmark_name"),
            F.abs(F.coalesce(F.col(surface), F.lit(0.0)) - F.coalesce(F.col(p), F.lit(0.0))).alias("disagreement"),
        )
        for p in products
    ]
    return df.select(
        *scope.keys,
        *scope.row_id,
        F.coalesce(F.col("relative_uncertainty"), F.lit(0.0)).alias("_u"),
        F.explode(F.array(*items)).alias("_e"),
    ).select(*scope.keys, *scope.row_id, "_u", "_e.*")


def disagreement(df: DataFrame, products: Sequence[str], surface: str = "surface_value", scope: Scope = AREA) -> DataFrame:
    """B13. Disagreement with each product against relative uncertainty, in one pass over products."""
    long = _product_rows(df, products, surface, scope)
    fine = scope.finer("benchmark_name", factor=len(products))
    marked = with_quantiles(long, fine, {"_hi": ("_u", 0.90), "_lo": ("_u", 0.10)})
    agg = group_agg(
        marked,
        fine,
        F.count(F.lit(1)).alias("row_count"),
        F.avg(F.when(F.col("_u") >= F.col("_hi"), F.col("disagreement"))).alias("high_uncertainty_mean_disagreement"),
        F.avg(F.when(F.col("_u") <= F.col("_lo"), F.col("disagreement"))).alias("low_uncertainty_mean_disagreement"),
    )
    corr = correlations(
        long,
        {
            "disagreement_uncertainty_pearson": ("_u", "disagreement", "pearson"),
            "disagreement_uncertainty_spearman": ("_u", "disagreement", "spearman"),
        },
        fine,
    )
    return agg.join(corr, list(fine.keys), "left")


def disagreement_report(surface: DataFrame, aligned: DataFrame, products: Sequence[str], scope: Scope = AREA) -> DataFrame:
    """B14. B13 on saved tables (inner join on the cell) plus uncertainty at q90 / q10 of disagreement."""
    joined = surface.join(aligned.select(*scope.keys, *scope.row_id, *products), [*scope.keys, *scope.row_id])
    base = disagreement(joined, products, "p50", scope)
    long = _product_rows(joined, products, "p50", scope)
    fine = scope.finer("benchmark_name", factor=len(products))
    marked = with_quantiles(long, fine, {"_hi": ("disagreement", 0.90), "_lo": ("disagreement", 0.10)})
    at = group_agg(
        marked,
        fine,
        F.avg(F.when(F.col("disagreement") >= F.col("_hi"), F.col("_u"))).alias("mean_uncertainty_high_disagreement"),
        F.avg(F.when(F.col("disagreement") <= F.col("_lo"), F.col("_u"))).alias("mean_uncertainty_low_disagreement"),
    )
    note = F.when(
        F.col("disagreement_uncertainty_spearman") > 0,
        "Higher disagreement tends to coincide with higher relative uncertainty.",
    ).otherwise("Disagreement alignment is weak or mixed for this benchmark and should be interpreted cautiously.")
    return base.join(at, list(fine.keys)).select(
        *scope.keys,
        F.col("benchmark_name").alias("benchmark_product"),
        F.col("row_count").alias("n_cells"),
        F.concat(F.lit("absolute_difference_to_"), F.col("benchmark_name")).alias("disagreement_metric"),
        F.lit("relative_uncertainty").alias("uncertainty_metric"),
        F.col("disagreement_uncertainty_pearson").alias("pearson_disagreement_vs_uncertainty"),
        F.col("disagreement_uncertainty_spearman").alias("spearman_disagreement_vs_uncertainty"),
        "mean_uncertainty_high_disagreement",
        "mean_uncertainty_low_disagreement",
        note.alias("interpretation_note"),
    )


def proxy_check(surface: DataFrame, weak: DataFrame, scope: Scope = AREA, protocol: str = "inference_only_proxy_check") -> DataFrame:
    """B15. Interval surface with the recomputed weak target: covered flag and absolute error."""
    joined = surface.join(weak.select(*scope.keys, *scope.row_id, "weak_target"), [*scope.keys, *scope.row_id], "left")
    t = F.col("weak_target")
    return joined.withColumns(
        {
            "protocol": F.lit(protocol),
            "covered_by_interval": F.coalesce((t >= F.col("p10")) & (t <= F.col("p90")), F.lit(False)),
            "absolute_error_p50": F.abs(F.col("p50") - t),
        }
    )


def concentration(df: DataFrame, column: str, scope: Scope = AREA, top_share: float = 0.10) -> DataFrame:
    """B16. Share of the group's total that lies in its top cells; 0 when the total is not positive."""
    clean = df.withColumn("_c", clip(F.coalesce(F.col(column).cast("double"), F.lit(0.0))))
    flagged = top_set(clean, "_c", top_share, scope)
    top = F.sum(F.when(F.col("in_top"), F.col("_c")).otherwise(F.lit(0.0)))
    return group_agg(
        flagged, scope, F.when(F.sum("_c") > 0, F.try_divide(top, F.sum("_c"))).otherwise(F.lit(0.0)).alias("top_share")
    )


def validation_package(
    held_out: DataFrame | None,
    in_sample: DataFrame,
    run_id: str,
    scope: Scope = AREA,
    bins: int = 5,
) -> dict[str, DataFrame]:
    """B17. Validation tables of both protocols with a ``protocol`` column; a missing one leaves a blocker row.

    ``held_out`` and ``in_sample`` are cell diagnostics with ``weak_target`` and ``absolute_error_p50``.
    """
    spark = in_sample.sparkSession
    in_sample = materialize(in_sample)  # every table reads it again
    held_out = materialize(held_out) if held_out is not None else None
    runs = {"inference_only_proxy_check": in_sample}
    blockers = []
    if held_out is not None:
        runs["locov_like"] = held_out
    else:
        blockers.append(("locov_like", "blocked: no held-out diagnostics were supplied"))
    tables: dict[str, DataFrame] = {}

    def add(name, part):
        part = part.withColumn("run_id", F.lit(run_id))
        tables[name] = tables[name].unionByName(part) if name in tables else part

    for protocol, frame in runs.items():
        add("interval_coverage", interval_coverage(frame, protocol, scope))
        add("error_alignment", error_alignment(frame, protocol, scope))
        add("band_validation", band_validation(frame, scope).withColumn("protocol", F.lit(protocol)))
    main = held_out if held_out is not None else in_sample
    add("monotonicity", monotonicity_buckets(main, bins=bins))
    detail = stability_detail(in_sample, scope)
    add("hotspot_stability", stability_summary(detail, scope))
    tables["blockers"] = spark.createDataFrame(blockers, "protocol string, status string")
    return tables
