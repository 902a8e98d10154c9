"""Status registry of areas and queries on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalars import norm_optional

KEY = "normalized_city_name"


def _keyed(df: DataFrame, name: str = "city_name") -> DataFrame:
    return df.withColumn(KEY, norm_optional(F.col(name))).where(F.col(KEY).isNotNull())


def build_registry(
    totals: DataFrame,
    features: DataFrame,
    qa_summary: DataFrame,
    qa_flags: DataFrame,
    training: DataFrame,
    smoke: DataFrame,
    runs: DataFrame,
    districts: DataFrame,
    references: DataFrame,
) -> DataFrame:
    """Q12. One row per area named in any of the evidence tables, with flags, counts, quality and label.

    Each evidence table is reduced to one row per key (mergeable aggregates) before the joins, so an area
    named by millions of rows is one row when it meets the others. All carry ``city_name``.
    """
    seen = lambda df, flag: _keyed(df).select(KEY).distinct().withColumn(flag, F.lit(True))
    base = _keyed(totals).groupBy(KEY).agg(
        F.max_by(F.struct("city_name", "country", "population", "reference_date", "verified"), "population").alias("_t")
    )
    feat = _keyed(features).groupBy(KEY).agg(F.max("source_file").alias("feature_source_file"), F.sum("row_count").alias("feature_row_count"))
    qa = _keyed(qa_summary).groupBy(KEY).agg(F.max("high_zero_share_feature_count").alias("qa_high_zero_share_feature_count"))
    flags = _keyed(qa_flags).groupBy(KEY).agg(
        F.count_if(F.col("severity") == "error").alias("qa_error_count"), F.count_if(F.col("severity") == "warning").alias("qa_warning_count")
    )
    dist = _keyed(districts).groupBy(KEY).agg(
        F.lit(True).alias("district_benchmark_completed"),
        F.max(F.coalesce("district_reference_row_count", "district_count_total")).alias("district_benchmark_reference_row_count"),
        F.max("district_count_total").alias("district_benchmark_district_count_total"),
        F.max("district_count_compared").alias("district_benchmark_district_count_compared"),
        F.max("boundary_warning_count").alias("district_benchmark_boundary_warning_count"),
    )
    named = [base, feat, qa, flags, seen(training, "included_in_training"), seen(smoke, "smoke_passed"), seen(runs, "saved_inference_example"), dist]
    keys = named[0].select(KEY)
    for df in named[1:]:
        keys = keys.unionByName(df.select(KEY))
    out = keys.distinct()
    for df in [*named, seen(references, "district_benchmark_reference_available")]:
        out = out.join(df, KEY, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    known = F.col("_t").isNotNull()
    out = out.withColumns(
        {
            "city_name": F.coalesce("_t.city_name", F.initcap(F.col(KEY))),
            "country": F.coalesce("_t.country", F.when(known, F.lit("")).otherwise("Unknown")),
            "population": F.col("_t.population"),
            "reference_date": F.col("_t.reference_date"),
            "verified": F.coalesce("_t.verified", F.lit(False)),
            "official_total_available": known,
            "supported_for_calibrated_inference": known,
            "feature_generated": F.col("feature_row_count").isNotNull(),
            "feature_source_file": F.coalesce("feature_source_file", F.lit("")),
            **{c: zero(c) for c in out.columns if c.endswith("_count") or c.endswith("_total") or c.endswith("_compared")},
            **{
                c: yes(c)
                for c in ("included_in_training", "smoke_passed", "saved_inference_example", "district_benchmark_completed", "district_benchmark_reference_available")
            },
        }
    ).drop("_t")
    out = out.withColumn("qa_passed", F.col("feature_generated") & (F.col("qa_error_count") == 0))
    out = out.withColumn("validated_batch", F.col("qa_passed") & F.col("included_in_training"))
    complete = (
        (F.col("district_benchmark_reference_row_count") > 0)
        & (F.col("district_benchmark_district_count_compared") == F.col("district_benchmark_reference_row_count"))
        & (F.col("district_benchmark_boundary_warning_count") == 0)
    )
    done = F.col("district_benchmark_completed")
    out = out.withColumns(
        {
            "recommended_for_baseline_use": F.col("validated_batch"),
            "district_benchmark_quality": F.when(done & complete, "full").when(done, "partial").otherwise("none"),
            "display_query": F.when(F.trim("country") != "", F.concat_ws(", ", "city_name", "country")).otherwise(F.col("city_name")),
        }
    )
    return out.withColumn("status_label", _status()).orderBy(
        F.desc("recommended_for_baseline_use"), F.desc("supported_for_calibrated_inference"), "city_name"
    )


def _status() -> Column:
    valid, quality = F.col("validated_batch"), F.col("district_benchmark_quality")
    total = F.col("official_total_available")
    return (
        F.when(valid & (quality == "full"), "validated_district_benchmark")
        .when(valid & (quality == "partial"), "validated_partial_district_benchmark")
        .when(valid & F.col("smoke_passed"), "validated_smoke_passed")
        .when(valid, "validated_batch")
        .when(total & F.col("saved_inference_example"), "calibrated_runtime_only")
        .when(total, "official_total_only")
        .when(F.col("feature_generated"), "feature_only")
        .otherwise("untracked")
    )


def select_areas(registry: DataFrame, flag: str) -> DataFrame:
    """Q13. Names and display queries of areas with a flag set."""
    return registry.where(F.coalesce(F.col(flag), F.lit(False))).select(KEY, "city_name", "display_query")


def find_area(registry: DataFrame, names: DataFrame, name: str = "query") -> DataFrame:
    """Q13. Registry row per asked name (normalised before the comma), null where unknown."""
    key = norm_optional(F.split(F.col(name), ",")[0])
    return names.withColumn(KEY, key).join(registry, KEY, "left")
