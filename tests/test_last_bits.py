"""Values whose last bits change with every evaluation, as those of sums of doubles over a cluster do."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.operators import quality as Q
from gridspark.operators import stats as B
from gridspark.scope import AREA, Scope

def unsteady(c):
    return (F.col(c) if isinstance(c, str) else c) + F.expr("cast(java_method('java.lang.Math', 'random') as double)") * 1e-6


def cells(spark, n=60):
    df = spark.range(n).select((F.col("id") % 1).alias("area_id"), F.format_string("Z%04d", "id").alias("cell_id"), F.col("id").cast("double").alias("v"))
    return df.repartition(3)


@pytest.mark.parametrize("measured", [True, False])
def test_rank_correlation_of_unsteady_values(spark, measured):
    df = cells(spark).select("area_id", "cell_id", unsteady("v").alias("a"), unsteady(F.col("v") * 2).alias("b"))
    scope = Scope(groups=1, max_rows=60) if measured else AREA
    row = B.correlations(df, {"s": ("a", "b", "spearman"), "p": ("a", "b", "pearson")}, scope).first()
    assert abs(row["s"] - 1) < 1e-9 and abs(row["p"] - 1) < 1e-9


def test_district_intervals_of_unsteady_sums(spark):
    d = cells(spark, 5).select(
        "area_id",
        F.col("cell_id").alias("district_name"),
        F.lit(True).alias("use_in_metrics"),
        (F.col("v") + 10).alias("official_population"),
        *[unsteady(F.col("v") + 10 + i).alias(f"predicted_{p}") for i, p in enumerate(("p10", "p50", "p90"), -1)],
    )
    scope = Scope(("area_id",), ("district_name",), 1, 5)
    row = B.district_interval_metrics(B.interval_columns(d), scope).first()
    assert row["district_count_compared"] == 5 and row["coverage_rate"] == 1.0 and abs(row["p50_spearman_r"] - 1) < 1e-9


def test_monotonicity_of_unsteady_values(spark):
    df = cells(spark).select("area_id", "cell_id", unsteady("v").alias("relative_uncertainty"), unsteady(F.col("v") * 2).alias("absolute_error_p50"))
    row = B.monotonicity_metrics(df, B.monotonicity_buckets(df)).first()
    assert row["monotonic_non_decreasing"] == 1.0 and abs(row["error_uncertainty_spearman"] - 1) < 1e-9


def test_ranked_surface_of_unsteady_values(spark):
    """Neighbours are closer than what an evaluation changes; ranks fit the values of one evaluation."""
    dealt = cells(spark).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("area_id")))  # what follows is no part of the shuffle
    p50 = dealt.select("area_id", "cell_id", unsteady(F.col("n") / 60.0).alias("p50"))
    surface = p50.select(
        "area_id",
        "cell_id",
        *[(F.col("p50") + d).alias(p) for p, d in (("p10", -0.5), ("p50", 0.0), ("p90", 0.5))],
        F.lit(1.0).alias("uncertainty_width"),
        F.lit(0.5).alias("confidence_score"),
        F.lit("medium").alias("confidence_band"),
        F.lit("not_priority").alias("hotspot_priority_class"),
        F.lit(60.0).alias("official_total"),
        F.dense_rank().over(Window.partitionBy("area_id").orderBy(F.desc("p50"))).alias("hotspot_rank"),
    )
    found = Q.validate_ranked(surface, Scope(groups=1, max_rows=60))
    assert [r["check"] for r in found.collect() if r["check"] != "total_gap"] == []
