"""Result packages: several tables from one input that is computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import hotspots as H
from gridspark.operators.quality import validate_ranked
from gridspark.scope import AREA, Scope, materialize


def hotspot_package(df: DataFrame, top_n: int = 25, scope: Scope = AREA, strict: bool = False) -> dict[str, DataFrame]:
    """H07. Validate every area, then four tables; failing areas go to ``rejected_areas`` instead.

    The input feeds six branches, so it is written to the checkpoint folder once. ``strict`` raises as
    soon as an area fails.
    """
    source = materialize(df)
    failures = validate_ranked(source, scope)
    if strict and failures.limit(1).count():
        raise ValueError("hotspot package input failed validation; see validate_ranked")
    bad = failures.select(*scope.keys).distinct()
    good = source.join(bad, list(scope.keys), "left_anti")
    return {
        "summary": H.hotspot_summary(good, scope),
        "top": H.top_hotspots(good, top_n, scope),
        "caution": H.caution(good),
        "stable": H.stable(good),
        "rejected_areas": bad,
        "failures": failures.withColumn("package", F.lit("hotspots")),
    }
