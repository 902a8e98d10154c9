"""Areal-surface analytics as PySpark DataFrame operators."""

from gridspark.scope import AREA, Scope, attach, quantiles, with_rank

__all__ = ["AREA", "Scope", "attach", "quantiles", "with_rank"]
