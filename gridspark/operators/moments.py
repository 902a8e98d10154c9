"""Ridge models of many training parts from one pass over the rows.

A training part is all rows of a group (an ensemble member, with draws as weights) but those of one fold. Weighted second
moments are summed per (group, fold) once; those of a training part are the group's total less the fold's own. Features
with nulls bring two columns, the value (0 where null) and a mark for null, so that filling the nulls of a part with its
median is algebra on its matrix, and no row is read again.

The median of a part is found by rank, for all parts at once: with the distinct values in order, an own group of equal
values that has ``G`` rows of all folds and ``J`` of its own fold before it has ``G - J`` rows of the part before it. So
the part's row of rank p stands at rank p + (own rows with G - J <= p) of all rows.

Driver and plans do not grow with the number of groups or folds; each part is solved in a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.scope import materialize, running_totals

WHOLE = -1  # the fold of no rows: its training part is the whole group
BLOCK = 256  # ranks per block, by which a rank finds its value
MODEL = "group string, fold long, intercept double, slopes array<double>, mean array<double>, std array<double>, weights array<double>, center double, median array<double>"


@dataclass(frozen=True)
class Moments:
    """``table`` has one row per training part and entry of its matrix, with the means it is about and its medians."""

    features: tuple[str, ...]
    holes: tuple[int, ...]
    table: DataFrame

    def ridge(self, chosen: Sequence[str], alpha: float) -> DataFrame:
        """A ridge fit on standardised chosen features per training part: the columns of ``MODEL``."""
        p, holes = len(self.features), list(self.holes)
        size = p + len(holes) + 2
        pick = [self.features.index(c) for c in chosen]

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            order = part.sort_values("i")
            full = np.zeros((size, size))
            full[np.triu_indices(size)] = order["v"].to_numpy()
            full = full + np.triu(full, 1).T
            center = np.asarray(order["about"].iloc[0], float)
            found = order["medians"].iloc[0]
            median = np.zeros(p)
            if found is not None:
                for m in found:
                    median[m["i"]] = m["median"]
            fill = np.zeros((len(pick) + 2, size))  # 1, the chosen features with nulls filled, the target
            fill[0, 0] = fill[-1, -1] = 1.0
            for row, i in enumerate(pick, 1):
                fill[row, 1 + i] = 1.0
                if i in holes:
                    fill[row, 1 + p + holes.index(i)] = median[i] - center[1 + i]
            m = fill @ full @ fill.T
            about = np.r_[center[[1 + i for i in pick]], center[-1]]
            n, shift = m[0, 0], m[0, 1:] / m[0, 0]
            second = m[1:, 1:] - n * np.outer(shift, shift)
            std = np.sqrt(np.maximum(np.diag(second)[:-1] / n, 0.0))
            std[std <= 1e-12 * (1.0 + np.abs(about[:-1]))] = 1.0
            weights = np.linalg.solve(second[:-1, :-1] / np.outer(std, std) + alpha * np.eye(len(std)), second[:-1, -1] / std)
            slopes, mean = weights / std, about + shift
            row = {"group": order["group"].iloc[0], "fold": order["fold"].iloc[0], "intercept": mean[-1] - slopes @ mean[:-1], "center": mean[-1]}
            lists = {"slopes": slopes, "mean": mean[:-1], "std": std, "weights": weights, "median": median[pick]}
            return pd.DataFrame([row | {k: v.tolist() for k, v in lists.items()}])[[c.split()[0] for c in MODEL.split(", ")]]

        return self.table.groupBy("group", "fold").applyInPandas(solve, MODEL)


def _part_medians(rows: DataFrame, features: Sequence[str], holes: Sequence[int], parts: DataFrame) -> DataFrame:
    """``(group, fold, medians)``: medians of the features with nulls over each training part (0 where it has no value)."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(features[i]).alias("v")) for i in holes]))
    long = rows.select("group", "fold", "weight", values.alias("_e")).select("group", "fold", "weight", "_e.*").where(F.col("v").isNotNull())
    counted = long.groupBy("group", "i", "v", "fold").agg(F.sum("weight").cast("long").alias("m"))
    placed = materialize(running_totals(counted, ["group", "i"], [("v", True), ("fold", True)], F.col("m")).select("group", "i", "fold", "v", "m", F.col("_before").alias("g")))
    own = running_totals(placed, ["group", "i", "fold"], [("g", True)], F.col("m")).withColumn("_outside", F.col("g") - F.col("_before"))
    sizes = counted.groupBy("group", "i", "fold").agg(F.sum("m").alias("_own"))
    total = counted.groupBy("group", "i").agg(F.sum("m").alias("_all"))
    asked = parts.select("group", "fold", F.explode(F.array(*[F.lit(i) for i in holes])).alias("i")).join(total, ["group", "i"]).join(sizes, ["group", "i", "fold"], "left")
    asked = asked.withColumn("_n", F.col("_all") - F.coalesce("_own", F.lit(0))).where("_n > 0")
    asked = asked.select("group", "fold", "i", F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2))).alias("p")).distinct()
    before = asked.join(own.select("group", "fold", "i", "_outside", "m"), ["group", "fold", "i"], "left")
    at = before.groupBy("group", "fold", "i", "p").agg((F.col("p") + F.coalesce(F.sum(F.when(F.col("_outside") <= F.col("p"), F.col("m"))), F.lit(0))).alias("_rank"))
    block = lambda rank: F.floor(rank / BLOCK)
    spans = placed.select("group", "i", "v", "g", "m", F.explode(F.sequence(block(F.col("g")), block(F.col("g") + F.col("m") - 1))).alias("_block"))
    hit = at.withColumn("_block", block(F.col("_rank"))).join(spans, ["group", "i", "_block"]).where((F.col("g") <= F.col("_rank")) & (F.col("_rank") < F.col("g") + F.col("m")))
    each = hit.groupBy("group", "fold", "i").agg(F.avg("v").alias("median"))  # one middle value, or two
    return each.groupBy("group", "fold").agg(F.collect_list(F.struct("i", "median")).alias("medians"))


def training_moments(rows: DataFrame, features: Sequence[str], whole: bool = False) -> Moments:
    """Moments of the training parts of ``rows`` (``group, fold, weight``, the features, ``y``; weights are whole numbers).

    There is a part for each fold of a group or, if ``whole``, one for each group, of fold ``WHOLE``.
    """
    p = len(features)
    wide = rows.select("group", F.col("fold").cast("long").alias("fold"), F.col("weight").cast("double").alias("weight"), *[F.col(c).cast("double").alias(c) for c in features], F.col("y").cast("double").alias("y"))
    known = wide.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate([*features, "y"])], *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(features)]).first()
    holes = [i for i in range(p) if known[f"n{i}"]]
    center = np.array([0.0, *[float(known[f"a{i}"] or 0.0) for i in range(p)], *[0.0] * len(holes), float(known[f"a{p}"] or 0.0)])
    size = len(center)
    upper = np.triu_indices(size)

    def moments(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = batch[list(features)].to_numpy(dtype=float)
            null = np.isnan(x)
            z = np.column_stack([np.ones(len(batch)), np.where(null, 0.0, x - center[1 : p + 1]), null[:, holes], batch["y"].to_numpy(dtype=float) - center[-1]])
            weighed = z * batch["weight"].to_numpy()[:, None]
            for key, at in batch.groupby(["group", "fold"]).indices.items():
                sums[key] = sums.get(key, 0.0) + z[at].T @ weighed[at]
        for (group, fold), m in sums.items():
            yield pd.DataFrame({"group": group, "fold": fold, "i": np.arange(len(upper[0])), "v": m[upper]})

    summed = wide.mapInPandas(moments, "group string, fold long, i int, v double").groupBy("group", "fold", "i").agg(F.sum("v").alias("v"))
    own = materialize(summed)
    total = own.groupBy("group", "i").agg(F.sum("v").alias("_t"))
    if whole:
        table = total.select("group", F.lit(WHOLE).cast("long").alias("fold"), "i", F.col("_t").alias("v"))
    else:
        table = own.join(total, ["group", "i"]).select("group", "fold", "i", (F.col("_t") - F.col("v")).alias("v"))
    table = table.withColumn("about", F.array(*[F.lit(float(c)) for c in center]))
    if holes:
        medians = _part_medians(wide, features, holes, table.select("group", "fold").distinct())
        table = table.join(medians, ["group", "fold"], "left")
    else:
        table = table.withColumn("medians", F.lit(None).cast("array<struct<i:int,median:double>>"))
    return Moments(tuple(features), tuple(holes), materialize(table))
