"""Group-wise building blocks that stay balanced when one group holds most of the rows.

A ``Scope`` names the grouping keys and the row key, and carries what has been *measured* about the
groups. Operators use it in three ways:

* ``attach``     join one-row-per-group statistics back to the rows. Broadcast when the number of
                 groups was measured and is small; otherwise a salted shuffle join.
* ``with_rank``  ranks inside a group. A plain window when the largest group was measured and fits
                 one task; otherwise a range-partitioned distributed sort.
* ``quantiles``  exact linear quantiles per group, with the same two ways.
* ``with_group`` sums, minima and means on every row: unordered windows for measured small groups,
                 else partial aggregates (map-side combined) joined back with ``attach``.

The default scope is unmeasured, so every operator takes the distributed way unless its caller measured.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.storage import write_table

BROADCAST_GROUPS = 20_000
WINDOW_ROWS = 2_000_000
SALTS = 32


@dataclass(frozen=True)
class Scope:
    keys: tuple[str, ...] = ("area_id",)
    row_id: tuple[str, ...] = ("cell_id",)
    groups: int | None = None
    max_rows: int | None = None

    @classmethod
    def measured(cls, df: DataFrame, keys: Sequence[str] = ("area_id",), row_id: Sequence[str] = ("cell_id",)) -> Scope:
        """Count groups and the largest group: one map-side combined aggregate, two numbers back."""
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        groups, max_rows = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
        return cls(tuple(keys), tuple(row_id), int(groups), int(max_rows or 0))

    def by(self, *keys: str) -> Scope:
        """Other keys, nothing known about them."""
        return replace(self, keys=tuple(keys), groups=None, max_rows=None)

    def finer(self, *extra: str, factor: int | None = None) -> Scope:
        """Keys extended by columns with at most ``factor`` values per group (None: unknown)."""
        groups = self.groups * factor if self.groups is not None and factor is not None else None
        return replace(self, keys=self.keys + tuple(extra), groups=groups)

    @property
    def few_groups(self) -> bool:
        return not self.keys or (self.groups is not None and self.groups <= BROADCAST_GROUPS)

    @property
    def small_groups(self) -> bool:
        return self.max_rows is not None and self.max_rows <= WINDOW_ROWS


AREA = Scope()


def _row_hash(df: DataFrame, scope: Scope) -> Column:
    """Deterministic hash of a row for salting: its id, else every column that can be hashed (maps cannot)."""
    row = [c for c in scope.row_id if c in df.columns]
    row = row or [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*row)


def attach(df: DataFrame, stats: DataFrame, scope: Scope = AREA, how: str = "left") -> DataFrame:
    """Join one-row-per-group ``stats`` onto rows of ``df`` by ``scope.keys``."""
    keys = list(scope.keys)
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # exactly one row by construction
    if scope.few_groups:
        return df.join(F.broadcast(stats), keys, how)
    salted = df.withColumn("_salt", F.pmod(_row_hash(df, scope), F.lit(SALTS)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def group_agg(df: DataFrame, scope: Scope, *aggs: Column) -> DataFrame:
    return df.groupBy(*scope.keys).agg(*aggs)


def with_group(df: DataFrame, scope: Scope, aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates on every row of the group.

    Measured small groups: unordered windows, so a chain of steps shares one shuffle by the keys.
    Otherwise: partial aggregates joined back.
    """
    if scope.small_groups:
        w = Window.partitionBy(*scope.keys)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    return attach(df, group_agg(df, scope, *[a.alias(n) for n, a in aggs.items()]), scope)


def materialize(df: DataFrame) -> DataFrame:
    """Write an input that several branches read to the shared folder, cutting its lineage."""
    return write_table(df)


def unsent(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the input: the join is never a broadcast.

    Spark goes by the size of a table's files. Texts that repeat are a few per cent of their size there, so a table of
    any size would be taken for a small one and gathered in the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores where they lie in fewer partitions: small files of one row group, and only those."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if filled < cores else df


def stage(df: DataFrame, scope: Scope) -> DataFrame:
    """End of a step whose result feeds both an aggregate and a join.

    Windows over small groups need nothing. On the other path the rows are written to the shared
    folder, so a chain of steps costs one pass per step instead of doubling with each of them.
    """
    return df if scope.small_groups else materialize(df)


def _is_value(df: DataFrame, column: str) -> Column:
    """Neither null nor NaN."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) if df.schema[column].dataType.typeName() in ("double", "float") else c.isNotNull()


def _number(c: Column | str) -> Column:
    """As a double; NaN counts as null."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def _sort_cols(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], weight: Column) -> DataFrame:
    """Distributed ``row number`` (``_pos``) and running weight before the row (``_before``) per group.

    Rows are range partitioned by (keys, order), so a hot group spreads over many tasks. The partition
    number is stored with the row in a table in the shared folder: the later count and numbering
    steps read the same placement even when executors are lost and tasks run again.
    """
    keys = list(keys)
    placed = write_table(
        df.repartitionByRange(*[F.col(k) for k in keys], *_sort_cols(order))
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_w", weight.cast("long")),
        "placed",
    )
    chunk = keys + ["_pid"]
    sizes = placed.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_cn"), F.sum("_w").alias("_cw"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    offsets = sizes.select(
        *chunk,
        F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_cw").over(earlier), F.lit(0)).alias("_ow"),
    )
    inside = Window.partitionBy(*chunk).orderBy(*_sort_cols(order))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, chunk)
        .withColumn("_pos", F.col("_on") + F.row_number().over(inside))
        .withColumn("_before", F.col("_ow") + F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .drop("_pid", "_w", "_on", "_ow")
    )


def with_rank(
    df: DataFrame,
    scope: Scope,
    order: Sequence[tuple[str, bool]],
    name: str,
    method: str = "row",
) -> DataFrame:
    """Rank rows inside ``scope``.

    ``order`` is a list of ``(column, ascending)``. Methods: ``row`` (ties broken by ``scope.row_id``),
    ``dense``, ``min`` and ``average`` (ties share a rank; one order column). These three rank values: a row whose
    value is null or NaN has no rank (null) and counts for nobody else's.
    """
    order = list(order)
    if method == "row":
        order += [(c, True) for c in scope.row_id if c not in dict(order)]
    if scope.small_groups:
        w = Window.partitionBy(*scope.keys).orderBy(*_sort_cols(order))
        if method == "row":
            return df.withColumn(name, F.row_number().over(w).cast("long"))
        some = _is_value(df, order[0][0])
        valued = Window.partitionBy(*scope.keys, some).orderBy(*_sort_cols(order))
        ties = Window.partitionBy(*scope.keys, order[0][0])
        rank = {
            "dense": F.dense_rank().over(valued).cast("long"),
            "min": F.rank().over(valued).cast("long"),
            "average": F.rank().over(valued) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0),
        }[method]
        return df.withColumn(name, F.when(some, rank))
    if method == "row":
        return running_totals(df, scope.keys, order, F.lit(1)).withColumnRenamed("_pos", name).drop("_before")
    column = order[0][0]
    df = stage(df, scope)  # the values are joined back on equality: both sides must read the same doubles
    values = df.where(_is_value(df, column)).groupBy(*scope.keys, column).agg(F.count(F.lit(1)).alias("_m"))
    placed = running_totals(values, scope.keys, order, F.col("_m"))
    rank = {
        "dense": F.col("_pos"),
        "min": F.col("_before") + 1,
        "average": F.col("_before") + (F.col("_m") + 1) / F.lit(2.0),
    }[method]
    ranks = placed.select(*scope.keys, column, rank.alias(name))
    # a hot value makes its own shuffle partition; adaptive execution splits it against the one rank row
    return df.join(ranks, [*scope.keys, column], "left")


def quantiles(df: DataFrame, scope: Scope, wanted: Mapping[str, tuple[Column | str, float]]) -> DataFrame:
    """Exact linear-interpolation quantiles per group; nulls and NaN are ignored. One row per group.

    ``wanted`` maps an output name to ``(column, q)``.
    """
    if scope.small_groups:
        return group_agg(df, scope, *[F.percentile(_number(c), F.lit(q)).alias(n) for n, (c, q) in wanted.items()])
    names = list(wanted)
    keys = list(scope.keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("_name"), _number(c).alias("_value")) for n, (c, _) in wanted.items()])
        ).alias("_e"),
    ).select(*keys, "_e.*").where(F.col("_value").isNotNull())
    values = long.groupBy(*keys, "_name", "_value").agg(F.count(F.lit(1)).alias("_m"))
    placed = running_totals(values, [*keys, "_name"], [("_value", True)], F.col("_m"))
    inner = Scope((*keys, "_name"), ("_value",), scope.groups and scope.groups * len(names))
    totals = long.groupBy(*keys, "_name").agg(F.count(F.lit(1)).alias("_n"))
    q_of = F.create_map(*[F.lit(x) for n in names for x in (n, wanted[n][1])])
    pos = (F.col("_n") - 1) * q_of[F.col("_name")]
    lo, hi = F.floor(pos), F.ceil(pos)
    covers = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_m"))
    picked = (
        attach(placed, totals, inner)
        .withColumn("_p", pos)
        .where(covers(lo) | covers(hi))
        .groupBy(*keys, "_name")
        .agg(
            F.max(F.when(covers(lo), F.col("_value"))).alias("_lo"),
            F.max(F.when(covers(hi), F.col("_value"))).alias("_hi"),
            F.max(F.col("_p") - F.floor("_p")).alias("_f"),
        )
        .withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")))
    )
    wide = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names])
    if not keys:
        return wide
    return df.select(*keys).distinct().join(wide, keys, "left")  # groups whose values are all null stay


def with_quantiles(df: DataFrame, scope: Scope, wanted: Mapping[str, tuple[Column | str, float]]) -> DataFrame:
    """Group quantiles on every row of the group."""
    if scope.small_groups:
        w = Window.partitionBy(*scope.keys)
        return df.withColumns({n: F.percentile(_number(c), F.lit(q)).over(w) for n, (c, q) in wanted.items()})
    return attach(df, quantiles(df, scope, wanted), scope)


def top_k(df: DataFrame, scope: Scope, order: Sequence[tuple[str, bool]], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group (small k) without sorting a group in one task.

    A salted first pass keeps k rows per (group, salt); the second pass sees at most k * SALTS rows.
    """
    order = list(order) + [(c, True) for c in scope.row_id if c not in dict(order)]
    first = Window.partitionBy(*scope.keys, "_salt").orderBy(*_sort_cols(order))
    second = Window.partitionBy(*scope.keys).orderBy(*_sort_cols(order))
    pre = df
    if not scope.small_groups:
        pre = (
            df.withColumn("_salt", F.pmod(_row_hash(df, scope), F.lit(SALTS * 8)))
            .withColumn("_r", F.row_number().over(first))
            .where(F.col("_r") <= k)
            .drop("_r", "_salt")
        )
    return pre.withColumn(name, F.row_number().over(second).cast("long")).where(F.col(name) <= k)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
