"""Queries for boundaries of any shape, round trips through files, and scalar and inference operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.contracts import CELL_SCHEMA, MODEL_FEATURES
from gridspark.functions import geometry as G
from gridspark.functions import scalars as N
from gridspark.operators import spatial as P
from gridspark.operators import training as T
from gridspark.operators import uncertainty as U
from gridspark.plans import surface as S
from gridspark.sources import tables as IO
from gridspark.storage import shared_dir
from suite import views as V
from suite.registry import query, r, rnd
from suite.space import _BX, _BY, N_AREAS, SIDE, SIZE, area_scope, areas, boxes

# ---------------------------------------------------------------------------------------- boundaries

#: Boxes (x0, y0, x1, y1, sign) that make up the shape of each third of the areas: an L, two parts, a hole.
_PARTS = {
    0: [(0, 0, 20000, 6250, 1), (0, 6250, 7250, 20000, 1)],
    1: [(0, 0, 9250, 9250, 1), (11000, 11000, 20000, 20000, 1)],
    2: [(0, 0, 20000, 20000, 1), (5250, 5250, 14750, 14750, -1)],
}


def shaped_areas(spark, sf):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    rings = {
        0: [[(0, 0), (20000, 0), (20000, 6250), (7250, 6250), (7250, 20000), (0, 20000)]],
        1: [box(*p[:4]) for p in _PARTS[1]],
        2: [box(*p[:4]) for p in _PARTS[2]],
    }
    column = lambda rs: F.array(*[F.array(*[G.pt(F.lit(float(x)), F.lit(float(y))) for x, y in ring]) for ring in rs])
    k = F.col("area_id") % 3
    return areas(spark, sf).withColumn("boundary", F.when(k == 0, column(rings[0])).when(k == 1, column(rings[1])).otherwise(column(rings[2])))


_VALUES = ", ".join(f"({k}, {x0}, {y0}, {x1}, {y1}, {s})" for k, ps in _PARTS.items() for x0, y0, x1, y1, s in ps)
_CELL = (
    f"part(k, px0, py0, px1, py1, s) as (values {_VALUES}), cell as (select n_nationkey::bigint area_id, c::bigint grid_col, r::bigint grid_row, c * {SIZE} x0, r * {SIZE} y0, (c + 1) * {SIZE} x1, (r + 1) * {SIZE} y1 "
    f"from nation, generate_series(0, {SIDE - 1}) a(c), generate_series(0, {SIDE - 1}) b(r)), "
    "inside as (select area_id, grid_col, grid_row, any_value(x0) x0, any_value(y0) y0, any_value(x1) x1, any_value(y1) y1, sum(s * greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0)) cell_area_m2 "
    "from cell join part on area_id % 3 = k group by 1, 2, 3 having sum(s * greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0)) > 0)"
)
_BOXES = f"box as (select (l_suppkey % {N_AREAS})::bigint area_id, {_BX}::double bx0, {_BY}::double by0, {_BX} + l_quantity * 9 bx1, {_BY} + l_quantity * 7 by1, row_number() over () id from lineitem)"
_MET = (
    "met as (select area_id, grid_col, grid_row, id, s, greatest(bx0, x0) rx0, greatest(by0, y0) ry0, least(bx1, x1) rx1, least(by1, y1) ry1, px0, py0, px1, py1 "
    "from inside join box using (area_id) join part on area_id % 3 = k where bx0 <= x1 and bx1 >= x0 and by0 <= y1 and by1 >= y0)"
)


def _cells(df):
    return df.where("cell_area_m2 > 0").drop("cell_id")


@query("g01_any_boundary", f"with {_CELL} select area_id, grid_col, grid_row, {r('cell_area_m2')} from inside")
def g01(spark, sf):
    cells = P.make_grid(shaped_areas(spark, sf), SIZE)
    return _cells(cells).select("area_id", "grid_col", "grid_row", rnd("cell_area_m2").alias("cell_area_m2"))


@query(
    "g05_any_boundary",
    f"with {_CELL}, {_BOXES}, {_MET}, m as (select area_id, grid_col, grid_row, sum(s * greatest(least(rx1, px1) - greatest(rx0, px0), 0) * greatest(least(ry1, py1) - greatest(ry0, py0), 0)) v from met group by 1, 2, 3) "
    f"select area_id, grid_col, grid_row, {r('coalesce(v, 0)', 'object_measure', 2)} from inside left join m using (area_id, grid_col, grid_row)",
)
def g05(spark, sf):
    a, s = shaped_areas(spark, sf), area_scope(spark, sf)
    out = P.measure_in_cells(P.make_grid(a, SIZE), boxes(spark, sf), a, SIZE, s)
    return _cells(out).select("area_id", "grid_col", "grid_row", rnd("object_measure", 2).alias("object_measure"))


@query(
    "g04_any_boundary",
    # a box counts in a cell if what they share meets the closed shape: a part, or anything but the inside of the hole
    f"with {_CELL}, {_BOXES}, {_MET}, hit as (select area_id, grid_col, grid_row, id, bool_or(s = 1 and rx0 <= px1 and rx1 >= px0 and ry0 <= py1 and ry1 >= py0) "
    "and not bool_or(s = -1 and rx0 > px0 and rx1 < px1 and ry0 > py0 and ry1 < py1) ok from met group by 1, 2, 3, 4) "
    "select area_id, grid_col, grid_row, count(ok) filter (ok) object_count from inside left join hit using (area_id, grid_col, grid_row) group by 1, 2, 3",
)
def g04(spark, sf):
    a, s = shaped_areas(spark, sf), area_scope(spark, sf)
    return _cells(P.count_in_cells(P.make_grid(a, SIZE), boxes(spark, sf), a, SIZE, s)).select("area_id", "grid_col", "grid_row", "object_count")


# -------------------------------------------------------------------------------------- round trips


def _place(spark, name):
    return f"{shared_dir(spark)}/suite/{name}-{uuid.uuid4().hex}"


_SUMS = ("building_count", "road_length", "building_area")


@query("s01_read_cells", V.with_views("cells") + "select count(*) n, " + ", ".join(f"sum({c})::double {c}" for c in _SUMS) + " from cells")
def s01(spark, sf):
    path = _place(spark, "cells")
    cells = V.cells(spark, sf).withColumn("combined_index", F.lit(0.5))
    cells.select(*[F.col(f.name).cast("string") for f in CELL_SCHEMA.fields]).write.option("header", True).csv(path)
    return IO.read_cells(spark, path).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])


@query(
    "s11_write_surface",
    V.with_views("cells") + "select area_id, count(*) n, sum(building_area)::double building_area, count(*) features, min(round(latitude, 4)) south from cells group by 1",
)
def s11(spark, sf):
    """Written as CSV and GeoJSON, read back from both."""
    path = _place(spark, "surface")
    c = V.cells(spark, sf).select("area_id", "cell_id", "latitude", "longitude", "building_area")
    box = G.box_ring(F.col("longitude"), F.col("latitude"), F.col("longitude") + 0.005, F.col("latitude") + 0.004)
    IO.write_surface(c.withColumn("geom", box), path)
    rows = spark.read.option("header", True).csv(f"{path}/csv").groupBy(F.col("area_id").cast("long").alias("area_id"))
    table = rows.agg(F.count("*").alias("n"), F.sum(F.col("building_area").cast("double")).alias("building_area"))
    feature = F.from_json("value", "type string, geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<cell_id string>")
    text = spark.read.text(f"{path}/geojson").select(F.col("area_id").cast("long").alias("area_id"), feature.alias("f"))
    shapes = text.where("f.type = 'Feature' and size(f.geometry.coordinates[0]) = 5").groupBy("area_id")
    return table.join(shapes.agg(F.count("*").alias("features"), F.min(F.round(F.expr("f.geometry.coordinates[0][0][1]"), 4)).alias("south")), "area_id")


@query("s15_read_runs", "select (o_custkey % 7)::bigint area_id, count(*) n, sum(o_orderkey)::bigint keys from orders where o_custkey % 7 in (1, 4) group by 1")
def s15(spark, sf):
    path = _place(spark, "runs")
    o = V.table(spark, sf, "orders").select((F.col("o_custkey") % 7).cast("long").alias("area_id"), "o_orderkey")
    o.withColumn("run", F.col("area_id")).write.partitionBy("run").parquet(path)
    wanted = spark.range(2).select((F.col("id") * 3 + 1).alias("area_id"))
    runs = IO.read_runs(spark, path, areas=wanted).where(F.col("source_path").contains(F.concat(F.lit("run="), F.col("area_id"))))
    return runs.groupBy("area_id").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s16_read_questions", "select item_id::bigint item_id, md5(text || chr(10) || '\"quoted\", ' || item_id) question from benchmark")
def s16(spark, sf):
    """A byte-order mark before the header, line ends and quotes inside the questions."""
    path = _place(spark, "questions")
    b = V.table(spark, sf, "benchmark").select("item_id", F.concat(F.col("text"), F.lit('\n"quoted", '), F.col("item_id")).alias("question"))
    b.withColumnRenamed("item_id", "﻿item_id").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return IO.read_questions(spark, path).select(F.col("item_id").cast("long").alias("item_id"), F.md5("question").alias("question"))


# ------------------------------------------------------------------------------- scalars, inference


@query("n08_coalesce_cols", "select c_custkey::bigint k, c_name \"name\", 'none' \"other\" from customer")
def n08(spark, sf):
    c = V.table(spark, sf, "customer")
    pick = lambda *names: N.coalesce_cols(c, names, "none")
    return c.select(F.col("c_custkey").cast("long").alias("k"), pick("title", "C_NAME", "c_phone").alias("name"), pick("title", "label").alias("other"))


@query(
    "n09_canonical_key",
    r"""with k as (select p_partkey::bigint k, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || '_X-' || p_partkey || '!')), '[_\-]+', ' ', 'g'), '[^a-zа-яё0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) v from part)
    select k, case when v = (select min(v) from k) then 'first' else v end "key" from k""",
)
def n09(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.concat("p_name", F.lit("_X-"), "p_partkey", F.lit("!")).alias("v"))
    least = p.select(N.canonical_key(F.col("v"), {}).alias("v")).agg(F.min("v")).first()[0]
    return p.select("k", N.canonical_key(F.col("v"), {least: "first"}).alias("key"))


@query(
    "n15_protocol_names",
    "select distinct lower(o_orderpriority).replace('-', '_').replace(' ', '_') slug, case when o_orderkey % 2 = 0 then o_orderstatus else o_orderpriority end model_name, "
    "case when o_orderkey % 2 = 0 then 'leave_one_city_out' else 'p__' || o_orderstatus end validation_protocol from orders",
)
def n15(spark, sf):
    stem = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.concat("o_orderpriority", F.lit("__p__"), "o_orderstatus"))
    o = V.table(spark, sf, "orders").select(N.protocol_slug(F.concat(F.lit(" "), "o_orderpriority")).alias("slug"), N.run_stem(stem).alias("s"))
    return o.select("slug", "s.*").distinct()


@query(
    "n16_first_value",
    "select o_custkey::bigint o_custkey, coalesce(min_by(o_orderstatus, o_orderkey) filter (o_totalprice > 150000), 'none') first_clerk from orders group by 1",
)
def n16(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("big", F.when(F.col("o_totalprice") > 150000, F.col("o_orderstatus")))
    return o.groupBy(F.col("o_custkey").cast("long").alias("o_custkey")).agg(N.first_value(F.col("big"), F.col("o_orderkey"), "none").alias("first_clerk"))


_CORR = "select c_nationkey::bigint area_id, corr(c_acctbal, c_custkey) pearson_r, corr(c_custkey, c_acctbal) / 2 + 0.4 spearman_r, sum(case when c_acctbal < -900 then 1 else 0 end) % 2 w from customer where c_nationkey % 4 > 0 group by 1"


@query(
    "u12_internal_support",
    f"with d as ({_CORR}), s as (select n_nationkey::bigint area_id, least(greatest(0.45 * greatest(coalesce(pearson_r, 0), 0) + 0.35 * greatest(coalesce(spearman_r, 0), 0) + 0.2 * case when w = 0 then 1.0 else 0.5 end, 0), 1) v, d.area_id is not null f "
    f"from nation left join d on d.area_id = n_nationkey) select area_id, {r('case when f then v else 0.5 end', 'internal_support_score')}, case when not f then 'not_available' when v >= 0.6 then 'strong' else 'mixed' end district_support_flag from s",
)
def u12(spark, sf):
    c = V.table(spark, sf, "customer").where("c_nationkey % 4 > 0").groupBy(F.col("c_nationkey").cast("long").alias("area_id"))
    d = c.agg(
        F.corr("c_acctbal", "c_custkey").alias("pearson_r"),
        (F.corr("c_custkey", "c_acctbal") / 2 + 0.4).alias("spearman_r"),
        (F.sum(F.when(F.col("c_acctbal") < -900, 1).otherwise(0)) % 2).alias("boundary_warning_count"),
    )
    a = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"))
    return U.internal_support(a, d).select("area_id", rnd("internal_support_score").alias("internal_support_score"), "district_support_flag")


#: A model with given coefficients, so that its predictions have a statement.
_MODEL = T.RidgeModel(("building_count", "road_length"), [0.0, 0.0], [2.0, 100_000.0], [4.0, 800_000.0], [0.5, -0.25], 1.5)
_PRED = "greatest(exp((building_count - 2) / 4 * 0.5 + (road_length - 100000) / 800000 * -0.25 + 1.5) - 1, 0)"


@query("i01_predict_raw", V.with_views("cells") + f"select area_id, cell_id, {r(_PRED, 'pred')} from cells")
def i01(spark, sf):
    scored = T.predict_raw(_MODEL, V.cells(spark, sf), _MODEL.features)
    return scored.select("area_id", "cell_id", rnd("pred").alias("pred"))


@query(
    "i02_surface_output",
    V.with_views("cells", "totals", extra={"p": f"select area_id, cell_id, {_PRED} v from cells"})
    + f"select area_id, cell_id, 'given' model_name, {r('v', 'raw_value')}, {r('official_total / sum(v) over (partition by area_id)', 'calibration_factor')}, "
    f"{r('v * official_total / sum(v) over (partition by area_id)', 'surface_value', 2)} from p join totals using (area_id)",
)
def i02(spark, sf):
    scope = V.scope_of(spark, sf)
    scored = T.predict_raw(_MODEL, V.cells_with_total(spark, sf, scope), _MODEL.features)
    out = S.surface_output(scored, "given", scope=scope)
    return out.select("area_id", "cell_id", "model_name", rnd("raw_value").alias("raw_value"), rnd("calibration_factor").alias("calibration_factor"), rnd("surface_value", 2).alias("surface_value"))


@query(
    "g11_feature_output",
    f"select n_nationkey::bigint area_id, 'Z' || (c * {SIDE} + r + 1) cell_id, {r(f'r * {SIZE} + {SIZE / 2}', 'latitude')}, {r(f'c * {SIZE} + {SIZE / 2}', 'longitude')}, {len(MODEL_FEATURES) + 4}::bigint n_columns "
    f"from nation, generate_series(0, {SIDE - 1}) a(c), generate_series(0, {SIDE - 1}) b(r)",
)
def g11(spark, sf):
    a = areas(spark, sf)
    cells = P.make_grid(a, SIZE).withColumns({c: F.lit(0.0) for c in MODEL_FEATURES})
    out = P.feature_output(cells, a)
    return out.select("area_id", "cell_id", rnd("latitude").alias("latitude"), rnd("longitude").alias("longitude"), F.lit(len(out.columns)).cast("long").alias("n_columns"))
