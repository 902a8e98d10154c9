"""Spatial queries on boxes, segments and points derived from the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.operators import spatial as P
from gridspark.scope import Scope
from suite import views as V
from suite.registry import pick, query, r, rnd, rs

SIZE = V.SIZE
N_AREAS = 25

# Every nation gets a 40 x 40 grid of 500 m cells with its origin at (0, 0).
SIDE = 40


def areas(spark, sf):
    n = V.table(spark, sf, "nation")
    zero, side = F.lit(0.0), F.lit(SIDE * SIZE)
    return n.select(F.col("n_nationkey").cast("long").alias("area_id"), zero.alias("minx"), zero.alias("miny"), side.alias("maxx"), side.alias("maxy"))


def area_scope(spark, sf):
    """The area table is the dimension: its own row count bounds the broadcast."""
    return Scope(groups=V.table(spark, sf, "nation").count())


_BX = "(l_partkey * 37 + l_linenumber * 11) % 19000"
_BY = "(l_suppkey * 53 + l_partkey * 7) % 19000"


def boxes(spark, sf):
    """Buildings: axis-aligned boxes, one per order line."""
    li = V.table(spark, sf, "lineitem")
    x, y = F.expr(f"cast({_BX} as double)"), F.expr(f"cast({_BY} as double)")
    w, h = F.col("l_quantity") * 9, F.col("l_quantity") * 7
    kinds = F.array(*[F.lit(k) for k in ("apartments", "house", "commercial", "retail", "school", "shed")])
    tags = F.create_map(
        F.lit("building"), F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")),
        F.lit("building:levels"), F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string")),
    )
    return li.select(
        (F.col("l_suppkey") % N_AREAS).cast("long").alias("area_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("obj_id"),
        F.lit("buildings").alias("layer"),
        F.lit("polygon").alias("kind"),
        G.box_ring(x, y, x + w, y + h).alias("geom"),
        tags.alias("tags"),
    )


_SX = "(o_orderkey * 29) % 20000"
_SY = "(o_custkey * 41) % 20000"


def roads(spark, sf):
    o = V.table(spark, sf, "orders")
    x, y = F.expr(f"cast({_SX} as double)"), F.expr(f"cast({_SY} as double)")
    return o.select(
        (F.col("o_custkey") % N_AREAS).cast("long").alias("area_id"),
        F.concat(F.lit("r"), "o_orderkey").alias("obj_id"),
        F.lit("roads").alias("layer"),
        F.lit("line").alias("kind"),
        F.array(G.pt(x, y), G.pt(x + 1300.0, y)).alias("geom"),
        F.lit(None).cast("map<string,string>").alias("tags"),
    )


def stops(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % N_AREAS).cast("long").alias("area_id"),
        F.concat(F.lit("e"), "event_id").alias("obj_id"),
        F.element_at(F.array(F.lit("bus_stops"), F.lit("schools"), F.lit("hospitals"), F.lit("shops")), (F.col("event_id") % 4 + 1).cast("int")).alias("layer"),
        F.lit("point").alias("kind"),
        F.array(G.pt(F.expr("cast((event_id * 13) % 20000 as double)"), F.expr("cast((event_id * 7) % 20000 as double)"))).alias("geom"),
        F.lit(None).cast("map<string,string>").alias("tags"),
    )


_CELLS = (
    f"select n_nationkey::bigint area_id, 'Z' || (c * {SIDE} + r + 1) cell_id, (c * {SIDE} + r + 1)::bigint cell_no, c::bigint grid_col, r::bigint grid_row, "
    f"c * {SIZE}::double x0, r * {SIZE}::double y0, (c + 1) * {SIZE}::double x1, (r + 1) * {SIZE}::double y1 from nation, generate_series(0, {SIDE - 1}) a(c), generate_series(0, {SIDE - 1}) b(r)"
)
_BOX = (
    f"select (l_suppkey % {N_AREAS})::bigint area_id, {_BX}::double bx0, {_BY}::double by0, {_BX} + l_quantity * 9 bx1, {_BY} + l_quantity * 7 by1, "
    "list_extract(['apartments', 'house', 'commercial', 'retail', 'school', 'shed'], (l_partkey % 6 + 1)::int) kind, case when l_linenumber % 3 = 0 then null else l_linenumber end lv from lineitem"
)
# every overlap in SQL is found on the same bins, written as joins with generate_series
_BIN = (
    "select b.*, gc.c grid_col, gr.r grid_row, greatest(least(bx1, (gc.c + 1) * 500.0) - greatest(bx0, gc.c * 500.0), 0) * greatest(least(by1, (gr.r + 1) * 500.0) - greatest(by0, gr.r * 500.0), 0) m "
    f"from box b, lateral (select unnest(generate_series(greatest(ceil(bx0 / 500) - 1, 0)::bigint, least(floor(bx1 / 500), {SIDE - 1})::bigint)) c) gc, "
    f"lateral (select unnest(generate_series(greatest(ceil(by0 / 500) - 1, 0)::bigint, least(floor(by1 / 500), {SIDE - 1})::bigint)) r) gr"
)
_G = {"g": _CELLS, "box": _BOX, "bin": _BIN}


def _with(**ctes):
    return "with " + ", ".join(f"{n} as materialized ({b})" for n, b in ctes.items()) + " "


@query("g01_grid", _with(g=_CELLS) + "select area_id, cell_id, grid_col, grid_row, x0, y1, 250000.0::double cell_area_m2 from g")
def g01(spark, sf):
    return P.make_grid(areas(spark, sf), SIZE).select("area_id", "cell_id", "grid_col", "grid_row", "x0", "y1", "cell_area_m2")


def _clipped_areas(spark, sf):
    """A right triangle boundary per nation, so that edge cells are cut."""
    side = F.lit(SIDE * SIZE)
    ring = F.array(G.pt(F.lit(0.0), F.lit(0.0)), G.pt(side, F.lit(0.0)), G.pt(F.lit(0.0), side))
    return areas(spark, sf).withColumn("boundary", ring)


@query(
    "g01_grid_clipped",
    _with(g=_CELLS)
    + f"select area_id, 'Z' || row_number() over (partition by area_id order by grid_col, grid_row) cell_id, grid_col, grid_row, "
    f"case when grid_col + grid_row < {SIDE - 1} then 250000.0 when grid_col + grid_row = {SIDE - 1} then 125000.0 else 0.0 end::double cell_area_m2 from g where grid_col + grid_row <= {SIDE}",
)
def g01c(spark, sf):
    return P.make_grid(_clipped_areas(spark, sf), SIZE).select("area_id", "cell_id", "grid_col", "grid_row", rnd("cell_area_m2").alias("cell_area_m2"))


@query("g02_area_bounds", _with(box=_BOX) + f"select area_id, min(bx0) minx, min(by0) miny, max(bx1) maxx, max(by1) maxy from box group by area_id")
def g02(spark, sf):
    return P.area_bounds(boxes(spark, sf))


@query(
    "g04_count_in_cells",
    _with(**_G) + "select g.area_id, g.cell_id, coalesce(n, 0) object_count from g left join (select area_id, grid_col, grid_row, count(*) n from bin group by 1, 2, 3) using (area_id, grid_col, grid_row)",
)
def g04(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    return P.count_in_cells(P.make_grid(a, SIZE), boxes(spark, sf), a, SIZE, s).select("area_id", "cell_id", "object_count")


@query(
    "g05_area_in_cells",
    _with(**_G) + f"select g.area_id, g.cell_id, {r('coalesce(n, 0)', 'object_measure', 2)} from g left join (select area_id, grid_col, grid_row, sum(m) n from bin group by 1, 2, 3) using (area_id, grid_col, grid_row)",
)
def g05(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    return pick(P.measure_in_cells(P.make_grid(a, SIZE), boxes(spark, sf), a, SIZE, s), ["area_id", "cell_id"], ["object_measure"], 2)


_SEG = f"select (o_custkey % {N_AREAS})::bigint area_id, {_SX}::double sx, {_SY}::double sy from orders"
_SEGBIN = (
    f"select s.area_id, gc.c grid_col, gr.r grid_row, greatest(least(sx + 1300, (gc.c + 1) * 500.0) - greatest(sx, gc.c * 500.0), 0) m from seg s, "
    f"lateral (select unnest(generate_series(greatest(ceil(sx / 500) - 1, 0)::bigint, least(floor((sx + 1300) / 500), {SIDE - 1})::bigint)) c) gc, "
    f"lateral (select unnest(generate_series(greatest(ceil(sy / 500) - 1, 0)::bigint, least(floor(sy / 500), {SIDE - 1})::bigint)) r) gr"
)


@query(
    "g05_length_in_cells",
    _with(g=_CELLS, seg=_SEG, sb=_SEGBIN)
    + f"select g.area_id, g.cell_id, {r('coalesce(n, 0)', 'object_measure', 2)} from g left join (select area_id, grid_col, grid_row, sum(m) n from sb group by 1, 2, 3) using (area_id, grid_col, grid_row)",
)
def g05l(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    return pick(P.measure_in_cells(P.make_grid(a, SIZE), roads(spark, sf), a, SIZE, s), ["area_id", "cell_id"], ["object_measure"], 2)


@query(
    "g06_g07_use_and_levels",
    _with(box=_BOX)
    + "select area_id, count(*) n, count(*) filter (kind in ('apartments', 'house')) residential, count(*) filter (kind = 'commercial') commercial, count(*) filter (kind = 'retail') retail, "
    f"count(*) filter (kind = 'school') public, count(lv) with_levels, {r('sum(coalesce(lv, 1))', 'levels_sum')} from box group by 1",
)
def g06(spark, sf):
    df = P.levels(P.use_flags(boxes(spark, sf)))
    return df.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_residential").alias("residential"),
        F.count_if("is_commercial").alias("commercial"),
        F.count_if("is_retail").alias("retail"),
        F.count_if("is_public").alias("public"),
        F.count("levels").alias("with_levels"),
        rnd(F.sum("effective_levels")).alias("levels_sum"),
    )


_PT = (
    f"select (user_id % {N_AREAS})::bigint area_id, list_extract(['bus_stops', 'schools', 'hospitals', 'shops'], (event_id % 4 + 1)::int) layer, "
    "((event_id * 13) % 20000)::double x, ((event_id * 7) % 20000)::double y from events"
)
_PTBIN = (
    f"select p.area_id, layer, gc.c grid_col, gr.r grid_row from pt p, lateral (select unnest(generate_series(greatest(ceil(x / 500) - 1, 0)::bigint, least(floor(x / 500), {SIDE - 1})::bigint)) c) gc, "
    f"lateral (select unnest(generate_series(greatest(ceil(y / 500) - 1, 0)::bigint, least(floor(y / 500), {SIDE - 1})::bigint)) r) gr"
)
_FEAT = (
    "select g.area_id, g.cell_id, g.cell_no, g.grid_col, g.grid_row, coalesce(bc, 0)::double building_count, coalesce(ba, 0)::double building_area, coalesce(ra, 0)::double residential_area, coalesce(ca, 0)::double commercial_area, "
    "coalesce(pa, 0)::double public_area, coalesce(fa, 0)::double total_floor_area, coalesce(ml, 0)::double mean_building_levels, coalesce(rl, 0)::double road_length, coalesce(bs, 0)::double bus_stop_count, coalesce(sc, 0)::double schools_count, "
    "coalesce(sh, 0)::double parks_shops_count from g left join (select area_id, grid_col, grid_row, count(*) bc, sum(m) ba, sum(m) filter (kind in ('apartments', 'house')) ra, sum(m) filter (kind = 'commercial') ca, "
    "sum(m) filter (kind = 'school') pa, sum(m * coalesce(lv, 1)) fa, avg(lv) ml from bin group by 1, 2, 3) using (area_id, grid_col, grid_row) "
    "left join (select area_id, grid_col, grid_row, sum(m) rl from sb group by 1, 2, 3) using (area_id, grid_col, grid_row) "
    "left join (select area_id, grid_col, grid_row, count(*) filter (layer = 'bus_stops') bs, count(*) filter (layer = 'schools') sc, count(*) filter (layer = 'shops') sh from pb group by 1, 2, 3) using (area_id, grid_col, grid_row)"
)
_F8 = ("building_area", "residential_area", "commercial_area", "public_area", "total_floor_area", "road_length")


def objects(spark, sf):
    return boxes(spark, sf).unionByName(roads(spark, sf)).unionByName(stops(spark, sf))


@query(
    "g08_cell_features",
    _with(**_G, seg=_SEG, sb=_SEGBIN, pt=_PT, pb=_PTBIN, f=_FEAT)
    + f"select area_id, cell_id, building_count, bus_stop_count, schools_count, parks_shops_count, {rs(*_F8, places=2)}, {r('mean_building_levels', places=6)} from f",
)
def g08(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    df = P.cell_features(P.make_grid(a, SIZE), objects(spark, sf), a, SIZE, s)
    counts = ["area_id", "cell_id", "building_count", "bus_stop_count", "schools_count", "parks_shops_count"]
    return df.select(*counts, *[rnd(c, 2).alias(c) for c in _F8], rnd("mean_building_levels", 6).alias("mean_building_levels"))


@query(
    "g09_poi_points",
    _with(pt=_PT) + f"select area_id, layer, count(*) n, {r('sum(x)', 'sx')}, {r('sum(y)', 'sy')} from pt group by 1, 2",
)
def g09(spark, sf):
    df = P.poi_points(objects(spark, sf))
    return df.groupBy("area_id", "layer").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("x")).alias("sx"), rnd(F.sum("y")).alias("sy"))


def supplier_pois(spark, sf):
    return V.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("area_id"),
        F.expr("cast((s_suppkey * 677) % 20000 as double)").alias("x"),
        F.expr("cast((s_suppkey * 1931) % 20000 as double)").alias("y"),
    )


_KNN = (
    "select g.area_id, g.cell_id, sqrt((g.x0 + 250 - x) ** 2 + (g.y0 + 250 - y) ** 2) d, row_number() over (partition by g.area_id, g.cell_id order by (g.x0 + 250 - x) ** 2 + (g.y0 + 250 - y) ** 2) p "
    "from g join (select s_nationkey::bigint area_id, ((s_suppkey * 677) % 20000)::double x, ((s_suppkey * 1931) % 20000)::double y from supplier) using (area_id)"
)


@query(
    "g10_knn_access",
    _with(g=_CELLS, k=_KNN) + f"select g.area_id, g.cell_id, {r('coalesce(1 / (avg(d) + 1), 0)', 'poi_access_index', 8)} from g left join (select * from k where p <= 5) using (area_id, cell_id) group by 1, 2",
)
def g10(spark, sf):
    cells = P.centroids(P.make_grid(areas(spark, sf), SIZE))
    df = P.knn_access(cells, supplier_pois(spark, sf), base_m=1250.0)
    return pick(df, ["area_id", "cell_id"], ["poi_access_index"], 8)


# districts: 4 x 4 tiles of 5,100 m per nation, off the cell lines
_TILE = 5100.0
_DIST = (
    f"select n_nationkey::bigint area_id, 'D' || i || '_' || j district_name, (1000 + 10 * i + j + n_nationkey)::double official_population, i + j < 6 use_in_metrics, i * {_TILE} dx0, j * {_TILE} dy0, (i + 1) * {_TILE} dx1, (j + 1) * {_TILE} dy1 "
    "from nation, generate_series(0, 4) a(i), generate_series(0, 3) b(j)"
)


def districts(spark, sf):
    n = V.table(spark, sf, "nation")
    i, j = F.col("i"), F.col("j")
    return (
        n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select(
            F.col("n_nationkey").cast("long").alias("area_id"),
            F.concat(F.lit("D"), i, F.lit("_"), j).alias("district_name"),
            (F.lit(1000) + i * 10 + j + F.col("n_nationkey")).cast("double").alias("official_population"),
            (i + j < 6).alias("use_in_metrics"),
            G.box_ring(i * _TILE, j * _TILE, (i + 1) * _TILE, (j + 1) * _TILE).alias("geom"),
        )
    )


_CV = "select area_id, cell_id, grid_col, grid_row, ((grid_col * 7 + grid_row * 13 + area_id) % 50)::double v from g"
_OV = (
    "select d.*, v, greatest(least(dx1, (grid_col + 1) * 500.0) - greatest(dx0, grid_col * 500.0), 0) * greatest(least(dy1, (grid_row + 1) * 500.0) - greatest(dy0, grid_row * 500.0), 0) o "
    "from dist d join cv using (area_id)"
)


def _valued_cells(spark, sf):
    c = P.make_grid(areas(spark, sf), SIZE)
    v = ((F.col("grid_col") * 7 + F.col("grid_row") * 13 + F.col("area_id")) % 50).cast("double")
    return c.withColumns({"surface_value": v, "p50": v, "p10": v * 0.8, "p90": v * 1.3})


@query(
    "g12_areal_interpolation",
    _with(g=_CELLS, dist=_DIST, cv=_CV, ov=_OV, s="select area_id, district_name, official_population, use_in_metrics, sum(v * o / 250000) predicted_population from ov group by 1, 2, 3, 4")
    + f"select area_id, district_name, {rs('predicted_population')}, {r('official_population / sum(official_population) over w', 'official_share', 6)}, "
    f"{r('predicted_population / sum(predicted_population) over w', 'predicted_share', 6)} from s window w as (partition by area_id)",
)
def g12(spark, sf):
    s = area_scope(spark, sf)
    df = P.areal_interpolate(_valued_cells(spark, sf), districts(spark, sf), areas(spark, sf), size_m=SIZE, scope=s)
    return df.select("area_id", "district_name", rnd("predicted_population").alias("predicted_population"), rnd("official_share", 6).alias("official_share"), rnd("predicted_share", 6).alias("predicted_share"))


@query(
    "b06_district_intervals",
    _with(g=_CELLS, dist=_DIST, cv=_CV, ov=_OV, s="select area_id, district_name, official_population, sum(v * o / 250000) p50 from ov group by 1, 2, 3")
    + f"select area_id, district_name, {r('p50 * 0.8', 'predicted_p10')}, {r('p50', 'predicted_p50')}, {r('p50 * 1.3', 'predicted_p90')}, {r('p50 * 0.5', 'interval_width')}, {r('p50 * 0.5 / greatest(p50, 1e-6)', 'relative_interval_width')}, "
    "official_population between p50 * 0.8 and p50 * 1.3 covered_by_interval from s",
)
def b06(spark, sf):
    s = area_scope(spark, sf)
    df = P.district_intervals(_valued_cells(spark, sf), districts(spark, sf), areas(spark, sf), SIZE, s)
    return pick(df, ["area_id", "district_name", "covered_by_interval"], ["predicted_p10", "predicted_p50", "predicted_p90", "interval_width", "relative_interval_width"])


@query(
    "g13_polygonal_only",
    "select n_nationkey::bigint area_id, case when n_nationkey % 3 = 0 then null else 1::bigint + n_nationkey % 2 end polygon_parts from nation",
)
def g13(spark, sf):
    from pyspark.sql.functions import array, struct

    n = V.table(spark, sf, "nation")
    box = G.box_ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    part = lambda k: struct(F.lit(k).alias("kind"), box.alias("ring"))
    k = F.col("n_nationkey")
    parts = F.when(k % 3 == 0, array(part("line"))).when(k % 2 == 0, array(part("polygon"), part("line"))).otherwise(array(part("polygon"), part("point"), part("polygon")))
    return n.select(k.cast("long").alias("area_id"), F.size(P.polygonal_only(parts)).cast("long").alias("polygon_parts")).withColumn(
        "polygon_parts", F.when(F.col("polygon_parts") >= 0, F.col("polygon_parts"))
    )


@query(
    "g14_match_districts",
    _with(dist=_DIST) + "select area_id, district_name, 'small_' || district_name cand_id from dist where district_name not like 'D4%' and district_name not like '%_1' union all "
    "select area_id, district_name, 'big_' || district_name from dist where district_name not like 'D4%' and district_name like '%_1' union all select area_id, district_name, 'missing' from dist where district_name like 'D4%'",
)
def g14(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    d = districts(spark, sf)
    ref = d.drop("geom").withColumn("tokens", F.array(F.lower("district_name"), F.lit("")))
    # candidate pairs share a name; the one outside the surface is larger for districts ending in _0
    inside = d.withColumn("cand_id", F.concat(F.lit("small_"), "district_name"))
    far = F.lit(900000.0)
    small = inside.select("area_id", "cand_id", F.array(F.lower("district_name")).alias("names"), "geom")
    big = d.select(
        "area_id",
        F.concat(F.lit("big_"), "district_name").alias("cand_id"),
        F.array(F.lit("other"), F.lower("district_name")).alias("names"),
        F.when(F.col("district_name").endswith("_0"), F.transform("geom", lambda p: G.pt(p["x"] * 3 + far, p["y"] * 3)))
        .otherwise(F.transform("geom", lambda p: G.pt(p["x"], p["y"] * 2 - 3000)))
        .alias("geom"),
    )
    cands = small.unionByName(big).where(~F.col("cand_id").rlike("_D4_"))
    matched, misses = P.match_districts(ref, cands, P.make_grid(a, SIZE), a, SIZE, s)
    return matched.select("area_id", "district_name", "cand_id").unionByName(misses.withColumn("cand_id", F.lit("missing")))


_PIX = (
    f"select (p_partkey % {N_AREAS})::bigint area_id, 'r' || (p_partkey % 3) raster_id, p_partkey // 100 prow, p_partkey % 100 pcol, (p_partkey * 97) % 19000 + 30.0 px0, (p_partkey * 61) % 19000 + 30.0 py0, "
    "case when p_partkey % 17 = 0 then -p_retailprice when p_partkey % 19 = 0 then null else p_retailprice end v from part"
)
_PIXW = 640.0
_ZS = (
    f"select area_id, 'Z' || (least(ceil((px0 + {_PIXW}) / 500) - 1, {SIDE - 1}) * {SIDE} + least(ceil((py0 + {_PIXW}) / 500) - 1, {SIDE - 1}) + 1)::bigint cell_id, sum(v) v from pix where v > 0 group by 1, 2"
)


def pixels(spark, sf):
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey")
    x, y = F.expr("(p_partkey * 97) % 19000 + 30.0D"), F.expr("(p_partkey * 61) % 19000 + 30.0D")
    v = F.when(k % 17 == 0, -F.col("p_retailprice")).when(k % 19 == 0, F.lit(None)).otherwise(F.col("p_retailprice"))
    return p.select(
        (k % N_AREAS).cast("long").alias("area_id"),
        F.concat(F.lit("r"), k % 3).alias("raster_id"),
        F.expr("p_partkey div 100").alias("row"),
        (k % 100).alias("col"),
        x.alias("x0"),
        y.alias("y0"),
        (x + _PIXW).alias("x1"),
        (y + _PIXW).alias("y1"),
        v.alias("value"),
        F.when(k % 2 == 0, "even").otherwise("odd").alias("product"),
    )


@query(
    "g15_zonal_sum",
    _with(g=_CELLS, pix=_PIX, z=_ZS) + f"select g.area_id, g.cell_id, {r('coalesce(v, 0)', 'raster_value')} from g left join z using (area_id, cell_id)",
)
def g15(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    return pick(P.zonal_sum(P.make_grid(a, SIZE), pixels(spark, sf), a, SIZE, s), ["area_id", "cell_id"], ["raster_value"])


@query(
    "g16_raster_coverage",
    f"select (p_partkey % {N_AREAS})::bigint area_id, count(distinct p_partkey % 3) raster_count, bool_and(mx) coverage_ok from (select *, "
    f"min((p_partkey * 97) % 19000) over w <= 400 and max((p_partkey * 97) % 19000) over w >= 18000 mx from part window w as (partition by p_partkey % {N_AREAS}, p_partkey % 3)) group by 1",
)
def g16(spark, sf):
    boxes_ = (
        pixels(spark, sf)
        .groupBy("area_id", "raster_id")
        .agg((F.min("x0") - 430.0).alias("minx"), F.lit(-1.0).alias("miny"), (F.max("x0") - 30.0 + 2000.0).alias("maxx"), F.lit(20001.0).alias("maxy"))
    )
    return P.raster_coverage(areas(spark, sf), boxes_, area_scope(spark, sf))


@query(
    "g17_align_benchmarks",
    _with(g=_CELLS, pix=_PIX + " where p_partkey % 2 = 0", z=_ZS, pix2=_PIX + " where p_partkey % 2 = 1", z2=_ZS.replace("from pix", "from pix2"))
    + f"select g.area_id, g.cell_id, {r('coalesce(z.v, 0)', 'even')}, {r('coalesce(z2.v, 0)', 'odd')} from g left join z using (area_id, cell_id) left join z2 using (area_id, cell_id)",
)
def g17(spark, sf):
    s, a = area_scope(spark, sf), areas(spark, sf)
    return pick(P.align_benchmarks(P.make_grid(a, SIZE), pixels(spark, sf), a, ["even", "odd"], SIZE, s), ["area_id", "cell_id"], ["even", "odd"])


def component_surface(spark, sf):
    """Customer cells on their 40-column grid with boxes."""
    c = V.cells(spark, sf)
    x, y = F.col("grid_col") * SIZE, F.col("grid_row") * SIZE
    return c.withColumns({"surface_value": F.col("building_area"), "x0": x, "y0": y, "x1": x + SIZE, "y1": y + SIZE, "cell_area_m2": F.lit(SIZE * SIZE), "area_id": F.col("area_id") % 2})


_CC = {
    "c": "select area_id % 2 area_id, cell_id, cell_no, grid_col, grid_row, building_area from cells",
    "h": "select * from (select *, quantile_cont(building_area, 0.6) over (partition by area_id) t from c) where building_area >= t",
    "e": "select a.area_id, a.cell_no u, b.cell_no v from h a, (select unnest([-1, 0, 1]) dc) x, (select unnest([-1, 0, 1]) dr) y, h b where b.area_id = a.area_id and b.grid_col = a.grid_col + dc and b.grid_row = a.grid_row + dr",
}


@query(
    "g18_components",
    V.with_views("cells", extra=_CC).replace("with ", "with recursive ", 1)
    + ", reach(area_id, root, v) as (select area_id, cell_no, cell_no from h union select reach.area_id, root, e.v from reach join e on e.area_id = reach.area_id and e.u = reach.v) "
    "select area_id, v cell_no, min(root) component from reach group by 1, 2",
)
def g18(spark, sf):
    from gridspark.operators.hotspots import zone_mask

    surface = component_surface(spark, sf)
    picked = zone_mask(surface, "hotspot", hot=0.6, scope=Scope.measured(surface.select("area_id"))).where("in_zone")
    return P.components(picked).select("area_id", "cell_no", "component")


@query("g19_component_summary")
def g19(spark, sf):
    surface = component_surface(spark, sf)
    summary, members = P.component_summary(surface, "hotspot", scope=Scope.measured(surface.select("area_id")), hot=0.6)
    sizes = members.groupBy("area_id", "source_component_id").agg(F.count(F.lit(1)).alias("members"))
    return summary.join(sizes, ["area_id", "source_component_id"])


@query(
    "g20_spatial_blocks",
    V.with_views("cells_t", extra={"o": "select *, min(latitude) over w la, min(longitude) over w lo, cos(radians(avg(latitude) over w)) k from cells_t window w as (partition by area_id)"})
    + "select area_id, cell_id, replace(lower(area_name), '_', ' ') || '__bx' || floor((longitude - lo) * greatest(111320 * k, 1e-6) / 2000)::bigint || '_by' || floor((latitude - la) * 111320 / 2000)::bigint block from o",
)
def g20(spark, sf):
    scope = V.scope_of(spark, sf)
    return P.spatial_blocks(V.cells_with_total(spark, sf, scope), 2000.0, scope).select("area_id", "cell_id", "block")


@query(
    "g03_projection_roundtrip",
    "select s_suppkey, round(((s_suppkey * 17) % 340 - 170.0)::double, 6) + 0.0 longitude, round(((s_suppkey * 7) % 150 - 75.0)::double, 6) + 0.0 latitude, floor(((s_suppkey * 17) % 340 - 170.0 + 180) / 6)::int + 1 utm_zone from supplier",
)
def g03(spark, sf):
    s = V.table(spark, sf, "supplier")
    lon, lat = F.expr("(s_suppkey * 17) % 340 - 170.0D"), F.expr("(s_suppkey * 7) % 150 - 75.0D")
    ring = F.array(G.pt(lon - 0.01, lat - 0.01), G.pt(lon + 0.01, lat - 0.01), G.pt(lon + 0.01, lat + 0.01), G.pt(lon - 0.01, lat + 0.01))
    moved = P.to_metric(s.select("s_suppkey", ring.alias("boundary")))
    # the ring comes back vertex by vertex; average its corners
    back = F.transform("boundary", lambda p: G.metric_to_lonlat(p["x"], p["y"], F.col("utm_zone"), F.col("south")))
    out = moved.withColumn("_b", back)
    mean = lambda a: F.aggregate(F.transform("_b", lambda p: p[a]), F.lit(0.0), lambda x, v: x + v) / 4.0
    return out.select("s_suppkey", rnd(mean("x"), 6).alias("longitude"), rnd(mean("y"), 6).alias("latitude"), "utm_zone")


@query("g11_g22_build_cells")
def g22(spark, sf):
    """Area table and map objects to the cell table, one plan."""
    from gridspark.plans.surface import build_cells

    return build_cells(areas(spark, sf), objects(spark, sf), SIZE, scope=area_scope(spark, sf))
