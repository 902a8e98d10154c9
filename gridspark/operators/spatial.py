"""Grids, spatial joins, areal interpolation, raster sums, nearest neighbours and components.

All spatial joins run on grid bins: an object is exploded to the cells its bounding box meets, measured
against the cell box there, and *pre-aggregated per bin before any join*. A cell that holds a third of
all objects is therefore summed by map-side combine and never becomes one big join key.

Objects are rows ``area_id, obj_id, layer, kind, geom, tags`` with ``kind`` in polygon / line / point and
``geom`` an array of points. Areas are rows ``area_id, minx, miny, maxx, maxy`` in metres, with an
optional ``boundary``: a ring, or an array of rings (parts and holes, told apart by the even-odd rule).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.contracts import CELL_COLUMNS, GRID_FEATURES
from gridspark.functions import geometry as G
from gridspark.functions.scalars import clean_tag, direction, slug, to_num
from gridspark.graph import connected_components
from gridspark.operators.hotspots import zone_mask
from gridspark.scope import AREA, Scope, attach, group_agg, materialize, stage, top_k, with_group

CELL_SIZE = 500.0
METERS_PER_DEGREE = 111_320.0

# Tag values behind each building use.
RESIDENTIAL = ("apartments", "detached", "dormitory", "farm", "ger", "house", "residential", "semidetached_house", "terrace")
COMMERCIAL = ("commercial", "industrial", "kiosk", "office", "warehouse")
RETAIL = ("mall", "retail", "supermarket")
PUBLIC = ("civic", "college", "government", "hospital", "kindergarten", "public", "school", "train_station", "transportation", "university")
POI_LAYERS = ("bus_stops", "parks", "schools", "hospitals", "shops")


# ------------------------------------------------------------------------------------------------ grid


def area_bounds(parts: DataFrame, scope: Scope = AREA) -> DataFrame:
    """G02. Bounds of all parts of an area (mergeable min / max); the parts stay rows of their own."""
    b = G.bounds(F.col("geom"))
    boxed = parts.select(*scope.keys, *[c.alias(n) for n, c in b.items()])
    return group_agg(
        boxed, scope, F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )


def to_metric(areas: DataFrame, ring: str = "boundary") -> DataFrame:
    """G03. Longitude / latitude ring to metres in the UTM zone of the area's centre; keeps zone and side."""
    b = G.bounds(F.col(ring))
    centre = areas.withColumns({"_lon": (b["minx"] + b["maxx"]) / 2.0, "_lat": (b["miny"] + b["maxy"]) / 2.0})
    zoned = centre.withColumns({"utm_zone": G.utm_zone(F.col("_lon")), "south": F.col("_lat") < 0})
    moved = F.transform(F.col(ring), lambda p: G.lonlat_to_metric(p["x"], p["y"], F.col("utm_zone"), F.col("south")))
    return zoned.withColumn(ring, moved).drop("_lon", "_lat")


def to_lonlat(df: DataFrame, x: str, y: str) -> DataFrame:
    """G03 back: adds ``longitude`` and ``latitude`` of a metric point (needs ``utm_zone`` and ``south``)."""
    p = G.metric_to_lonlat(F.col(x), F.col(y), F.col("utm_zone"), F.col("south"))
    return df.withColumn("_p", p).withColumns({"longitude": F.col("_p.x"), "latitude": F.col("_p.y")}).drop("_p")


def grid_shape(areas: DataFrame, size_m: float) -> DataFrame:
    if size_m <= 0:
        raise ValueError("the cell size must be positive")
    n = lambda hi, lo: F.ceil((F.col(hi) - F.col(lo)) / F.lit(float(size_m))).cast("long")
    return areas.withColumns({"cell_size": F.lit(float(size_m)), "n_cols": n("maxx", "minx"), "n_rows": n("maxy", "miny")})


def _cell_boxes(shaped: DataFrame, size_m: float, has_boundary: bool) -> DataFrame:
    """Boxes of all cells. A boundary is cut to the column before rows are made: ``_ring`` is its part in the column,
    ``_edges`` are the edges that meet it; columns that it misses end here."""
    one_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cols = shaped.where((F.col("n_cols") > 0) & (F.col("n_rows") > 0))
    if has_boundary:
        nested = isinstance(shaped.schema["boundary"].dataType.elementType, T.ArrayType)
        rings = G.oriented_rings(F.col("boundary") if nested else F.array("boundary"))
        cols = cols.withColumn("_rings", rings)
        cols = cols.withColumns({"_ring": G.merged_ring(F.col("_rings")), "_edges": G.ring_segments(F.col("_rings"))}).drop("_rings", "boundary")
    cols = cols.withColumn("grid_col", F.explode(one_to("n_cols"))).withColumn("x0", F.col("minx") + F.col("grid_col") * size_m).withColumn("x1", F.col("x0") + size_m)
    if has_boundary:
        one, zero = F.lit(1.0), F.lit(0.0)
        strip = F.array(G.half_plane(-one, zero, -F.col("x0")), G.half_plane(one, zero, F.col("x1")))
        near = lambda e: (F.least(e["x0"], e["x1"]) <= F.col("x1")) & (F.greatest(e["x0"], e["x1"]) >= F.col("x0"))
        cols = cols.withColumns({"_edges": F.filter("_edges", near), "_ring": G.clip_ring(F.col("_ring"), strip)})
        cols = cols.where((F.size("_ring") > 0) | (F.size("_edges") > 0))
    # columns of a large area spread over tasks before the second explode
    rows = cols.repartition("area_id", "grid_col").withColumn("grid_row", F.explode(one_to("n_rows")))
    return rows.withColumn("y0", F.col("miny") + F.col("grid_row") * size_m).withColumn("y1", F.col("y0") + size_m)


def _cut_cells(cells: DataFrame) -> DataFrame:
    """Cells that meet the boundary's region, with the part inside (``_part``), its ``_area`` and the ``_edges`` in the cell."""
    planes = G.box_planes(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    one, zero = F.lit(1.0), F.lit(0.0)
    level = F.array(G.half_plane(zero, -one, -F.col("y0")), G.half_plane(zero, one, F.col("y1")))
    made = lambda p: F.struct(p.alias("_part"), G.ring_area(p).alias("_area"), G.segments_in(F.col("_edges"), planes).alias("_in"))
    cut = cells.select("*", F.inline(F.transform(F.array(G.clip_ring(F.col("_ring"), level)), made)))
    return cut.where((F.col("_area") > 0) | (F.size("_in") > 0)).drop("_ring", "_edges").withColumnRenamed("_in", "_edges")


def boundary_cells(areas: DataFrame, size_m: float = CELL_SIZE) -> DataFrame:
    """Cells of areas with a boundary: ``_region`` and ``_edges`` are null where the cell lies wholly inside."""
    cut = _cut_cells(_cell_boxes(grid_shape(areas, size_m), size_m, True))
    whole = (F.size("_edges") == 0) & (F.col("_area") >= float(size_m) ** 2 * (1 - 1e-12))
    return cut.select(
        "area_id", "grid_col", "grid_row", F.when(~whole, F.col("_part")).alias("_region"), F.when(~whole, F.col("_edges")).alias("_edges")
    )


def make_grid(areas: DataFrame, size_m: float = CELL_SIZE, clip: bool = True, prefix: str = "Z") -> DataFrame:
    """G01. Cells over the area bounds, column-major, numbered among the kept ones.

    Rows are generated by two explodes. With a boundary, cells that miss it are dropped and (``clip``)
    the geometry is the part inside (several pieces or a hole make one ring, joined along edges that cancel out). Numbering needs no sort of an area: rows are numbered inside their
    column and columns carry an offset.
    """
    if not prefix:
        raise ValueError("the cell id prefix must not be empty")
    shaped = grid_shape(areas, size_m)
    has_boundary = "boundary" in areas.columns
    cells = _cell_boxes(shaped, size_m, has_boundary)
    box = G.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    if not has_boundary:
        number = F.col("grid_col") * F.col("n_rows") + F.col("grid_row") + 1
        out = cells.withColumns({"geom": box, "cell_area_m2": F.lit(float(size_m) ** 2)})
    else:
        kept = _cut_cells(cells)
        per_col = kept.groupBy("area_id", "grid_col").agg(F.count(F.lit(1)).alias("_k"))
        earlier = Window.partitionBy("area_id").orderBy("grid_col").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_col.select("area_id", "grid_col", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_off"))
        in_col = Window.partitionBy("area_id", "grid_col").orderBy("grid_row")
        out = kept.join(offsets, ["area_id", "grid_col"]).withColumn("_n", F.row_number().over(in_col))
        number = F.col("_off") + F.col("_n")
        geom = F.col("_part") if clip else box
        out = out.withColumns({"geom": geom, "cell_area_m2": F.col("_area") if clip else F.lit(float(size_m) ** 2)})
    return out.withColumn("cell_no", number.cast("long")).select(
        "area_id",
        F.concat(F.lit(prefix), F.col("cell_no")).alias("cell_id"),
        "cell_no",
        "grid_col",
        "grid_row",
        "x0",
        "y0",
        "x1",
        "y1",
        "geom",
        "cell_area_m2",
    )


def centroids(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_c", G.ring_centroid(F.col("geom"))).withColumns({"cx": F.col("_c.x"), "cy": F.col("_c.y")}).drop("_c")


# ------------------------------------------------------------------------------------ objects per cell


def use_flags(objects: DataFrame) -> DataFrame:
    """G06. Four use flags from tags; they may overlap."""
    tag = lambda k: clean_tag(F.col("tags"), k)
    building = tag("building")
    return objects.withColumns(
        {
            "is_residential": building.isin(*RESIDENTIAL),
            "is_commercial": building.isin(*COMMERCIAL) | (tag("office") != ""),
            "is_retail": building.isin(*RETAIL) | (tag("shop") != ""),
            "is_public": building.isin(*PUBLIC) | tag("amenity").isin(*PUBLIC),
        }
    )


def levels(objects: DataFrame, fallback: float = 1.0) -> DataFrame:
    """G07. Positive numeric levels or null, and the effective levels for floor area (at least 1)."""
    n = to_num(F.col("tags")["building:levels"])
    lv = F.when(n > 0, n)
    return objects.withColumns(
        {"levels": lv, "effective_levels": F.greatest(F.coalesce(lv, F.lit(fallback)), F.lit(1.0))}
    )


def reached_cells(placed: DataFrame, size_m: float) -> DataFrame:
    """Objects with their boxes (``_bminx`` to ``_bmaxy``), ``_rect`` and grid (``_minx, _miny, _n_cols, _n_rows``), one row per cell they can meet.

    An object becomes one row per grid column first; there its own edges between the column's borders tell the rows of
    the grid it reaches, so a long thin object costs as many cells as it crosses, not as its bounding box holds. Adds
    ``grid_col, grid_row`` and the cell's lower corner ``_x0, _y0``. Objects without a ``geom`` column reach what their boxes reach.
    """

    def span(lo, hi, origin, n):
        first = F.greatest(F.ceil((F.col(lo) - F.col(origin)) / size_m) - 1, F.lit(0))
        last = F.least(F.floor((F.col(hi) - F.col(origin)) / size_m), F.col(n) - 1)
        return F.when(first <= last, F.sequence(first, last))

    by_col = placed.withColumn("grid_col", F.explode(span("_bminx", "_bmaxx", "_minx", "_n_cols"))).withColumn("_x0", F.col("_minx") + F.col("grid_col") * size_m)
    by_row = lambda df, lo, hi: df.withColumn("grid_row", F.explode(span(lo, hi, "_miny", "_n_rows"))).withColumn("_y0", F.col("_miny") + F.col("grid_row") * size_m)
    if "geom" not in placed.columns:
        return by_row(by_col, "_bminy", "_bmaxy")
    g, kind = F.col("geom"), F.col("kind")
    # edges are cut at the borders with rounding: a hair more is looked at, and the cell decides
    hair = 1e-6 * size_m
    edges_of = F.when(kind == "polygon", G.ring_edges(g)).otherwise(G.path_segments(g))
    wide = (kind != "point") & ~F.col("_rect") & (F.col("_bmaxx") - F.col("_bminx") > size_m) & (F.col("_bmaxy") - F.col("_bminy") > size_m)
    reach = F.when(wide, G.strip_range(edges_of, F.col("_x0") - hair, F.col("_x0") + size_m + hair))
    reached = by_col.withColumn("_reach", F.explode(F.array(reach)))  # a generator: computed once per column, not once per border
    return by_row(reached.withColumns({"_low": F.coalesce(F.col("_reach.lo") - hair, "_bminy"), "_high": F.coalesce(F.col("_reach.hi") + hair, "_bmaxy")}), "_low", "_high")


def _is_plain(geom: Column, kind: Column) -> Column:
    """A box along the axes, a flat line, or a point."""
    p, q = F.get(geom, F.lit(0)), F.get(geom, F.lit(1))
    flat = (F.size(geom) == 2) & ((p["x"] == q["x"]) != (p["y"] == q["y"]))
    return F.coalesce(F.when(kind == "polygon", G.is_box(geom)).when(kind == "line", flat).when(kind == "point", F.size(geom) == 1), F.lit(False))


def _measured_bins(objects: DataFrame, areas: DataFrame, size_m: float, scope: Scope) -> tuple[DataFrame, DataFrame | None]:
    """Objects with ``grid_col, grid_row, measure`` per cell of the grid they meet, and the cells that a boundary meets (None without).

    Rows of cells that the boundary misses are still among them. Plain objects (``_is_plain``) lose their geometry before the
    explode and are measured by arithmetic, which is compiled as one piece; in cells that a boundary's edge crosses they and
    everywhere the others are cut by half planes.
    """
    cols = ["minx", "miny", "n_cols", "n_rows"]
    shaped = grid_shape(areas, size_m).select(*scope.keys, *[F.col(c).alias(f"_{c}") for c in cols])
    geom, kind = F.col("geom"), F.col("kind")
    width, height = F.col("_bmaxx") - F.col("_bminx"), F.col("_bmaxy") - F.col("_bminy")
    x0, y0, x1, y1 = F.col("_x0"), F.col("_y0"), F.col("_x0") + size_m, F.col("_y0") + size_m
    overlap = lambda lo, hi, c0, c1: F.greatest(F.least(F.col(hi), c1) - F.greatest(F.col(lo), c0), F.lit(0.0))
    across, along = overlap("_bminx", "_bmaxx", x0, x1), overlap("_bminy", "_bmaxy", y0, y1)
    kept = [*objects.columns, "grid_col", "grid_row", "measure"]
    kept.remove("geom")

    easy = objects.where(_is_plain(geom, kind)).withColumns({f"_b{n}": c for n, c in G.corner_bounds(geom).items()}).drop("geom")
    easy = reached_cells(attach(easy, shaped, scope, "inner"), size_m)
    hit = (F.col("_bminx") <= x1) & (F.col("_bmaxx") >= x0) & (F.col("_bminy") <= y1) & (F.col("_bmaxy") >= y0)
    share = F.when(kind == "polygon", across * along).when((kind == "line") & hit, across + along).otherwise(F.lit(0.0))

    # size of the whole object, and whether it fills its bounding box: both once per object, before the explode
    hard = objects.where(~_is_plain(geom, kind)).withColumns({f"_b{n}": c for n, c in G.bounds(geom).items()})
    whole = F.when(kind == "polygon", G.ring_area(geom)).when(kind == "line", G.path_length(geom)).otherwise(F.lit(0.0))
    hard = hard.withColumn("_whole", whole).withColumn("_rect", (kind == "polygon") & (F.size(geom) == 4) & (F.abs(F.col("_whole") - width * height) <= 1e-9 * width * height))
    hard = reached_cells(attach(hard, shaped, scope, "inner"), size_m)
    region, edges = F.lit(None).cast("array<struct<x:double,y:double>>"), F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    met = None
    if "boundary" in areas.columns:
        # only cells that an edge crosses bring their region, broadcast where they were counted and are few
        met = materialize(boundary_cells(areas, size_m))
        crossed = met.where(F.col("_region").isNotNull())
        by_cell = Scope((*scope.keys, "grid_col", "grid_row"), tuple(c for c in ("obj_id",) if c in objects.columns), crossed.count())
        low, high = G.pt(F.col("_bminx"), F.col("_bminy")), G.pt(F.col("_bmaxx"), F.col("_bmaxy"))
        ring = G.box_ring(F.col("_bminx"), F.col("_bminy"), F.col("_bmaxx"), F.col("_bmaxy"))
        drawn = F.when(kind == "polygon", ring).when(kind == "line", F.array(low, high)).otherwise(F.array(low))
        size = F.when(kind == "polygon", width * height).when(kind == "line", width + height).otherwise(F.lit(0.0))
        cut = attach(easy, crossed, by_cell, "inner").withColumns({"geom": drawn, "_whole": size, "_rect": kind == "polygon"})
        easy = attach(easy, crossed.select(*by_cell.keys), by_cell, "left_anti")
        hard = attach(hard, crossed, by_cell, "left").unionByName(cut, allowMissingColumns=True)
        region, edges = F.col("_region"), F.col("_edges")
    measured = easy.where((kind == "polygon") | hit).withColumn("measure", share).select(*kept)
    return measured.unionByName(_cut_objects(hard, size_m, region, edges).select(*kept)), met


def _cut_objects(exploded: DataFrame, size_m: float, region: Column, edges: Column) -> DataFrame:
    """Objects of ``reached_cells`` that meet their cell and, unless it is null, the boundary's ``region`` in it, with their ``measure`` there."""
    g, kind = F.col("geom"), F.col("kind")
    x0, y0, x1, y1 = F.col("_x0"), F.col("_y0"), F.col("_x0") + size_m, F.col("_y0") + size_m
    planes = G.box_planes(x0, y0, x1, y1)
    open_box = region.isNull()
    inside = open_box & (F.col("_bminx") > x0) & (F.col("_bmaxx") < x1) & (F.col("_bminy") > y0) & (F.col("_bmaxy") < y1)
    rect = open_box & F.col("_rect")
    overlap = lambda lo, hi, c0, c1: F.greatest(F.least(F.col(hi), c1) - F.greatest(F.col(lo), c0), F.lit(0.0))

    def size_in(h):
        return (
            F.when(inside, F.col("_whole"))
            .when(rect, overlap("_bminx", "_bmaxx", x0, x1) * overlap("_bminy", "_bmaxy", y0, y1))
            .when(kind == "point", F.lit(0.0))
            .when((kind == "line") & open_box, G.clipped_length(g, h))
            .when(kind == "line", G.length_in_region(g, h, region, edges))
            .when(open_box, G.ring_area(G.clip_ring(g, h)))
            .otherwise(G.let(G.clip_ring(g, h), lambda r: G.overlap_area(r, region, y0)))
        )

    # a point on the border of its cell belongs to what lies next to it inside the cell
    inward = lambda v, low, high: v + ((low + high) / 2.0 - v) * 1e-7
    in_region = lambda x, y: G.point_in_ring(inward(x, x0, x1), inward(y, y0, y1), region) | G.on_segment(x, y, edges)

    def meets(h, m):
        px, py = g[0]["x"], g[0]["y"]
        within = F.forall(h, lambda e: e["c"] - e["a"] * px - e["b"] * py >= 0)
        return (
            F.when(inside | rect | (m > 0), F.lit(True))
            .when((kind == "point") & open_box, within)
            .when(kind == "point", within & in_region(px, py))
            # what has no measure there may still touch: an edge of the boundary, or the region's closed part of the cell
            .when(~open_box & (kind == "line"), G.meets_segments(g, edges, closed=False) | F.exists(G.segments_in(G.path_segments(g), h), lambda q: in_region(q["x0"], q["y0"])))
            .when(~open_box, G.meets_segments(g, edges, closed=True) | F.exists(G.clip_ring(g, h), lambda q: in_region(q["x"], q["y"])))
            .when(kind == "line", G.path_touches(g, h))
            .otherwise(G.ring_touches(g, h, m))
        )

    both = lambda h: G.let(size_in(h), lambda m: F.struct(m.alias("measure"), meets(h, m).alias("touches")))
    # the generator keeps later filters from pushing the geometry down and computing it again
    return exploded.select("*", F.inline(F.transform(F.array(planes), both))).where("touches")


def bin_objects(objects: DataFrame, areas: DataFrame, size_m: float = CELL_SIZE, scope: Scope = AREA) -> DataFrame:
    """Objects exploded to the cells they can meet, with the exact measure in that cell.

    Adds ``grid_col, grid_row, measure`` (area of polygons, length of lines, 0 for points); the geometry stays behind.
    Without a boundary nothing is joined but the one-row-per-area grid parameters. With one, only in cells that its
    edge crosses is its part there looked at, and it may have any shape; rows of cells that it misses go at the end (salted, so
    a cell full of objects is no hot key).
    """
    bins, met = _measured_bins(objects, areas, size_m, scope)
    if met is None:
        return bins
    by_cell = Scope((*scope.keys, "grid_col", "grid_row"), tuple(c for c in ("obj_id",) if c in objects.columns))
    return attach(bins, met.select(*by_cell.keys), by_cell, "inner")


def _per_cell(objects: DataFrame, areas: DataFrame, size_m: float, scope: Scope, *aggs: Column) -> DataFrame:
    """Aggregates of the objects that meet a cell; cells that a boundary misses go when they are one row each."""
    keys = [*scope.keys, "grid_col", "grid_row"]
    bins, met = _measured_bins(objects, areas, size_m, scope)
    sums = bins.groupBy(*keys).agg(*aggs)
    return sums if met is None else sums.join(met.select(*keys), keys, "left_semi")


def _on_cells(cells: DataFrame, sums: DataFrame, filled: Sequence[str], scope: Scope = AREA) -> DataFrame:
    keys = [*scope.keys, "grid_col", "grid_row"]
    return cells.join(sums, keys, "left").na.fill(0, list(filled))


def count_in_cells(cells: DataFrame, objects: DataFrame, areas: DataFrame, size_m: float = CELL_SIZE, scope: Scope = AREA) -> DataFrame:
    """G04. Number of objects meeting each cell (closed sets: touching counts)."""
    sums = _per_cell(objects, areas, size_m, scope, F.count(F.lit(1)).alias("object_count"))
    return _on_cells(cells, sums, ["object_count"], scope)


def measure_in_cells(cells: DataFrame, objects: DataFrame, areas: DataFrame, size_m: float = CELL_SIZE, scope: Scope = AREA) -> DataFrame:
    """G05. Summed intersection area (polygons) or length (lines) per cell."""
    sums = _per_cell(objects, areas, size_m, scope, F.sum("measure").alias("object_measure"))
    return _on_cells(cells, sums, ["object_measure"], scope)


def cell_features(cells: DataFrame, objects: DataFrame, areas: DataFrame, size_m: float = CELL_SIZE, scope: Scope = AREA) -> DataFrame:
    """G08. Fifteen features of every cell from one pass over all layers; empty cells get zeros."""
    flagged = levels(use_flags(objects)).drop("tags")  # once per object, not once per cell it meets
    layer = F.col("layer")
    m = F.col("measure")
    count = lambda cond: F.count_if(cond).cast("double")
    total = lambda cond, v=m: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    is_b = layer == "buildings"
    sums = _per_cell(
        flagged,
        areas,
        size_m,
        scope,
        count(is_b).alias("building_count"),
        total(is_b).alias("building_area"),
        total(is_b & F.col("is_residential")).alias("residential_area"),
        total(is_b & F.col("is_commercial")).alias("commercial_area"),
        total(is_b & F.col("is_retail")).alias("retail_area"),
        total(is_b & F.col("is_public")).alias("public_area"),
        total(layer == "roads").alias("road_length"),
        count(layer == "bus_stops").alias("bus_stop_count"),
        total(layer == "parks").alias("park_area"),
        count(is_b & F.col("levels").isNotNull()).alias("building_with_levels_count"),
        F.coalesce(F.avg(F.when(is_b, F.col("levels"))), F.lit(0.0)).alias("mean_building_levels"),
        total(is_b, m * F.col("effective_levels")).alias("total_floor_area"),
        count(layer == "schools").alias("schools_count"),
        count(layer == "hospitals").alias("hospitals_count"),
        count(layer.isin("parks", "shops")).alias("parks_shops_count"),
    )
    return _on_cells(cells, sums, GRID_FEATURES, scope)


# ---------------------------------------------------------------------------------- nearest neighbours


def poi_points(objects: DataFrame, layers: Sequence[str] = POI_LAYERS) -> DataFrame:
    """G09. One interior point per object of the POI layers."""
    g = F.col("geom")
    middle = g[F.floor((F.size(g) - 1) / 2.0).cast("int")]
    p = F.when(F.col("kind") == "polygon", G.ring_point(g)).when(F.col("kind") == "line", middle).otherwise(g[0])
    return (
        objects.where(F.col("layer").isin(*layers))
        .withColumn("_p", p)
        .select("area_id", "obj_id", "layer", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    )


def knn_access(
    cells: DataFrame,
    pois: DataFrame,
    k: int = 5,
    epsilon: float = 1.0,
    base_m: float = CELL_SIZE / 4,
    levels: int | None = None,
    factor: int = 4,
    scope: Scope = AREA,
) -> DataFrame:
    """G10. ``1 / (mean distance to the min(k, n) nearest POIs + epsilon)``; 0 where an area has none.

    Exact descent through a pyramid of bins. A candidate bin has a nearest and a farthest possible
    distance to the cell centre; the smallest radius whose fully covered bins already hold k POIs bounds
    the k-th distance, and bins beyond it are dropped before the next finer level is opened. Points at
    one place are merged with a multiplicity of at most k, so a dense spot stays a few rows. Unless ``levels`` is
    given, the pyramid is as high as the widest area's points ask for, so that its top has a handful of bins per area.
    """
    keys = list(scope.keys)
    centre = cells.select(*keys, "cell_id", "cx", "cy")
    spots = (
        pois.groupBy(*keys, "x", "y")
        .agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("m"))
        .withColumns({"bx": F.floor(F.col("x") / base_m), "by": F.floor(F.col("y") / base_m)})
    )
    spots = materialize(spots)  # every level of the pyramid reads them
    if levels is None:
        span = lambda c: F.max(c) - F.min(c)
        widest = spots.groupBy(*keys).agg(F.greatest(span("x"), span("y")).alias("_e")).agg(F.max("_e")).first()[0]
        levels = 1 + math.ceil(math.log(max((widest or 0.0) / base_m, 1.0), factor))
    pyramid = [spots.groupBy(*keys, "bx", "by").agg(F.sum("m").alias("m"))]
    for _ in range(levels - 1):
        up = lambda c: F.floor(F.col(c) / factor).alias(c)
        pyramid.append(pyramid[-1].groupBy(*keys, up("bx"), up("by")).agg(F.sum("m").alias("m")))

    row = [*keys, "cell_id", "cx", "cy"]

    def prune(pairs: DataFrame, size: float) -> DataFrame:
        """Keep candidate bins that can still hold one of the k nearest."""
        lo = lambda c, b: F.greatest(F.col(b) * size - F.col(c), F.col(c) - (F.col(b) + 1) * size, F.lit(0.0))
        hi = lambda c, b: F.greatest(F.abs(F.col(b) * size - F.col(c)), F.abs((F.col(b) + 1) * size - F.col(c)))
        ranged = pairs.withColumns(
            {"_near": F.hypot(lo("cx", "bx"), lo("cy", "by")), "_far": F.hypot(hi("cx", "bx"), hi("cy", "by"))}
        )
        by_cell = Window.partitionBy(*keys, "cell_id")  # the candidate bins of one cell
        by_far = by_cell.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)
        covered = ranged.withColumn("_have", F.sum("m").over(by_far))
        radius = F.min(F.when(F.col("_have") >= k, F.col("_far"))).over(by_cell)
        return (
            covered.withColumn("_r", radius)
            .where(F.col("_r").isNull() | (F.col("_near") <= F.col("_r")))
            .select(*row, "bx", "by")
        )

    top = pyramid[-1]
    pairs = attach(centre, top, Scope(scope.keys, ("cell_id",)), "inner")  # salted: an area may hold most cells
    for level in range(levels - 1, -1, -1):
        kept = prune(pairs, base_m * factor**level)
        if level == 0:
            break
        finer = pyramid[level - 1].withColumns(
            {"_cx": F.col("bx"), "_cy": F.col("by"), "bx": F.floor(F.col("bx") / factor), "by": F.floor(F.col("by") / factor)}
        )
        pairs = kept.join(finer, [*keys, "bx", "by"]).select(*row, F.col("_cx").alias("bx"), F.col("_cy").alias("by"), "m")
    near = kept.join(spots, [*keys, "bx", "by"]).withColumn("_d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    by_cell = Window.partitionBy(*keys, "cell_id").orderBy("_d", "x", "y")
    before = F.coalesce(F.sum("m").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = near.withColumn("_t", F.least(F.col("m"), F.greatest(F.lit(k) - before, F.lit(0))))
    means = taken.groupBy(*keys, "cell_id").agg((F.sum(F.col("_d") * F.col("_t")) / F.sum("_t")).alias("_mean"))
    index = F.coalesce(1.0 / (F.col("_mean") + epsilon), F.lit(0.0))
    return cells.join(means, [*keys, "cell_id"], "left").withColumn("poi_access_index", index).drop("_mean")


def feature_output(cells: DataFrame, areas: DataFrame, scope: Scope = AREA) -> DataFrame:
    """G11. Cell table in contract order, centroid in longitude and latitude when the zone is known."""
    located = cells if "cx" in cells.columns else centroids(cells)
    if "utm_zone" in areas.columns:
        located = to_lonlat(attach(located, areas.select(*scope.keys, "utm_zone", "south"), scope), "cx", "cy")
    else:
        located = located.withColumns({"longitude": F.col("cx"), "latitude": F.col("cy")})
    return located.select(*[c for c in CELL_COLUMNS if c in located.columns])


# ------------------------------------------------------------------------------------------- districts


def polygonal_only(parts: Column) -> Column:
    """G13. Rings of the polygon parts of a geometry collection; null when none is left."""
    rings = F.transform(F.filter(parts, lambda p: p["kind"] == "polygon"), lambda p: p["ring"])
    return F.when(F.size(rings) > 0, rings)


def district_shares(districts: DataFrame, scope: Scope, predicted: str = "predicted_population") -> DataFrame:
    """G12 tail: gap, and official and predicted shares over all districts of the group."""
    joined = with_group(districts, scope, {"_o": F.sum("official_population"), "_p": F.sum(predicted)})
    share = lambda c, t: F.when(F.col(t) > 0, F.try_divide(F.col(c).cast("double"), F.col(t)))
    return joined.withColumns(
        {
            "population_gap": F.col(predicted) - F.col("official_population"),
            "official_share": share("official_population", "_o"),
            "predicted_share": share(predicted, "_p"),
        }
    ).drop("_o", "_p")


def overlap_sums(
    cells: DataFrame,
    districts: DataFrame,
    areas: DataFrame,
    values: Mapping[str, str],
    size_m: float = CELL_SIZE,
    scope: Scope = AREA,
) -> DataFrame:
    """Value x overlap area / cell area, summed per district (rows ``area_id, district_name, geom``).

    A district may have several rows, one per polygon part. Each part is exploded to bins; the join with
    cells is one row per cell and part, on (area, column, row).
    """
    parts = districts.select(*scope.keys, "district_name", "geom", F.lit("polygon").alias("kind"))
    bins = bin_objects(parts, areas, size_m, scope).where("measure > 0")
    per_bin = bins.groupBy(*scope.keys, "district_name", "grid_col", "grid_row").agg(F.sum("measure").alias("_overlap"))
    used = cells.where(F.col("cell_area_m2") > 0).select(*scope.keys, "grid_col", "grid_row", "cell_area_m2", *values.values())
    joined = per_bin.join(used, [*scope.keys, "grid_col", "grid_row"])
    part = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("_overlap") / F.col("cell_area_m2"))
    return joined.groupBy(*scope.keys, "district_name").agg(
        F.sum("_overlap").alias("intersection_area"), *[part(c).alias(n) for n, c in values.items()]
    )


def areal_interpolate(
    cells: DataFrame,
    districts: DataFrame,
    areas: DataFrame,
    value: str = "surface_value",
    size_m: float = CELL_SIZE,
    scope: Scope = AREA,
) -> DataFrame:
    """G12. Predicted value per district; districts without overlap stay at 0, shares are over all districts."""
    sums = overlap_sums(cells, districts, areas, {"predicted_population": value}, size_m, scope)
    base = districts.drop("geom").dropDuplicates([*scope.keys, "district_name"])
    joined = base.join(sums, [*scope.keys, "district_name"], "left").na.fill(0.0, ["predicted_population", "intersection_area"])
    return district_shares(joined, scope)


def district_intervals(
    cells: DataFrame, districts: DataFrame, areas: DataFrame, size_m: float = CELL_SIZE, scope: Scope = AREA
) -> DataFrame:
    """B06. One interpolation with three sums, then width, relative width and covered flag."""
    from gridspark.operators.stats import interval_columns

    names = {f"predicted_{p}": p for p in ("p10", "p50", "p90")}
    sums = overlap_sums(cells, districts, areas, names, size_m, scope)
    base = districts.drop("geom").dropDuplicates([*scope.keys, "district_name"])
    joined = base.join(sums, [*scope.keys, "district_name"], "left").na.fill(0.0, list(names))
    return interval_columns(joined)


def match_districts(
    reference: DataFrame,
    candidates: DataFrame,
    cells: DataFrame | None = None,
    areas: DataFrame | None = None,
    size_m: float = CELL_SIZE,
    scope: Scope = AREA,
) -> tuple[DataFrame, DataFrame]:
    """G14. Best candidate polygon per reference district, and the districts without one.

    ``reference`` carries ``tokens ARRAY<STRING>`` and ``candidates`` ``names ARRAY<STRING>`` (both
    normalised), ``cand_id`` and ``geom``. Ties go to the largest overlap with the surface, then area.
    """
    keys = list(scope.keys)
    tokens = reference.select(*keys, "district_name", F.explode("tokens").alias("_token")).where(F.col("_token") != "").distinct()
    names = candidates.select(*keys, "cand_id", F.explode("names").alias("_token")).distinct()
    hits = tokens.join(names, [*keys, "_token"]).select(*keys, "district_name", "cand_id").distinct()
    sized = candidates.withColumn("_area", G.ring_area(F.col("geom"))).select(*keys, "cand_id", "geom", "_area")
    if cells is not None and areas is not None:
        named = candidates.select(*keys, F.col("cand_id").alias("district_name"), "geom")
        overlap = overlap_sums(cells, named, areas, {}, size_m, scope).select(
            *keys, F.col("district_name").alias("cand_id"), F.col("intersection_area").alias("_overlap")
        )
        sized = sized.join(overlap, [*keys, "cand_id"], "left").na.fill(0.0, ["_overlap"])
    else:
        sized = sized.withColumn("_overlap", F.lit(0.0))
    joined = hits.join(sized, [*keys, "cand_id"])
    best = joined.groupBy(*keys, "district_name").agg(
        F.max_by(F.struct("cand_id", "geom"), F.struct("_overlap", "_area", "cand_id")).alias("_best")
    )
    matched = reference.join(best.select(*keys, "district_name", "_best.*"), [*keys, "district_name"])
    misses = reference.join(best, [*keys, "district_name"], "left_anti").select(*keys, "district_name")
    return matched, misses


# --------------------------------------------------------------------------------------------- rasters


def covers(outer: Mapping[str, Column], inner: Mapping[str, Column], tolerance: float = 1e-9) -> Column:
    """G16. Does one box cover the other?"""
    return (
        (outer["minx"] <= inner["minx"] + tolerance)
        & (outer["miny"] <= inner["miny"] + tolerance)
        & (outer["maxx"] >= inner["maxx"] - tolerance)
        & (outer["maxy"] >= inner["maxy"] - tolerance)
    )


def raster_coverage(areas: DataFrame, rasters: DataFrame, scope: Scope = AREA) -> DataFrame:
    """G16 over a batch: raster count and whether every raster of an area covers its bounds.

    ``rasters`` has ``area_id, raster_id, minx, miny, maxx, maxy``.
    """
    side = lambda p: {n: F.col(f"{p}{n}") for n in ("minx", "miny", "maxx", "maxy")}
    named = rasters.select(*scope.keys, *[F.col(n).alias(f"r_{n}") for n in ("minx", "miny", "maxx", "maxy")])
    joined = attach(named, areas.select(*scope.keys, "minx", "miny", "maxx", "maxy"), scope, "inner")
    return group_agg(
        joined, scope, F.count(F.lit(1)).alias("raster_count"), F.bool_and(covers(side("r_"), side(""))).alias("coverage_ok")
    )


def zonal_sum(
    cells: DataFrame,
    pixels: DataFrame,
    areas: DataFrame,
    size_m: float = CELL_SIZE,
    scope: Scope = AREA,
    all_touched: bool = True,
    extra_keys: Sequence[str] = (),
    out: str = "raster_value",
) -> DataFrame:
    """G15. Pixel values per cell; a pixel goes to one cell, the last (highest number) it overlaps.

    ``pixels`` has ``area_id, raster_id, row, col, x0, y0, x1, y1, value`` (value null where masked);
    negatives and non-finite values count 0 and several rasters add up. With ``all_touched`` off the pixel
    centre decides.
    """
    shaped = grid_shape(areas, size_m).select(*scope.keys, "minx", "miny", "n_cols", "n_rows")
    v = to_num(F.col("value"))
    placed = attach(pixels.withColumn("_v", F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))), shaped, scope, "inner")

    def span(lo, hi, origin, n):
        if all_touched:
            first = F.floor((F.col(lo) - F.col(origin)) / size_m)
            last = F.ceil((F.col(hi) - F.col(origin)) / size_m) - 1
        else:
            first = last = F.floor(((F.col(lo) + F.col(hi)) / 2.0 - F.col(origin)) / size_m)
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.col(n) - 1)
        return F.when(first <= last, F.sequence(first, last))

    pixel = [*scope.keys, *extra_keys, "raster_id", "row", "col"]
    binned = (
        placed.where("_v > 0")
        .withColumn("grid_col", F.explode(span("x0", "x1", "minx", "n_cols")))
        .withColumn("grid_row", F.explode(span("y0", "y1", "miny", "n_rows")))
        .select(*pixel, "grid_col", "grid_row", "_v")
    )
    known = cells.select(*scope.keys, "grid_col", "grid_row", "cell_id", "cell_no")
    owner = (
        binned.join(known, [*scope.keys, "grid_col", "grid_row"])
        .groupBy(*pixel)
        .agg(F.max(F.struct("cell_no", "cell_id", "_v")).alias("_o"))
    )
    sums = owner.groupBy(*scope.keys, *extra_keys, F.col("_o.cell_id").alias("cell_id")).agg(F.sum("_o._v").alias(out))
    if extra_keys:
        return sums
    return cells.join(sums, [*scope.keys, "cell_id"], "left").na.fill(0.0, [out])


def align_benchmarks(
    cells: DataFrame, pixels: DataFrame, areas: DataFrame, products: Sequence[str], size_m: float = CELL_SIZE, scope: Scope = AREA
) -> DataFrame:
    """G17. One column per benchmark product beside the surface; ``pixels`` carries ``product``."""
    long = zonal_sum(cells, pixels, areas, size_m, scope, extra_keys=("product",))
    wide = long.groupBy(*scope.keys, "cell_id").pivot("product", list(products)).agg(F.sum("raster_value"))
    return cells.join(wide, [*scope.keys, "cell_id"], "left").na.fill(0.0, list(products))


# ------------------------------------------------------------------------------------------ components


def components(cells: DataFrame, scope: Scope = AREA) -> DataFrame:
    """G18. Label of the connected component (8 neighbours) of every cell: its smallest cell number.

    Neighbours are edges of one graph over all areas, contracted until no edge is left (``connected_components``):
    rounds grow with the logarithm of the number of cells, whatever the shapes.
    """
    keys = list(scope.keys)
    node = F.struct(*keys, "cell_no")
    base = cells.select(*keys, "grid_col", "grid_row", node.alias("src"))
    # half of the eight directions: the others are the same edges
    ahead = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sides = base.withColumn("_s", F.explode(ahead)).select(
        *keys, F.col("src").alias("dst"), (F.col("grid_col") + F.col("_s.a")).alias("grid_col"), (F.col("grid_row") + F.col("_s.b")).alias("grid_row")
    )
    edges = base.join(sides, [*keys, "grid_col", "grid_row"]).select("src", "dst")
    joined = connected_components(edges).select(*[F.col(f"node.{c}").alias(c) for c in [*keys, "cell_no"]], F.col("component.cell_no").alias("_least"))
    return cells.join(joined, [*keys, "cell_no"], "left").withColumn("component", F.coalesce("_least", "cell_no")).drop("_least")


COMPONENT_MEANS = ("building_area", "total_floor_area", "road_length", "poi_access_index")


def component_summary(
    surface: DataFrame,
    zone: str,
    value: str = "surface_value",
    scope: Scope = AREA,
    hot: float = 0.90,
    cold: float = 0.10,
    min_cells: int = 3,
    top: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """G19. Ranked components of hot or cold cells, and their members as a long table.

    Hot components rank by total then mean, cold ones by size then (low) mean; ids are ``zone_01``...
    Members are rows ``(area_id, source_component_id, cell_id)``: a component may be as large as its area,
    so its ids are never gathered into one value. Needs cell boxes ``x0..y1`` and ``cell_area_m2``.
    """
    keys = list(scope.keys)
    picked = stage(zone_mask(surface, zone, value, scope, hot, cold).where("in_zone"), scope)
    labelled = components(picked, scope)
    fine = [*keys, "component"]
    cx, cy = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    w = F.col("cell_area_m2")
    weighted = lambda c: F.try_divide(F.sum(c * w), F.sum(w))
    box = group_agg(
        picked, scope, F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy")
    )
    rows = labelled.groupBy(*fine).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.sum(value).alias("total_value"),
        F.avg(value).alias("mean_value"),
        *[F.avg(c).alias(f"{c}_mean") for c in COMPONENT_MEANS if c in surface.columns],
        weighted(cx).alias("centroid_x"),
        weighted(cy).alias("centroid_y"),
        F.max("selection_threshold").alias("selection_threshold"),
    )
    big = rows.where(F.col("cell_count") >= min_cells)
    order = [("total_value", False), ("mean_value", False)] if zone == "hotspot" else [("cell_count", False), ("mean_value", True)]
    ranked = top_k(big, Scope(scope.keys, ("component",), scope.groups), order, top, "rank_within_zone_type")
    summary = attach(ranked, box, scope).withColumns(
        {
            "zone_type": F.lit(zone),
            "source_component_id": F.format_string(f"{zone}_%02d", F.col("rank_within_zone_type").cast("int")),
            "direction_label": direction(
                F.col("centroid_x"), F.col("centroid_y"), F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")
            ),
        }
    )
    ids = summary.select(*fine, "source_component_id")
    members = attach(labelled.select(*fine, "cell_id"), ids, Scope(tuple(fine), ("cell_id",)), "inner")
    return summary.drop("minx", "miny", "maxx", "maxy", "component"), members.select(*keys, "source_component_id", "cell_id")


def spatial_blocks(df: DataFrame, size_m: float = 2000.0, scope: Scope = AREA, name: str | None = "area_name") -> DataFrame:
    """G20. Block label ``<area slug>__bx<i>_by<j>`` from metres off the area's lowest latitude and longitude."""
    if size_m <= 0:
        raise ValueError("the block size must be positive")
    origin = with_group(
        df, scope, {"_lat0": F.min("latitude"), "_lon0": F.min("longitude"), "_mean": F.avg("latitude")}
    )
    per_lon = F.greatest(METERS_PER_DEGREE * F.cos(F.radians("_mean")), F.lit(1e-6))
    bx = F.floor((F.col("longitude") - F.col("_lon0")) * per_lon / size_m)
    by = F.floor((F.col("latitude") - F.col("_lat0")) * METERS_PER_DEGREE / size_m)
    key = slug(F.col(name)) if name else F.col(scope.keys[0]).cast("string")
    key = F.replace(key, F.lit("_"), F.lit(" "))
    label = F.concat(key, F.lit("__bx"), bx.cast("string"), F.lit("_by"), by.cast("string"))
    return origin.withColumn("block", label).drop("_lat0", "_lon0", "_mean")
