import math
import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.operators import spatial as P
from gridspark.scope import AREA, Scope

PT = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def polygon_area(pts):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))) / 2


def clip(pts, x0, y0, x1, y1):
    for a, b, c in ((-1, 0, -x0), (1, 0, x1), (0, -1, -y0), (0, 1, y1)):
        out = []
        for p, q in zip(pts[-1:] + pts[:-1], pts):
            dp, dq = c - a * p[0] - b * p[1], c - a * q[0] - b * q[1]
            if (dp >= 0) != (dq >= 0):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if dq >= 0:
                out.append(q)
        pts = out
        if not pts:
            return pts
    return pts


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0)], "area_id long, minx double, miny double, maxx double, maxy double")


def test_general_polygons_match_brute_force(spark, areas):
    rnd = random.Random(5)
    polys = []
    for i in range(60):
        cx, cy, n = rnd.uniform(0, 1000), rnd.uniform(0, 1000), rnd.randint(3, 7)
        angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        polys.append((1, f"o{i}", "buildings", "polygon", [(cx + rnd.uniform(30, 180) * math.cos(a), cy + rnd.uniform(30, 180) * math.sin(a)) for a in angles]))
    objs = spark.createDataFrame(polys, f"area_id long, obj_id string, layer string, kind string, geom {PT}")
    cells = P.make_grid(areas, 100.0)
    got = {(r.grid_col, r.grid_row): r.object_measure for r in P.measure_in_cells(cells, objs, areas, 100.0).collect()}
    assert len(got) == 100
    for (c, r), value in got.items():
        want = sum(polygon_area(k) for k in (clip([tuple(p) for p in g], c * 100, r * 100, c * 100 + 100, r * 100 + 100) for *_, g in polys) if len(k) > 2)
        assert value == pytest.approx(want, abs=1e-6)


def test_lines_points_and_touching(spark, areas):
    rows = [
        (1, "l", "roads", "line", [(50.0, 50.0), (250.0, 50.0)]),
        (1, "p", "shops", "point", [(100.0, 150.0)]),
    ]
    objs = spark.createDataFrame(rows, f"area_id long, obj_id string, layer string, kind string, geom {PT}").withColumn("tags", F.lit(None).cast("map<string,string>"))
    out = {(r.grid_col, r.grid_row): r for r in P.cell_features(P.make_grid(areas, 100.0), objs, areas, 100.0).collect()}
    assert out[(0, 0)].road_length == 50 and out[(1, 0)].road_length == 100 and out[(2, 0)].road_length == 50
    assert out[(0, 1)].parks_shops_count == 1 and out[(1, 1)].parks_shops_count == 1  # a point on the edge touches both


def test_boundary_clip(spark):
    ring = [(0.0, 0.0), (300.0, 0.0), (0.0, 300.0)]
    a = spark.createDataFrame([(1, 0.0, 0.0, 300.0, 300.0, ring)], f"area_id long, minx double, miny double, maxx double, maxy double, boundary {PT}")
    cells = P.make_grid(a, 100.0).collect()
    assert sum(c.cell_area_m2 for c in cells) == pytest.approx(45000) and [c.cell_id for c in sorted(cells, key=lambda c: c.cell_no)][0] == "Z1"
    box = spark.createDataFrame([(1, "b", "buildings", "polygon", [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0), (0.0, 300.0)])], f"area_id long, obj_id string, layer string, kind string, geom {PT}")
    total = P.measure_in_cells(P.make_grid(a, 100.0), box, a, 100.0).agg(F.sum("object_measure")).first()[0]
    assert total == pytest.approx(45000)


@pytest.mark.parametrize("scope", [AREA, Scope(groups=1)])
def test_district_half_split_and_empty(spark, scope):
    areas = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "area_id long, minx double, miny double, maxx double, maxy double")
    cells = P.make_grid(areas, 2.0).withColumn("surface_value", F.lit(200.0))
    sq = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 2.0), (x0, 2.0)]
    rows = [(1, "west", 90.0, True, sq(0.0, 1.0)), (1, "east", 110.0, True, sq(1.0, 2.0)), (1, "far", 5.0, False, sq(50.0, 51.0))]
    d = spark.createDataFrame(rows, f"area_id long, district_name string, official_population double, use_in_metrics boolean, geom {PT}")
    out = {r.district_name: r for r in P.areal_interpolate(cells, d, areas, size_m=2.0, scope=scope).collect()}
    assert out["west"].predicted_population == pytest.approx(100) and out["east"].predicted_population == pytest.approx(100)
    assert out["far"].predicted_population == 0 and out["far"].official_share == pytest.approx(5 / 205)


def test_knn_against_brute_force_with_hot_spot(spark, areas):
    rnd = random.Random(9)
    pts = [(rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for _ in range(120)]
    pts += [(333.0, 333.0)] * 200 + [(rnd.uniform(600, 610), rnd.uniform(600, 610)) for _ in range(200)]
    pois = spark.createDataFrame([(1, x, y) for x, y in pts], "area_id long, x double, y double")
    cells = P.centroids(P.make_grid(areas, 100.0))
    for kwargs in ({"base_m": 20.0, "levels": 3}, {"base_m": 125.0, "levels": 1}):
        for r in P.knn_access(cells, pois, 5, 1.0, **kwargs).collect():
            d = sorted(math.hypot(x - r.cx, y - r.cy) for x, y in pts)[:5]
            assert r.poi_access_index == pytest.approx(1 / (sum(d) / 5 + 1), rel=1e-9)
    few = P.knn_access(cells, pois.limit(2), 5).collect()
    assert all(r.poi_access_index > 0 for r in few)
    none = P.knn_access(cells, pois.where("area_id = 9"), 5).collect()
    assert all(r.poi_access_index == 0 for r in none)


def test_interior_point_of_concave_ring(spark):
    u = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (8.0, 10.0), (8.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(u,)], f"g {PT}")
    p = df.select(G.ring_point(F.col("g")).alias("p")).first().p
    inside = df.select(G.point_in_ring(F.lit(p.x), F.lit(p.y), F.col("g"))).first()[0]
    assert inside


def test_projection_scale(spark):
    df = spark.createDataFrame([(76.9, 43.25)], "lon double, lat double")
    z = G.utm_zone(F.col("lon"))
    p = df.select(G.lonlat_to_metric(F.col("lon"), F.col("lat"), z, F.lit(False)).alias("p"), z.alias("z")).first()
    assert p.z == 43 and 650_000 < p.p.x < 660_000 and 4_785_000 < p.p.y < 4_795_000
    q = df.select(G.lonlat_to_metric(F.col("lon"), F.col("lat") + 0.01, z, F.lit(False)).alias("p")).first().p
    assert math.hypot(q.x - p.p.x, q.y - p.p.y) == pytest.approx(1111, abs=2)


def test_components_of_8x8_surface(spark):
    rows = []
    for c in range(8):
        for r in range(8):
            v = 5.0
            if c < 2 and r < 2:
                v = 100.0
            elif c > 5 and r > 5:
                v = 90.0
            elif c < 2 and r > 5:
                v = 0.0
            elif c > 5 and r < 2:
                v = 1.0
            rows.append((1, f"Z{c * 8 + r + 1}", c * 8 + r + 1, c, r, c * 1.0, r * 1.0, c + 1.0, r + 1.0, 1.0, v))
    df = spark.createDataFrame(rows, "area_id long, cell_id string, cell_no long, grid_col long, grid_row long, x0 double, y0 double, x1 double, y1 double, cell_area_m2 double, surface_value double")
    hot, members = P.component_summary(df, "hotspot")
    out = {r.source_component_id: r for r in hot.collect()}
    assert out["hotspot_01"].total_value == 400 and out["hotspot_01"].direction_label == "south-west"
    assert out["hotspot_02"].direction_label == "north-east"
    assert {r.cell_id for r in members.where("source_component_id = 'hotspot_01'").collect()} == {"Z1", "Z2", "Z9", "Z10"}
    cold, _ = P.component_summary(df, "coldspot")
    assert cold.orderBy("rank_within_zone_type").first().mean_value == 0


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


L_SHAPE = [ring((0, 0), (2000, 0), (2000, 500), (500, 500), (500, 2000), (0, 2000))]
TWO_PARTS = [ring((0, 0), (700, 0), (700, 700), (0, 700)), ring((1300, 1300), (1300, 2000), (2000, 2000), (2000, 1300))]
HOLED = [ring((0, 0), (2000, 0), (2000, 2000), (0, 2000)), ring((450, 450), (1550, 450), (1550, 1550), (450, 1550))]
ISLAND = [*HOLED, ring((800, 800), (1200, 800), (1200, 1200), (800, 1200))]
SLANTED = [ring((0, 0), (2000, 300), (1100, 900), (1900, 2000), (700, 1200), (100, 1900))]


def area_of(rings):
    shoelace = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2
    return sum((1, -1, 1)[i] * shoelace(r) if len(rings) == 3 or rings is HOLED else shoelace(r) for i, r in enumerate(rings))


SHAPES = {1: L_SHAPE, 2: TWO_PARTS, 3: HOLED, 4: ISLAND, 5: SLANTED}


def inside(rings, x, y):
    hit = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
    return hit


def test_any_boundary(spark):
    """Cells and objects under any boundary: areas and lengths against closed forms, points against the even-odd rule."""
    a = spark.createDataFrame(
        [(k, 0.0, 0.0, 2000.0, 2000.0, rings) for k, rings in SHAPES.items()],
        "area_id long, minx double, miny double, maxx double, maxy double, boundary array<array<struct<x:double,y:double>>>",
    )
    cells = P.make_grid(a, 300.0)
    got = {r.area_id: r.s for r in cells.groupBy("area_id").agg(F.sum("cell_area_m2").alias("s")).collect()}
    assert got == pytest.approx({k: area_of(rings) for k, rings in SHAPES.items()})
    schema = "area_id long, obj_id long, layer string, kind string, geom array<struct<x:double,y:double>>, tags map<string,string>"
    square, line = ring((0, 0), (2000, 0), (2000, 2000), (0, 2000)), ring((10, 1990), (1990, 15))
    spots = [(37.0 + 91 * i % 2000, 53.0 + 137 * j % 2000) for i in range(20) for j in range(15)]
    rows = [(k, 0, "square", "polygon", square, {}) for k in SHAPES] + [(k, 1, "line", "line", line, {}) for k in SHAPES]
    rows += [(k, 2 + n, "spot", "point", [p], {}) for k in SHAPES for n, p in enumerate(spots)]
    bins = P.bin_objects(spark.createDataFrame(rows, schema), a, 300.0).groupBy("area_id", "grid_col", "grid_row", "layer").agg(F.count("*").alias("n"), F.sum("measure").alias("m")).persist()
    squares = cells.join(bins.where("layer = 'square'"), ["area_id", "grid_col", "grid_row"], "left").na.fill(0.0, ["m"]).collect()
    assert [r.m for r in squares] == pytest.approx([r.cell_area_m2 for r in squares], abs=1e-6)
    sums = {(r.area_id, r.layer): (r.n, r.m) for r in bins.groupBy("area_id", "layer").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}
    n, length = 20_000, (1980**2 + 1975**2) ** 0.5
    for k, rings in SHAPES.items():
        assert sums[k, "spot"][0] == sum(inside(rings, x, y) for x, y in spots)
        # inside, a line of many short steps has about the share of its steps whose middles are inside
        assert sums.get((k, "line"), (0, 0.0))[1] == pytest.approx(length * sum(inside(rings, 10 + 1980 * (t + 0.5) / n, 1990 - 1975 * (t + 0.5) / n) for t in range(n)) / n, abs=1.0)


def test_building_in_the_arm_of_an_l(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 2000.0, 2000.0, L_SHAPE[0])], "area_id long, minx double, miny double, maxx double, maxy double, boundary array<struct<x:double,y:double>>")
    schema = "area_id long, obj_id long, layer string, kind string, geom array<struct<x:double,y:double>>, tags map<string,string>"
    house = spark.createDataFrame([(1, 0, "buildings", "polygon", ring((1600, 200), (1700, 200), (1700, 300), (1600, 300)), {})], schema)
    cells = P.make_grid(a, 500.0)
    assert P.measure_in_cells(cells, house, a, 500.0).agg(F.sum("object_measure")).first()[0] == pytest.approx(10_000.0)
    assert P.count_in_cells(cells, house, a, 500.0).agg(F.sum("object_count")).first()[0] == 1


def test_long_objects_cost_the_cells_they_cross(spark):
    """A diagonal over 400 x 400 cells, a zigzag, a thin slanted ring, a ring with an arm and a point, against every cell of the grid."""
    wide = spark.createDataFrame([(1, 0.0, 0.0, 40_000.0, 40_000.0)], "area_id long, minx double, miny double, maxx double, maxy double")
    shape = f"area_id long, obj_id string, layer string, kind string, geom {PT}"
    diagonal = (1, "d", "roads", "line", [(0.0, 0.0), (40_000.0, 39_950.0)])
    b = {f"_b{k}": v for k, v in G.bounds(F.col("geom")).items()}
    row = spark.createDataFrame([diagonal], shape).withColumns(b).selectExpr("*", "0d as _minx", "0d as _miny", "400L as _n_cols", "400L as _n_rows", "false as _rect")
    assert 799 <= P.reached_cells(row, 100.0).count() < 1600
    bins = P.bin_objects(spark.createDataFrame([diagonal], shape), wide, 100.0)
    assert bins.count() <= 801 and bins.agg(F.sum("measure")).first()[0] == pytest.approx(math.hypot(40_000, 39_950))

    area = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0)], "area_id long, minx double, miny double, maxx double, maxy double")
    rows = [
        (1, "z", "roads", "line", [(10.0, 10.0), (990.0, 480.0), (15.0, 500.0), (15.0, 900.0), (700.0, 100.0)]),
        (1, "on", "roads", "line", [(100.0, 100.0), (300.0, 300.0), (300.0, 600.0)]),
        (1, "thin", "buildings", "polygon", [(5.0, 5.0), (980.0, 950.0), (960.0, 970.0)]),
        (1, "arm", "buildings", "polygon", [(110.0, 110.0), (890.0, 110.0), (890.0, 190.0), (250.0, 190.0), (250.0, 870.0), (110.0, 870.0)]),
    ]
    objs = spark.createDataFrame(rows, shape)
    got = {(r.obj_id, r.grid_col, r.grid_row): r.measure for r in P.bin_objects(objs, area, 100.0).collect()}
    cell = lambda c, r: (c * 100.0, r * 100.0, c * 100.0 + 100.0, r * 100.0 + 100.0)
    want = {}
    for _, name, _, kind, pts in rows:
        edges = list(zip(pts, pts[1:] + (pts[:1] if kind == "polygon" else []), strict=False))
        for c in range(10):
            for r in range(10):
                x0, y0, x1, y1 = cell(c, r)
                inside = 0.0
                touch = False
                for (ax, ay), (bx, by) in edges:
                    lo, hi = 0.0, 1.0
                    for d, start in ((ax - bx, ax - x0), (bx - ax, x1 - ax), (ay - by, ay - y0), (by - ay, y1 - ay)):
                        if d == 0:
                            lo = 2.0 if start < 0 else lo
                        elif d > 0:
                            hi = min(hi, start / d)
                        else:
                            lo = max(lo, start / d)
                    touch |= lo <= hi
                    inside += max(0.0, hi - lo) * math.hypot(bx - ax, by - ay)
                if kind == "polygon":
                    part = clip(list(pts), x0, y0, x1, y1)
                    inside = polygon_area(part) if len(part) > 2 else 0.0
                if touch or inside > 0:
                    want[(name, c, r)] = inside
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_plain_objects_measure_as_cut_ones_and_the_plan_measures_once(spark):
    """A box, flat line and point give the bins of the same shapes with a vertex more, with and without a boundary; built cells read no object again."""
    shape = "area_id long, obj_id string, layer string, kind string, geom array<struct<x:double,y:double>>, tags map<string,string>"
    box, line = [(90.0, 110.0), (320.0, 110.0), (320.0, 260.0), (90.0, 260.0)], [(40.0, 150.0), (410.0, 150.0)]
    rows = [(1, "box", "buildings", "polygon", box, {"building": "house"}), (1, "line", "roads", "line", line, None), (1, "dot", "shops", "point", [(200.0, 200.0)], None)]
    more = {"box": [*box[:1], (200.0, 110.0), *box[1:]], "line": [line[0], (205.0, 150.0), line[1]], "dot": [(200.0, 200.0)] * 2}
    plain, cut = (spark.createDataFrame(r, shape) for r in (rows, [(a, o, y, k, more[o], t) for a, o, y, k, _, t in rows]))
    open_area = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 500.0)], "area_id long, minx double, miny double, maxx double, maxy double")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (350.0, 0.0), (350.0, 220.0), (0.0, 350.0))])
    found = lambda objects, area: {(r.obj_id, r.grid_col, r.grid_row): round(r.measure, 6) for r in P.bin_objects(objects, area, 100.0).collect()}
    for area in (open_area, open_area.withColumn("boundary", ring)):
        assert found(plain, area) == found(cut, area) != {}
    from gridspark.plans.surface import build_cells

    cells = build_cells(open_area, plain, 100.0, scope=Scope(groups=1))
    assert "Generate" not in cells._jdf.queryExecution().optimizedPlan().toString()
    assert cells.agg(F.sum("building_area")).first()[0] == 230.0 * 150.0
