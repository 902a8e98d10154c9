"""Planar geometry as native column expressions.

A ring is ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>`` without a repeated last vertex; a path is the same
without closure. Clip regions are arrays of half planes ``STRUCT<a, b, c>`` meaning
``a*x + b*y <= c``; a box is four of them. A region of any shape (parts, holes) is one merged
counter-clockwise ring, measured by the signed trapezoids under its edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))


def half_plane(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))


def box_planes(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(
        half_plane(-one, zero, -x0), half_plane(one, zero, x1), half_plane(zero, -one, -y0), half_plane(zero, one, y1)
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _next(ring: Column, i: Column) -> Column:
    """Vertex after position i (0-based), wrapping round."""
    return F.element_at(ring, F.when(i + 1 < F.size(ring), i + 2).otherwise(F.lit(1)).cast("int"))


def _prev(ring: Column, i: Column) -> Column:
    return F.element_at(ring, F.when(i > 0, i).otherwise(F.size(ring)).cast("int"))


def signed_area(ring: Column) -> Column:
    return let(ring, _signed_area)


def _signed_area(ring: Column) -> Column:
    cross = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2.0


def ring_area(ring: Column) -> Column:
    return let(ring, lambda r: F.when(F.size(r) >= 3, F.abs(_signed_area(r))).otherwise(F.lit(0.0)))


def oriented_rings(rings: Column) -> Column:
    """Rings of one area by the even-odd rule: those inside an even number of others run counter-clockwise, holes clockwise."""

    def turned(r, i):
        others = F.filter(rings, lambda o, j: j != i)
        depth = F.size(F.filter(others, lambda o: point_in_ring(r[0]["x"], r[0]["y"], o)))
        return F.when((_signed_area(r) >= 0) == (depth % 2 == 0), r).otherwise(F.reverse(r))

    return F.transform(F.filter(rings, lambda r: F.size(r) >= 3), turned)


def merged_ring(rings: Column) -> Column:
    """Oriented rings as one: each is reached from the first one's first vertex and left the same way, so that the ways
    there and back cancel out in areas and centroids, also after cutting."""
    whole = lambda rs: F.flatten(F.transform(rs, lambda r: F.concat(r, F.array(r[0], rs[0][0]))))
    return let(rings, lambda rs: F.when(F.size(rs) > 1, whole(rs)).otherwise(F.coalesce(F.try_element_at(rs, F.lit(1)), F.slice(F.flatten(rs), 1, 0))))


def ring_segments(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda r: _segments(r, True)))


def segments_in(segments: Column, planes: Column) -> Column:
    """The parts of segments inside the half planes; a segment that only touches them is a point."""

    def cut(s):
        at = lambda t: (s["x0"] + t * (s["x1"] - s["x0"]), s["y0"] + t * (s["y1"] - s["y0"]))
        share = segment_share(s["x0"], s["y0"], s["x1"], s["y1"], planes)

        def part(v):
            (xa, ya), (xb, yb) = at(v["lo"]), at(v["hi"])
            return F.when(v["lo"] <= v["hi"], F.struct(xa.alias("x0"), ya.alias("y0"), xb.alias("x1"), yb.alias("y1")))

        return let(share, part)

    return F.array_compact(F.transform(segments, cut))


def _trapezoids(region: Column, base: Column) -> Column:
    """Signed convex parts that make up a counter-clockwise region above ``base``: what lies under each edge."""

    def under(p, i):
        def made(q):
            xa, xb = F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])
            dx, dy = F.abs(p["x"] - q["x"]), F.when(p["x"] < q["x"], q["y"] - p["y"]).otherwise(p["y"] - q["y"])
            ya = F.when(p["x"] < q["x"], p["y"]).otherwise(q["y"])
            zero, one = F.lit(0.0), F.lit(1.0)
            planes = F.array(half_plane(-one, zero, -xa), half_plane(one, zero, xb), half_plane(zero, -one, -base), half_plane(-dy, dx, ya * dx - dy * xa))
            return F.when(dx > 0, F.struct(F.signum(p["x"] - q["x"]).alias("s"), planes.alias("h")))

        return let(_next(region, i), made)

    return F.array_compact(F.transform(region, under))


def overlap_area(ring: Column, region: Column, base: Column) -> Column:
    """Area of a simple ring inside a region of any shape that lies above ``base`` (counter-clockwise, see ``merged_ring``)."""
    parts = F.transform(_trapezoids(region, base), lambda t: t["s"] * ring_area(clip_ring(ring, t["h"])))
    return F.greatest(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))


def on_segment(x: Column, y: Column, segments: Column) -> Column:
    def hit(s):
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        off = F.abs((x - s["x0"]) * dy - (y - s["y0"]) * dx)
        along = (x - s["x0"]) * dx + (y - s["y0"]) * dy
        square = dx * dx + dy * dy
        close = F.when(square > 0, (off <= EPS * F.sqrt(square)) & (along >= -EPS) & (along <= square + EPS))
        return F.coalesce(close, F.hypot(x - s["x0"], y - s["y0"]) <= EPS)

    return F.exists(segments, hit)


def length_in_region(path: Column, planes: Column, region: Column, edges: Column) -> Column:
    """Length of a path inside half planes and a region of any shape: each segment is cut where it meets an edge, and a
    piece counts if its middle lies in the region or on an edge."""

    def one(s):
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]

        def meets(e):
            ex, ey = e["x1"] - e["x0"], e["y1"] - e["y0"]
            crossing = F.try_divide((e["x0"] - s["x0"]) * ey - (e["y0"] - s["y0"]) * ex, dx * ey - dy * ex)
            beside = lambda x, y: F.try_divide((e[x] - s["x0"]) * dx + (e[y] - s["y0"]) * dy, dx * dx + dy * dy)
            return F.array(crossing, beside("x0", "y0"), beside("x1", "y1"))  # ends, too: an edge may run along the segment

        def total(v):
            cuts = F.filter(F.flatten(F.transform(edges, meets)), lambda t: (t > v["lo"]) & (t < v["hi"]))
            return let(F.array_sort(F.array_distinct(F.concat(F.array(v["lo"], v["hi"]), cuts))), pieces)

        def pieces(ts):
            def piece(t, i):
                to = F.element_at(ts, (i + 2).cast("int"))
                mid = (t + to) / 2.0
                x, y = s["x0"] + mid * dx, s["y0"] + mid * dy
                return F.when(point_in_ring(x, y, region) | on_segment(x, y, edges), to - t).otherwise(F.lit(0.0))

            return F.aggregate(F.transform(F.slice(ts, 1, F.size(ts) - 1), piece), F.lit(0.0), lambda acc, v: acc + v) * F.hypot(dx, dy)

        share = segment_share(s["x0"], s["y0"], s["x1"], s["y1"], planes)
        return let(share, lambda v: F.when(v["lo"] < v["hi"], total(v)).otherwise(F.lit(0.0)))

    return F.aggregate(F.transform(_segments(path, False), one), F.lit(0.0), lambda acc, v: acc + v)


def meets_segments(path: Column, segments: Column, closed: bool) -> Column:
    """Does any edge of a path meet any of the segments?"""
    side = lambda ax, ay, bx, by, px, py: F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    def cross(s, e):
        a = (s["x0"], s["y0"], s["x1"], s["y1"])
        b = (e["x0"], e["y0"], e["x1"], e["y1"])
        boxes = (
            (F.greatest(a[0], a[2]) >= F.least(b[0], b[2])) & (F.greatest(b[0], b[2]) >= F.least(a[0], a[2]))
            & (F.greatest(a[1], a[3]) >= F.least(b[1], b[3])) & (F.greatest(b[1], b[3]) >= F.least(a[1], a[3]))
        )
        return boxes & (side(*a, b[0], b[1]) * side(*a, b[2], b[3]) <= 0) & (side(*b, a[0], a[1]) * side(*b, a[2], a[3]) <= 0)

    return F.exists(_segments(path, closed), lambda s: F.exists(segments, lambda e: cross(s, e)))


def clip_ring(ring: Column, planes: Column) -> Column:
    """Ring cut by each half plane in turn. Area is exact for any simple ring."""

    def room(p, h):
        return h["c"] - h["a"] * p["x"] - h["b"] * p["y"]

    def corner(p, q, dp, dq):
        inside_p, inside_q = dp >= 0, dq >= 0
        t = F.try_divide(dq, dq - dp)
        cross = pt(q["x"] + t * (p["x"] - q["x"]), q["y"] + t * (p["y"] - q["y"]))
        return (
            F.when(inside_p & inside_q, F.array(p))
            .when(inside_p, F.array(cross, p))
            .when(inside_q, F.array(cross))
            .otherwise(F.slice(F.array(p), 1, 0))
        )

    def cut(r, h):
        def at(p, i):
            return let(_prev(r, i), lambda q: let(F.array(room(p, h), room(q, h)), lambda d: corner(p, q, d[0], d[1])))

        # a ring wholly inside the half plane passes through unchanged
        return F.when(F.forall(r, lambda p: room(p, h) >= 0), r).otherwise(F.flatten(F.transform(r, at)))

    return F.aggregate(planes, ring, cut)


def segment_share(x0: Column, y0: Column, x1: Column, y1: Column, planes: Column) -> Column:
    """Parameter interval (lo, hi) of a segment inside the half planes; empty when lo > hi."""

    def narrow(acc, h):
        start = h["c"] - h["a"] * x0 - h["b"] * y0
        slope = h["a"] * (x1 - x0) + h["b"] * (y1 - y0)
        t = F.try_divide(start, slope)
        lo = F.when(slope < 0, F.greatest(acc["lo"], t)).when((slope == 0) & (start < 0), F.lit(2.0)).otherwise(acc["lo"])
        hi = F.when(slope > 0, F.least(acc["hi"], t)).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    whole = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(planes, whole, narrow)


def path_length(path: Column) -> Column:
    steps = F.transform(
        F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))),
        lambda q, i: F.hypot(q["x"] - F.element_at(path, (i + 1).cast("int"))["x"], q["y"] - F.element_at(path, (i + 1).cast("int"))["y"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)


def _segments(path: Column, closed: bool) -> Column:
    def seg(p, i):
        q = _next(path, i)
        return F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))

    all_segs = F.transform(path, seg)
    return all_segs if closed else F.slice(all_segs, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def path_segments(path: Column) -> Column:
    return _segments(path, False)


def ring_edges(ring: Column) -> Column:
    return _segments(ring, True)


def strip_range(segments: Column, x0: Column, x1: Column) -> Column:
    """Lowest and highest ``y`` (struct ``lo, hi``; null without any) of segments between two vertical lines, borders included."""

    def within(s):
        at = lambda x, y: y + (F.least(F.greatest(x, x0), x1) - x) * F.coalesce(F.try_divide(s["y1"] - s["y0"], s["x1"] - s["x0"]), F.lit(0.0))
        meets = (F.greatest(s["x0"], s["x1"]) >= x0) & (F.least(s["x0"], s["x1"]) <= x1)
        a, b = at(s["x0"], s["y0"]), at(s["x1"], s["y1"])
        return F.when(meets, F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))

    none = F.lit(None).cast("struct<lo:double,hi:double>")
    wider = lambda acc, v: F.when(v.isNull(), acc).otherwise(F.struct(F.least(acc["lo"], v["lo"]).alias("lo"), F.greatest(acc["hi"], v["hi"]).alias("hi")))
    return F.aggregate(F.transform(segments, within), none, wider)


def clipped_length(path: Column, planes: Column) -> Column:
    def inside(s):
        share = segment_share(s["x0"], s["y0"], s["x1"], s["y1"], planes)
        length = F.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"])
        return let(share, lambda v: F.greatest(v["hi"] - v["lo"], F.lit(0.0)) * length)

    return F.aggregate(F.transform(_segments(path, False), inside), F.lit(0.0), lambda acc, v: acc + v)


def path_touches(path: Column, planes: Column, closed: bool = False) -> Column:
    """Does any edge meet the closed clip region?"""

    def hit(s):
        return let(segment_share(s["x0"], s["y0"], s["x1"], s["y1"], planes), lambda v: v["lo"] <= v["hi"])

    return F.exists(_segments(path, closed), hit)


def ring_touches(ring: Column, planes: Column, clipped_area: Column) -> Column:
    """Closed-set intersection test: an edge meets the region, or the region lies inside the ring."""
    return path_touches(ring, planes, closed=True) | (clipped_area > 0)


def ring_centroid(ring: Column) -> Column:
    """Area centroid; falls back to the vertex mean for degenerate rings."""
    return let(ring, lambda r: let(_signed_area(r), lambda a: _centroid(r, a)))


def _centroid(ring: Column, a: Column) -> Column:
    def moment(axis):
        parts = F.transform(
            ring,
            lambda p, i: (p[axis] + _next(ring, i)[axis]) * (p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"]),
        )
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    def mean(axis):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(ring)

    ok = F.abs(a) > EPS
    return pt(
        F.when(ok, F.try_divide(moment("x"), 6.0 * a)).otherwise(mean("x")),
        F.when(ok, F.try_divide(moment("y"), 6.0 * a)).otherwise(mean("y")),
    )


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""

    def crosses(p, i):
        q = _next(ring, i)
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda acc, v: acc + v) % 2 == 1


def ring_point(ring: Column) -> Column:
    """A point inside the ring: the centroid when inside, else the middle of the widest chord at mid height."""
    return let(ring, lambda r: let(ring_centroid(r), lambda c: _inner_point(r, c)))


def _inner_point(ring: Column, c: Column) -> Column:
    ys = F.transform(ring, lambda p: p["y"])
    mid = (F.array_min(ys) + F.array_max(ys)) / 2.0

    def chord_x(p, i):
        q = _next(ring, i)
        spans = (p["y"] > mid) != (q["y"] > mid)
        return F.when(spans, (q["x"] - p["x"]) * F.try_divide(mid - p["y"], q["y"] - p["y"]) + p["x"])

    xs = F.array_sort(F.array_compact(F.transform(ring, chord_x)))
    pairs = F.transform(
        F.filter(xs, lambda v, i: i % 2 == 0),
        lambda v, i: F.struct(
            (F.element_at(xs, (i * 2 + 2).cast("int")) - v).alias("w"), ((F.element_at(xs, (i * 2 + 2).cast("int")) + v) / 2.0).alias("x")
        ),
    )
    inner = pt(F.array_max(pairs)["x"], mid)
    return F.when(point_in_ring(c["x"], c["y"], ring) | (F.size(xs) < 2), c).otherwise(inner)


def bounds(points: Column) -> dict[str, Column]:
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def corner_bounds(points: Column) -> dict[str, Column]:
    """Bounds of at most four points, without a lambda: what has one is not compiled."""
    each = lambda a: [F.get(points, F.lit(i))[a] for i in range(4)]
    return {"minx": F.least(*each("x")), "miny": F.least(*each("y")), "maxx": F.greatest(*each("x")), "maxy": F.greatest(*each("y"))}


def is_box(ring: Column) -> Column:
    """Four vertices with sides along the axes."""
    x, y = [[F.get(ring, F.lit(i))[a] for i in range(4)] for a in ("x", "y")]
    level = (y[0] == y[1]) & (x[1] == x[2]) & (y[2] == y[3]) & (x[3] == x[0])
    upright = (x[0] == x[1]) & (y[1] == y[2]) & (x[2] == x[3]) & (y[3] == y[0])
    return F.coalesce((F.size(ring) == 4) & (level | upright), F.lit(False))


# WGS84 ellipsoid and the transverse Mercator grid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 10000000.0

_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def lonlat_to_metric(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """Transverse Mercator by the third-order Krüger series."""
    lam = F.radians(lon - (zone * 6.0 - 183.0))
    phi = F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    x = UTM_FALSE_EASTING + UTM_K0 * _RECT * east
    y = F.when(south, F.lit(UTM_FALSE_NORTHING)).otherwise(F.lit(0.0)) + UTM_K0 * _RECT * north
    return pt(x, y)


def metric_to_lonlat(x: Column, y: Column, zone: Column, south: Column) -> Column:
    xi = (y - F.when(south, F.lit(UTM_FALSE_NORTHING)).otherwise(F.lit(0.0))) / (UTM_K0 * _RECT)
    eta = (x - UTM_FALSE_EASTING) / (UTM_K0 * _RECT)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return pt(F.degrees(lam) + (zone * 6.0 - 183.0), F.degrees(phi))
