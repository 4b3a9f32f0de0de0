"""Plane geometry as Column expressions.

A shape is ``array<array<struct<x: double, y: double>>>`` ("rings"): the lines of a
(multi)line, or the closed rings of a (multi)polygon. Outer rings run
counter-clockwise and holes clockwise, so signed ring areas add up to the area and
the even-odd rule answers "inside". Axis-aligned boxes need no rings: their four
bounds are plain columns and every box formula below stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (expressions have no variables)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vertex(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def no_vertices() -> Column:
    return F.array().cast("array<struct<x:double,y:double>>")


# ---------------------------------------------------------------- construction
def box_rings(minx, miny, maxx, maxy) -> Column:
    return F.array(F.array(vertex(minx, miny), vertex(maxx, miny), vertex(maxx, maxy),
                           vertex(minx, maxy), vertex(minx, miny)))


def disc_rings(x, y, radius, quarter_segments: int = 16) -> Column:
    """Regular polygon inscribed in a circle, first vertex due east."""
    n = 4 * quarter_segments
    return F.array(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: vertex(
        _c(x) + _c(radius) * F.cos((i % n) * (2 * math.pi / n)),
        _c(y) + _c(radius) * F.sin((i % n) * (2 * math.pi / n)))))


def buffered_box_ring(minx, miny, maxx, maxy, distance, quarter_segments: int = 16) -> Column:
    """Closed convex ring around a box grown by ``distance`` with rounded corners."""
    q = quarter_segments
    d = _c(distance)
    corners = ((maxx, miny, 3), (maxx, maxy, 0), (minx, maxy, 1), (minx, miny, 2))

    def arc(cx, cy, quadrant):
        return F.transform(F.sequence(F.lit(0), F.lit(q)), lambda i: vertex(
            _c(cx) + d * F.cos(math.pi / 2 * (quadrant + i / q)),
            _c(cy) + d * F.sin(math.pi / 2 * (quadrant + i / q))))
    ring = F.concat(*[arc(*c) for c in corners])
    return let(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))


def disc_area(radius, quarter_segments: int = 16) -> Column:
    n = 4 * quarter_segments
    return F.lit(0.5 * n * math.sin(2 * math.pi / n)) * _c(radius) * _c(radius)


def in_disc(px, py, x, y, radius, quarter_segments: int = 16) -> Column:
    """Strictly inside the regular polygon of :func:`disc_rings`."""
    step = math.pi / (2 * quarter_segments)
    dx, dy = _c(px) - _c(x), _c(py) - _c(y)
    angle = F.atan2(dy, dx)
    offset = angle - F.floor(angle / step) * step - step / 2
    return F.hypot(dx, dy) * F.cos(offset) < _c(radius) * math.cos(step / 2)


# --------------------------------------------------------------------- measures
def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of one ring or line, as ``struct<a, b>``."""
    def pairs(r):
        n = F.greatest(F.size(r) - 1, F.lit(0))
        return F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n),
                          lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return let(ring, pairs)


def all_edges(rings) -> Column:
    return F.flatten(F.transform(_c(rings), edges))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def ring_area(ring) -> Column:
    """Signed: counter-clockwise is positive."""
    return _sum(F.transform(edges(_c(ring)), _cross)) / 2


def area(rings) -> Column:
    return _sum(F.transform(_c(rings), ring_area))


def parts(rings) -> Column:
    """Rings grouped by part: a counter-clockwise ring begins one, clockwise rings are its holes."""
    return F.aggregate(
        _c(rings), F.array().cast("array<array<array<struct<x:double,y:double>>>>"),
        lambda acc, r: F.when(ring_area(r) > 0, F.concat(acc, F.array(F.array(r)))).otherwise(
            let(F.size(acc), lambda n: F.when(n == 0, acc).otherwise(F.concat(
                F.slice(acc, F.lit(1), n - 1),
                F.array(F.concat(F.element_at(acc, -1), F.array(r))))))))


def length(rings) -> Column:
    return _sum(F.transform(all_edges(rings), lambda e: F.hypot(
        e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def box_area(minx, miny, maxx, maxy) -> Column:
    return (_c(maxx) - _c(minx)) * (_c(maxy) - _c(miny))


def centroid(rings) -> Column:
    """Area centroid of a polygon, length-weighted middle of a line, or the vertex."""
    def seg(e):
        return F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])

    def sums(es):
        def add(acc, e):
            c, d = _cross(e), seg(e)
            sx, sy = e["a"]["x"] + e["b"]["x"], e["a"]["y"] + e["b"]["y"]
            return F.struct((acc["c"] + c).alias("c"), (acc["cx"] + sx * c).alias("cx"),
                            (acc["cy"] + sy * c).alias("cy"), (acc["d"] + d).alias("d"),
                            (acc["dx"] + d * sx / 2).alias("dx"),
                            (acc["dy"] + d * sy / 2).alias("dy"))
        zero = F.struct(*[F.lit(0.0).alias(n) for n in ("c", "cx", "cy", "d", "dx", "dy")])
        return F.aggregate(es, zero, add)

    first = F.element_at(F.element_at(_c(rings), 1), 1)
    closed = first == F.element_at(F.element_at(_c(rings), 1), -1)
    return let(sums(all_edges(rings)), lambda t: (
        F.when(closed & (F.abs(t["c"]) > 0), vertex(t["cx"] / (3 * t["c"]), t["cy"] / (3 * t["c"])))
        .when(t["d"] > 0, vertex(t["dx"] / t["d"], t["dy"] / t["d"]))
        .otherwise(first)))


def bounds(rings) -> Column:
    vs = F.flatten(_c(rings))
    xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def representative_point(rings) -> Column:
    """A point sure to be inside: the centroid, or else the middle of the widest
    stretch of the polygon on the horizontal line half way up."""
    def halfway(b):
        return (b["miny"] + b["maxy"]) / 2

    def widest(ymid):
        cuts = F.array_sort(F.transform(
            F.filter(all_edges(rings), lambda e: (e["a"]["y"] > ymid) != (e["b"]["y"] > ymid)),
            lambda e: e["a"]["x"] + (ymid - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"])
            * (e["b"]["x"] - e["a"]["x"])))
        spans = let(cuts, lambda c: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(2)),
                     lambda i: i < F.size(c)),
            lambda i: F.struct((F.element_at(c, i + 1) - F.element_at(c, i)).alias("w"),
                               ((F.element_at(c, i) + F.element_at(c, i + 1)) / 2).alias("x"),
                               ymid.alias("y"))))
        return F.array_max(spans)

    return let(centroid(rings), lambda c: F.when(
        contains_point(rings, c["x"], c["y"]), c).otherwise(F.coalesce(
            let(let(bounds(rings), halfway), lambda y: let(
                widest(y), lambda w: F.when(w.isNotNull(), vertex(w["x"], w["y"])))), c)))


# ------------------------------------------------------------------- predicates
def _turn(a: Column, b: Column, p: Column) -> Column:
    return ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _between(e: Column, p: Column) -> Column:
    return ((p["x"] >= F.least(e["a"]["x"], e["b"]["x"]))
            & (p["x"] <= F.greatest(e["a"]["x"], e["b"]["x"]))
            & (p["y"] >= F.least(e["a"]["y"], e["b"]["y"]))
            & (p["y"] <= F.greatest(e["a"]["y"], e["b"]["y"])))


def on_boundary(rings, x, y) -> Column:
    p = vertex(x, y)
    return F.exists(all_edges(rings), lambda e: (_turn(e["a"], e["b"], p) == 0) & _between(e, p))


def _odd(rings, x, y) -> Column:
    px, py = _c(x), _c(y)
    hits = F.filter(all_edges(rings), lambda e: F.when(
        (e["a"]["y"] > py) != (e["b"]["y"] > py),
        px < (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"])
        / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]).otherwise(F.lit(False)))
    return F.size(hits) % 2 == 1


def contains_point(rings, x, y) -> Column:
    """Interior only, as ``contains`` is defined for a polygon and a point."""
    return _odd(rings, x, y) & ~on_boundary(rings, x, y)


def covers_point(rings, x, y) -> Column:
    return _odd(rings, x, y) | on_boundary(rings, x, y)


def _sides(e: Column, f: Column) -> Column:
    return F.struct(_turn(f["a"], f["b"], e["a"]).alias("p"),
                    _turn(f["a"], f["b"], e["b"]).alias("q"),
                    _turn(e["a"], e["b"], f["a"]).alias("r"),
                    _turn(e["a"], e["b"], f["b"]).alias("s"))


def _proper(d: Column) -> Column:
    return (F.signum(d["p"]) * F.signum(d["q"]) < 0) & (F.signum(d["r"]) * F.signum(d["s"]) < 0)


def edges_meet(e: Column, f: Column) -> Column:
    """Two segments share at least one point."""
    return let(_sides(e, f), lambda d: (
        _proper(d) | ((d["p"] == 0) & _between(f, e["a"])) | ((d["q"] == 0) & _between(f, e["b"]))
        | ((d["r"] == 0) & _between(e, f["a"])) | ((d["s"] == 0) & _between(e, f["b"]))))


def edges_cross(e: Column, f: Column) -> Column:
    """Two segments cross in their interiors."""
    return let(_sides(e, f), _proper)


def _first(rings: Column) -> Column:
    return F.element_at(F.element_at(rings, 1), 1)


def intersects(a, b) -> Column:
    """Polygons or lines share a point (edges meet, or one holds the other)."""
    a, b = _c(a), _c(b)
    meet = let(all_edges(b), lambda eb: F.exists(
        all_edges(a), lambda e: F.exists(eb, lambda f: edges_meet(e, f))))
    return (meet | _odd(b, _first(a)["x"], _first(a)["y"])
            | _odd(a, _first(b)["x"], _first(b)["y"]))


def contains(a, b) -> Column:
    """Polygon ``a`` holds ``b``: all vertices covered, no proper edge crossing."""
    a, b = _c(a), _c(b)
    inside = F.forall(F.flatten(b), lambda v: covers_point(a, v["x"], v["y"]))
    crossing = let(all_edges(a), lambda ea: F.exists(
        all_edges(b), lambda e: F.exists(ea, lambda f: edges_cross(e, f))))
    return inside & ~crossing


def is_simple(rings) -> Column:
    """No two edges of the line or ring touch except where they follow on."""
    def clash(es, closed):
        n = F.size(es)
        return F.exists(
            F.transform(es, lambda e, i: F.exists(
                F.transform(F.slice(es, i + 2, F.greatest(n - i - 1, F.lit(0))),
                            lambda f, j: F.struct(f.alias("f"), (j + i + 1).alias("j"))),
                lambda g: F.when((g["j"] == i + 1) | (closed & (i == 0) & (g["j"] == n - 1)),
                                 edges_cross(e, g["f"])).otherwise(edges_meet(e, g["f"])))),
            lambda hit: hit)

    return F.forall(_c(rings), lambda r: ~let(edges(r), lambda es: clash(
        es, F.element_at(r, 1) == F.element_at(r, -1))))


def is_closed(ring) -> Column:
    r = _c(ring)
    return (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))


def is_valid_polygon(rings) -> Column:
    return F.forall(_c(rings), is_closed) & is_simple(rings) & (F.abs(area(rings)) > 0)


# -------------------------------------------------------------------- distances
def point_distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def box_distance(px, py, minx, miny, maxx, maxy) -> Column:
    """From a point to a filled box (zero inside)."""
    dx = F.greatest(_c(minx) - _c(px), F.lit(0.0), _c(px) - _c(maxx))
    dy = F.greatest(_c(miny) - _c(py), F.lit(0.0), _c(py) - _c(maxy))
    return F.hypot(dx, dy)


def box_box_distance(a, b) -> Column:
    """``a`` and ``b`` are (minx, miny, maxx, maxy) tuples."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.hypot(dx, dy)


def _edge_distance(e: Column, px: Column, py: Column) -> Column:
    ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    l2 = ex * ex + ey * ey
    along = F.when(l2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), ((px - e["a"]["x"]) * ex + (py - e["a"]["y"]) * ey) / l2)))
    return let(along, lambda t: F.hypot(px - e["a"]["x"] - t * ex, py - e["a"]["y"] - t * ey))


def line_distance(rings, x, y) -> Column:
    px, py = _c(x), _c(y)
    return F.array_min(F.transform(all_edges(rings), lambda e: _edge_distance(e, px, py)))


def shape_distance(a, b) -> Column:
    """Between two lines or polygons (zero when they meet)."""
    a, b = _c(a), _c(b)

    def one_way(vs, other):
        return let(all_edges(other), lambda es: F.array_min(F.transform(
            F.flatten(vs), lambda v: F.array_min(F.transform(
                es, lambda e: _edge_distance(e, v["x"], v["y"]))))))
    return F.when(intersects(a, b), F.lit(0.0)).otherwise(
        F.least(one_way(a, b), one_way(b, a)))


# ---------------------------------------------------------------------- overlay
def box_overlap(a, b) -> Column:
    """Shared area of two boxes given as (minx, miny, maxx, maxy) tuples."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _clip_half(poly: Column, e: Column) -> Column:
    """Open vertex list cut to the left side of directed edge ``e``."""
    def cut(d):
        k = d["s"] / (d["s"] - d["t"])
        return vertex(d["p"]["x"] + k * (d["q"]["x"] - d["p"]["x"]),
                      d["p"]["y"] + k * (d["q"]["y"] - d["p"]["y"]))

    def choose(d):
        return (F.when((d["s"] >= 0) & (d["t"] >= 0), F.array(d["q"]))
                .when((d["s"] < 0) & (d["t"] >= 0), F.array(cut(d), d["q"]))
                .when((d["s"] >= 0) & (d["t"] < 0), F.array(cut(d)))
                .otherwise(no_vertices()))

    def piece(cur, i):
        prev = F.element_at(poly, F.when(i == 0, F.lit(-1)).otherwise(i))
        sides = let(prev, lambda p: F.struct(
            p.alias("p"), cur.alias("q"), _turn(e["a"], e["b"], p).alias("s"),
            _turn(e["a"], e["b"], cur).alias("t")))
        return let(sides, choose)
    return F.flatten(F.transform(poly, piece))


def clip_area(ring, convex_ring) -> Column:
    """Signed area of any ring inside a convex counter-clockwise ring."""
    r = _c(ring)
    start = F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))
    left = F.aggregate(edges(_c(convex_ring)), start, _clip_half)
    return let(left, lambda v: ring_area(F.concat(v, F.slice(v, 1, 1))))


def clip_area_rings(rings, convex_ring) -> Column:
    return _sum(F.transform(_c(rings), lambda r: clip_area(r, convex_ring)))


def ring_area_in_box(ring, box) -> Column:
    """Signed area of any ring inside an axis-aligned box, as a sum over its edges.

    Under each edge the height, held to the box, is integrated along the part of the edge
    that lies between the box sides; no vertex lists are built.
    """
    x0, y0, x1, y1 = [_c(v) for v in box]
    h = y1 - y0

    def ramp(y):
        return (F.pow(F.greatest(y, F.lit(0.0)), F.lit(2.0))
                - F.pow(F.greatest(y - h, F.lit(0.0)), F.lit(2.0))) / 2

    def under(e):
        ax, ay = e["a"]["x"], e["a"]["y"] - y0
        slope = (e["b"]["y"] - e["a"]["y"]) / (e["b"]["x"] - ax)
        ends = F.struct(F.least(F.greatest(ax, x0), x1).alias("p"),
                        F.least(F.greatest(e["b"]["x"], x0), x1).alias("q"),
                        slope.alias("m"), ax.alias("ax"), ay.alias("ay"))

        def area_of(c):
            ys = F.struct((c["ay"] + (c["p"] - c["ax"]) * c["m"]).alias("u"),
                          (c["ay"] + (c["q"] - c["ax"]) * c["m"]).alias("v"))
            return let(ys, lambda y: (c["q"] - c["p"]) * F.when(
                y["u"] == y["v"], F.least(F.greatest(y["u"], F.lit(0.0)), h)).otherwise(
                (ramp(y["v"]) - ramp(y["u"])) / (y["v"] - y["u"])))
        # Most edges pass the box by and cost two comparisons.
        aside = ((F.least(ax, e["b"]["x"]) >= x1) | (F.greatest(ax, e["b"]["x"]) <= x0)
                 | (e["b"]["x"] == ax))
        return F.when(aside, F.lit(0.0)).otherwise(let(ends, area_of))
    return -_sum(F.transform(edges(_c(ring)), under))


def area_in_box(rings, box) -> Column:
    return _sum(F.transform(_c(rings), lambda r: ring_area_in_box(r, box)))


def disc_area_in_box(x, y, radius, box, quarter_segments: int = 16) -> Column:
    """Area of the polygonal disc inside a box. Boxes wholly inside or outside, most of
    them, are settled without looking at the ring."""
    x, y, r = _c(x), _c(y), _c(radius)
    b = [_c(v) for v in box]
    inner = r * math.cos(math.pi / (4 * quarter_segments))
    far = F.hypot(F.greatest(x - b[0], b[2] - x), F.greatest(y - b[1], b[3] - y))
    ring = F.element_at(disc_rings(x, y, r, quarter_segments), 1)
    return (F.when(box_distance(x, y, *b) >= r, F.lit(0.0))
            .when(far <= inner, box_area(*b))
            .otherwise(F.greatest(F.lit(0.0), ring_area_in_box(ring, b))))


def triangles(ring) -> Column:
    """Fan of signed triangles: ``struct<s, t>`` with ``t`` counter-clockwise."""
    r = _c(ring)

    def fan(apex):
        def tri(e):
            return let(_turn(apex, e["a"], e["b"]), lambda turn: F.struct(
                F.signum(turn).alias("s"),
                F.when(turn >= 0, F.array(apex, e["a"], e["b"], apex)).otherwise(
                    F.array(apex, e["b"], e["a"], apex)).alias("t")))
        return F.transform(edges(r), tri)
    return F.filter(let(F.element_at(r, 1), fan), lambda f: f["s"] != 0)


def overlap_area(a, b) -> Column:
    """Shared area of two arbitrary polygons.

    ``b`` is fanned into signed triangles; ``a`` is clipped by each (convex) triangle.
    The signed sum is exact for concave rings and for holes alike.
    """
    a = _c(a)
    fans = F.flatten(F.transform(_c(b), triangles))
    return _sum(F.transform(fans, lambda f: f["s"] * clip_area_rings(a, f["t"])))


def _chain(points: Column) -> Column:
    """Half of the hull over sorted points: keep left turns only."""
    def push(acc, p):
        def drop(stack, _):
            n = F.size(stack)
            return F.when((n >= 2) & (_turn(
                F.element_at(stack, F.greatest(n - 1, F.lit(1))),
                F.element_at(stack, F.greatest(n, F.lit(1))), p) <= 0),
                F.slice(stack, F.lit(1), n - 1)).otherwise(stack)
        return F.concat(F.aggregate(acc, acc, drop), F.array(p))
    return F.aggregate(points, no_vertices(), push)


def convex_hull(points) -> Column:
    """Closed counter-clockwise hull ring of an array of vertices."""
    def head(chain):
        return let(chain, lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))
    ring = let(F.array_sort(F.array_distinct(_c(points))), lambda ps: F.concat(
        head(_chain(ps)), head(_chain(F.reverse(ps)))))
    return let(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))


def interpolate(line, distance) -> Column:
    """Vertex at a distance along a line."""
    def between(e, m, seg, d):
        k = F.when(seg == 0, F.lit(0.0)).otherwise((d - m) / seg)
        return vertex(e["a"]["x"] + k * (e["b"]["x"] - e["a"]["x"]),
                      e["a"]["y"] + k * (e["b"]["y"] - e["a"]["y"]))

    def find(d):
        def step(acc, e):
            seg = F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
            return let(seg, lambda s: F.struct(
                (acc["m"] + s).alias("m"),
                F.when(acc["p"].isNull() & (d <= acc["m"] + s),
                       between(e, acc["m"], s, d)).otherwise(acc["p"]).alias("p")))
        start = F.struct(F.lit(0.0).alias("m"),
                         F.lit(None).cast("struct<x:double,y:double>").alias("p"))
        return F.aggregate(edges(_c(line)), start, step)["p"]
    return F.coalesce(let(_c(distance), find), F.element_at(_c(line), -1))


def measured(line) -> Column:
    """Vertices of a line with their distance from its start."""
    def step(acc, v):
        def after(last):
            m = F.when(last.isNull(), F.lit(0.0)).otherwise(
                last["m"] + F.hypot(v["x"] - last["x"], v["y"] - last["y"]))
            return F.concat(acc, F.array(F.struct(
                v["x"].alias("x"), v["y"].alias("y"), m.alias("m"))))
        return let(F.try_element_at(acc, F.lit(-1)), after)
    return F.aggregate(_c(line), F.array().cast("array<struct<x:double,y:double,m:double>>"),
                       step)


def substring(line, start, end) -> Column:
    """Part of a line between two distances along it."""
    s, e = _c(start), _c(end)
    inner = F.transform(F.filter(measured(line), lambda v: (v["m"] > s) & (v["m"] < e)),
                        lambda v: vertex(v["x"], v["y"]))
    return F.concat(F.array(interpolate(line, s)), inner, F.array(interpolate(line, e)))
