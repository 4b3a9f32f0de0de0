"""Geometry and projection functions against hand values and random shapes."""

import math
import random

from pyspark.sql import functions as F

from cityloom.functions import geometry as g
from cityloom.functions import projection as p

L = [[(0., 0.), (4., 0.), (4., 2.), (2., 2.), (2., 4.), (0., 4.), (0., 0.)]]
SQUARE = [[(1., 1.), (3., 1.), (3., 3.), (1., 3.), (1., 1.)]]
HOLED = [[(0., 0.), (10., 0.), (10., 10.), (0., 10.), (0., 0.)],
         [(3., 3.), (3., 7.), (7., 7.), (7., 3.), (3., 3.)]]
BOWTIE = [[(0., 0.), (2., 2.), (0., 2.), (2., 0.), (0., 0.)]]


def one(spark, shapes, *cols):
    names = [f"s{i}" for i in range(len(shapes))]
    df = spark.createDataFrame([tuple(shapes)], ", ".join(f"{n} {g.RINGS}" for n in names))
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def test_areas_and_overlay(spark):
    r = one(spark, [L, SQUARE, HOLED], g.area("s0"), g.overlap_area("s0", "s1"),
            g.overlap_area("s1", "s0"), g.area("s2"), g.overlap_area("s2", "s1"))
    assert list(r) == [12.0, 3.0, 3.0, 84.0, 4.0]


def test_validity_and_simple(spark):
    r = one(spark, [BOWTIE, L], g.is_valid_polygon("s0"), g.is_valid_polygon("s1"))
    assert list(r) == [False, True]


def test_points(spark):
    def at(x, y):
        return g.contains_point("s0", F.lit(x), F.lit(y))
    r = one(spark, [HOLED], at(1., 1.), at(5., 5.), at(0., 5.), at(11., 5.),
            g.covers_point("s0", F.lit(0.), F.lit(5.)))
    assert list(r) == [True, False, False, False, True]


def test_representative_point_is_inside(spark):
    u = [[(0., 0.), (9., 0.), (9., 9.), (6., 9.), (6., 1.), (3., 1.), (3., 9.), (0., 9.), (0., 0.)]]
    pt = g.representative_point("s0")
    r = one(spark, [u], pt, g.contains_point("s0", pt["x"], pt["y"]))
    assert r[1]


def test_line_functions(spark):
    line = [[(0., 0.), (4., 0.), (4., 2.)]]
    r = one(spark, [line, SQUARE], g.length("s0"),
            g.substring(F.col("s0")[0], F.lit(1.0), F.lit(5.0)),
            g.line_distance("s0", F.lit(2.), F.lit(3.)), g.centroid("s0")["x"])
    assert r[0] == 6.0
    assert [tuple(v) for v in r[1]] == [(1., 0.), (4., 0.), (4., 1.)]
    assert abs(r[2] - math.hypot(2, 1)) < 1e-12 and abs(r[3] - (2 * 4 + 4 * 2) / 6) < 1e-12


def test_hull(spark):
    r = one(spark, [L], g.convex_hull(F.flatten("s0")))
    assert [tuple(v) for v in r[0]] == [(0., 0.), (4., 0.), (4., 2.), (2., 4.), (0., 4.), (0., 0.)]


def test_disc_polygon(spark):
    r = one(spark, [SQUARE], g.area(g.disc_rings(F.lit(0.), F.lit(0.), F.lit(2.))),
            g.disc_area(F.lit(2.0)), g.in_disc(F.lit(1.99), F.lit(0.), F.lit(0.), F.lit(0.), F.lit(2.)),
            g.in_disc(F.lit(1.999), F.lit(0.098), F.lit(0.), F.lit(0.), F.lit(2.)))
    assert abs(r[0] - r[1]) < 1e-9 and r[2] and not r[3]
    assert abs(r[0] / (math.pi * 4) - 0.99839) < 1e-4


def _star(rng):
    n = rng.randint(4, 9)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    cx, cy = rng.uniform(-2, 2), rng.uniform(-2, 2)
    pts = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles
           for r in [rng.uniform(1, 5)]]
    return [pts + [pts[0]]]


def test_box_area_equals_general_overlay(spark):
    """Edge integrals, triangle fans and half-plane clips agree on random polygons, and the
    parts inside and outside of a box add up."""
    rng = random.Random(7)
    rows = [(_star(rng), rng.uniform(-4, 0), rng.uniform(-4, 0), rng.uniform(0, 4),
             rng.uniform(0, 4)) for _ in range(60)]
    df = spark.createDataFrame(rows, f"s {g.RINGS}, x0 double, y0 double, x1 double, y1 double")
    box = ("x0", "y0", "x1", "y1")
    ring = F.element_at(g.box_rings(*box), 1)
    left = ("lo", "y0", "x0", "y1")
    df = df.withColumn("lo", F.lit(-50.0))
    out = df.select(
        g.area_in_box("s", box).alias("a"), g.overlap_area("s", g.box_rings(*box)).alias("b"),
        g.overlap_area(g.box_rings(*box), "s").alias("c"),
        g.clip_area_rings("s", ring).alias("d"), g.area_in_box("s", left).alias("e"),
        g.area_in_box("s", ("lo", "y0", "x1", "y1")).alias("f")).collect()
    for r in out:
        assert abs(r.a - r.b) < 1e-9 and abs(r.a - r.c) < 1e-9 and abs(r.a - r.d) < 1e-9
        assert abs(r.a + r.e - r.f) < 1e-9


def test_disc_area_in_box(spark):
    df = spark.createDataFrame([(x / 3, y / 3) for x in range(-9, 9) for y in range(-9, 9)],
                               "x0 double, y0 double")
    df = df.withColumns({"x1": F.col("x0") + 0.8, "y1": F.col("y0") + 0.5})
    box = ("x0", "y0", "x1", "y1")
    disc = g.disc_rings(F.lit(0.1), F.lit(-0.2), F.lit(2.0))
    out = df.select(g.disc_area_in_box(F.lit(0.1), F.lit(-0.2), F.lit(2.0), box).alias("a"),
                    g.overlap_area(disc, g.box_rings(*box)).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in out)


def test_utm_known_value_and_zone(spark):
    df = spark.range(1).select(
        p.to_utm(F.lit(3.0), F.lit(0.0), F.lit(32631)).alias("eq"),
        p.to_utm(F.lit(73.14), F.lit(19.0), F.lit(32643)).alias("xy"),
        p.utm_srid(F.lit(4.47), F.lit(51.9)).alias("z"), p.utm_srid(F.lit(30.0), F.lit(-5.0)).alias("s"),
        p.to_web_mercator(F.lit(180.0), F.lit(0.0))["x"].alias("m"))
    r = df.head()
    # On the central meridian the easting is 500 km and the northing k0 times the arc.
    assert abs(r.eq.x - 500000) < 1e-6 and abs(r.eq.y) < 1e-6
    assert 300_000 < r.xy.x < 310_000 and 2_100_000 < r.xy.y < 2_103_000
    assert (r.z, r.s) == (32631, 32736) and abs(r.m - 20037508.342789) < 1e-3


def test_local_scale_matches_ground(spark):
    r = spark.range(1).select(
        p.local_distance(F.lit(73.0), F.lit(19.0), F.lit(73.01), F.lit(19.0)).alias("l"),
        p.mercator_distance(F.lit(73.0), F.lit(19.0), F.lit(73.01), F.lit(19.0)).alias("m")).head()
    assert abs(r.m * math.cos(math.radians(19)) / r.l - 1) < 1e-9
