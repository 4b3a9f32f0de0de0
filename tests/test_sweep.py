"""Areas of overlaid rings: hand values, known unions, and properties of random shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.functions import geometry as g
from cityloom.operators import constraints, overlay, sweep

SHAPE = "id long, grp long, side int, rings array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [*points, points[0]]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SHAPE)


L = ring((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0))
HOLED = [box(0.0, 0.0, 10.0, 10.0), list(reversed(box(3.0, 3.0, 7.0, 7.0)))]


def areas(spark, rows, **kw):
    out = sweep.overlay_areas(frame(spark, rows), ["grp"], "rings", "side", **kw).collect()
    return {r.grp: tuple(round(x, 6) for x in (r.area_first, r.area_second, r.area_both)) for r in out}


@pytest.mark.parametrize("cell", [None, 1.0, 3.7, 100.0])
def test_hand_values(spark, cell):
    diamond = [ring((0.0, -2.0), (2.0, 0.0), (0.0, 2.0), (-2.0, 0.0))]
    rows = [(1, 0, [L]), (1, 1, [box(1.0, 1.0, 3.0, 3.0)]),
            (2, 0, HOLED), (2, 1, [box(2.0, 2.0, 8.0, 8.0)]),
            (3, 0, HOLED), (3, 0, HOLED), (3, 0, [box(4.0, 4.0, 5.0, 5.0)]),
            (4, 0, diamond), (4, 1, [box(-1.0, -1.0, 1.0, 1.0)]),
            (5, 0, [box(0.0, 0.0, 1.0, 1.0)]), (5, 1, [box(5.0, 5.0, 6.0, 7.0)]),
            (6, 0, [box(-8.0, -8.0, 8.0, 8.0)]), (6, 1, [ring((-6.0, -6.0), (6.0, -6.0), (0.0, 6.0))])]
    assert areas(spark, rows, cell=cell) == {
        1: (12.0, 4.0, 3.0), 2: (84.0, 36.0, 20.0), 3: (85.0, 0.0, 0.0), 4: (8.0, 4.0, 4.0), 5: (1.0, 2.0, 0.0),
        6: (256.0, 72.0, 72.0)}


def star(rng, x, y, n):
    turns = [(i + rng.uniform(0, 0.9)) * 2 * math.pi / n for i in range(n)]
    return ring(*[(x + r * math.cos(t), y + r * math.sin(t)) for t in turns for r in [rng.uniform(1, 5)]])


def plain_area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:], strict=False)) / 2


def test_random_shapes(spark):
    """Each pair's common area is that of the triangle formula; shapes alone keep their own area."""
    rng, rows = random.Random(4), []
    for k in range(24):
        a, b = star(rng, 0, 0, 8), star(rng, 2, 1, 9)
        rows += [(k, 0, [a]), (k, 1, [b])]
    got = areas(spark, rows)
    for cell, edges in ((1.3, 128), (4.0, 6)):
        for k, x in areas(spark, rows, cell=cell, cell_edges=edges).items():
            assert x == pytest.approx(got[k], abs=1e-4)
    pairs = frame(spark, [r for r in rows if r[1] == 0]).join(
        frame(spark, [r for r in rows if r[1] == 1]).select("grp", F.col("rings").alias("other")), "grp")
    for r in pairs.select("grp", g.overlap_area("rings", "other").alias("both"), g.area("rings").alias("one"),
                          g.area("other").alias("two")).collect():
        assert got[r.grp] == pytest.approx((r.one, r.two, r.both), abs=1e-4)
        assert r.one == pytest.approx(plain_area(rows[2 * r.grp][2][0]))


def test_union_of_boxes_and_full_cells(spark):
    """As the union of boxes, also where cells overflow and are cut finer."""
    rng = random.Random(9)
    rows = [(k % 2, 0, [box(x, y, x + rng.randint(1, 30), y + rng.randint(1, 30))])
            for k in range(300) for x, y in [(float(rng.randint(-40, 40)), float(rng.randint(-40, 40)))]]
    df = frame(spark, rows)
    flat = df.select("grp", *[g.bounds("rings")[c].alias(c) for c in overlay.BOX])
    want = {r.grp: r.area for r in overlay.union_area(flat, ["grp"], overlay.BOX).collect()}
    got = {r.grp: r.area for r in sweep.union_area(df, ["grp"], cell_edges=40).collect()}
    assert got == pytest.approx(want)


def test_buffers(spark):
    """The grown shape's area: of a square, and of an L, whose inner corner adds nothing twice."""
    df = frame(spark, [(1, 0, [box(0.0, 0.0, 10.0, 10.0)]), (2, 0, [L]), (3, 0, HOLED)])
    out = {r.grp: r.area for r in sweep.union_area(sweep.buffer_shapes(df, "rings", 1.0), ["grp"]).collect()}
    disc = 32 * math.sin(2 * math.pi / 64)
    assert out[1] == pytest.approx(100 + 40 + disc)
    assert out[2] == pytest.approx(12 + 16 + 1.25 * disc - 1)
    assert out[3] == pytest.approx(100 + 40 + disc - 4)


def test_empty_and_flat(spark):
    flat = [ring((0.0, 0.0), (5.0, 0.0), (2.0, 0.0))]
    assert areas(spark, [(1, 0, flat), (2, 0, [])]) == {}
    assert areas(spark, []) == {}


def test_buffer_areas(spark):
    """In rows as through the grid, also where a key has several shapes or too many corners; the edges of discs, which
    are a hundred times the shapes, are not exchanged."""
    rng = random.Random(3)
    rows = [(k, 0, [star(rng, 9.0 * k, 3.0 * i, 7)]) for k in range(6) for i in range(1 + k)]
    df = frame(spark, [*rows, (None, 0, [L])])
    row = sweep.buffer_areas(df, ["grp"], "rings", 1.5)
    grid = sweep.union_area(sweep.buffer_shapes(df, "rings", 1.5), ["grp"])
    got, want = ({r.grp: r.area for r in out.collect()} for out in (row, grid))
    assert sorted(got) == list(range(6)) and got == pytest.approx(want, abs=1e-5)
    one = sweep.buffer_areas(df.where("grp < 2"), ["grp"], "rings", 1.5)
    assert "_layer" in (plan := one._jdf.queryExecution().executedPlan().toString())
    assert "_layer" not in plan[plan.index("Exchange"):]


def test_crowded_spot(spark):
    """Blocks of pairs and slabs end in the same areas as one block."""
    rng = random.Random(5)
    rows = [(1, i % 2, [star(rng, rng.uniform(0, 3), rng.uniform(0, 3), 9)]) for i in range(40)]
    layer, *c, w = (np.array(v, dtype=float) for v in zip(*[
        (s, *(a + b if a[0] < b[0] else b + a), 1 if a[0] < b[0] else -1)
        for _, s, (r,) in rows for a, b in zip(r, r[1:], strict=False)], strict=True))
    whole = sweep._cell_areas(layer, np.array(c), w, 50.0)
    block, sweep.BLOCK = sweep.BLOCK, 700
    try:
        assert sweep._cell_areas(layer, np.array(c), w, 50.0) == pytest.approx(whole)
    finally:
        sweep.BLOCK = block
    assert areas(spark, rows)[1] == pytest.approx(whole, abs=1e-5)


def test_only_meeting_constraints_grow(spark, monkeypatch):
    """Shapes out of reach of every parcel are not grown; the share is that of the grown shape."""
    seen, grow = [], sweep.buffer_shapes
    monkeypatch.setattr(sweep, "buffer_shapes", lambda df, *a: seen.append(df.count()) or grow(df, *a))
    p = frame(spark, [(1, 0, [box(0.0, 0.0, 10.0, 10.0)])]).select(
        "id", "rings", g.area("rings").alias("area"), *[g.bounds("rings")[c].alias(c) for c in overlay.BOX])
    c = frame(spark, [(1, 0, [box(x, 0.0, x + 10.0, 10.0)]) for x in (12.0, 500.0, 900.0)]).select(
        F.col("id").alias("c_id"), F.col("rings").alias("c_rings"), F.lit("area").alias("c_type"), F.lit("soft").alias("c_severity"),
        F.lit(1.0).alias("c_weight"), F.lit(5.0).alias("c_buffer"), *[g.bounds("rings")[c].alias("c_" + c) for c in overlay.BOX])
    got = constraints.constraint_hits(p, c, key=["id"], rings=True).collect()
    assert [(r.id, r.c_id, round(r.overlap, 6)) for r in got] == [(0, 0, 0.3)] and seen == [1]


def test_flood_exposure_does_not_broadcast_zones(spark):
    """Zones with shapes are far larger than their file: a broadcast by estimate runs through the driver."""
    from cityloom.catalog import shapes
    from cityloom.operators import exposure
    BOX = overlay.BOX

    def boxes(prefix, **more):
        df = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 40.0), (2, 20.0, 20.0, 60.0, 60.0)],
                                   ", ".join(f"{prefix}{c} {t}" for c, t in zip(("id", *BOX), ("long", *["double"] * 4))))
        return df.withColumn(prefix + "rings", shapes.hexagon(prefix)).withColumns(
            {prefix + k: F.lit(v) for k, v in more.items()})
    points = spark.createDataFrame([(1, 5.0, 20.0)], "f_id long, x double, y double")
    out = exposure.flood_exposure(boxes("h_"), boxes("", population_estimate=3.0), boxes("z_", population=8.0), points, rings=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [z_id" in plan and "BroadcastHashJoin [z_id" not in plan
    row = out.head()
    assert row.buildings_exposed == 2 and row.population_exposed == 16.0 and row.facilities_exposed == 1
