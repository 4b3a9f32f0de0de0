"""Grid joins, neighbours and ordered scans against brute force, hot spots included."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cityloom.operators import exposure, gridjoin, nearest, overlay, scan
from cityloom.operators.overlay import BOX, pbox, prefixed


def boxes(rng, n, big=0.0, clump=False):
    rows = []
    for i in range(n):
        x, y = (rng.uniform(50, 51), rng.uniform(50, 51)) if clump and i % 3 == 0 else (
            rng.uniform(0, 100), rng.uniform(0, 100))
        w = rng.uniform(30, 60) if rng.random() < big else rng.uniform(0, 3)
        rows.append((i, x, y, x + w, y + rng.uniform(0, 3)))
    return rows


SCHEMA = "id int, minx double, miny double, maxx double, maxy double"


def brute(a, b, m=0.0):
    return {(p[0], q[0]) for p in a for q in b
            if p[1] - m <= q[3] and p[3] + m >= q[1] and p[2] - m <= q[4] and p[4] + m >= q[2]}


def pairs(spark, a, b, **kw):
    left = spark.createDataFrame(a, SCHEMA)
    right = prefixed(spark.createDataFrame(b, SCHEMA), "r_")
    out = gridjoin.box_pairs(left, right, BOX, pbox("r_"), **kw).select("id", "r_id").collect()
    assert len(out) == len(set(map(tuple, out)))
    return set(map(tuple, out))


def test_box_pairs_mixed_sizes(spark):
    rng = random.Random(1)
    a, b = boxes(rng, 300, 0.1), boxes(rng, 300, 0.02)
    assert pairs(spark, a, b) == brute(a, b)
    assert pairs(spark, a, b, margin=4.0) == brute(a, b, 4.0)


def test_box_pairs_hot_cell_is_salted(spark):
    rng = random.Random(2)
    a, b = boxes(rng, 300, clump=True), boxes(rng, 240, clump=True)
    assert pairs(spark, a, b, cell_rows=20) == brute(a, b)


def test_semi_anti_left(spark):
    rng = random.Random(3)
    a, b = boxes(rng, 120), boxes(rng, 60)
    hit = {i for i, _ in brute(a, b)}
    left = spark.createDataFrame(a, SCHEMA)
    right = prefixed(spark.createDataFrame(b, SCHEMA), "r_")
    args = (left, right, BOX, pbox("r_"), ["id"])
    assert {r.id for r in gridjoin.box_semi(*args).collect()} == hit
    assert {r.id for r in gridjoin.box_semi(*args, anti=True).collect()} == set(range(120)) - hit
    out = gridjoin.box_left(*args).select("id", "r_id").collect()
    assert {tuple(r) for r in out} == brute(a, b) | {(i, None) for i in set(range(120)) - hit}


def test_k_nearest_with_copies_and_far_points(spark):
    rng = random.Random(4)
    right = [(i, rng.choice([5.0, rng.uniform(0, 10)]), 5.0) for i in range(60)]
    left = [(i, rng.uniform(-200, 200) if i % 10 == 0 else rng.uniform(0, 10),
             rng.uniform(0, 10)) for i in range(60)]
    ls = spark.createDataFrame(left, "lid int, x double, y double")
    rs = spark.createDataFrame(right, "rid int, rx double, ry double")
    for k in (1, 3):
        got = {(r.lid, r["rank"]): r.rid for r in nearest.k_nearest(
            ls, rs, k, left_id="lid", right_id="rid").collect()}
        for lid, x, y in left:
            order = sorted(right, key=lambda t: (((t[1] - x) ** 2 + (t[2] - y) ** 2) ** 0.5, t[0]))
            assert [got[lid, i + 1] for i in range(k)] == [t[0] for t in order[:k]]


def test_far_seekers_of_a_dense_centre_compare_few_places(spark):
    rng = random.Random(6)
    right = [(i, rng.gauss(0, 0.5), rng.gauss(0, 0.5)) for i in range(4000)]
    right += [(4000 + i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(40)]
    left = [(i, rng.uniform(-5000, 5000), rng.uniform(-5000, 5000)) for i in range(40)]
    left += [(40 + i, rng.gauss(0, 0.5), rng.gauss(0, 0.5)) for i in range(40)]
    ls = spark.createDataFrame(left, "lid int, x double, y double")
    rs = spark.createDataFrame(right, "rid int, rx double, ry double")
    k, xy = 3, ("rx", "ry")
    base, top = nearest._levels(rs, xy, (), k, *nearest._spans(ls, ("x", "y"), rs, xy))
    cells, _ = nearest.search_cells(ls, rs.withColumns(nearest._base_cell(xy, base)), ("x", "y"), (), k,
                                    base, top, float("inf"))
    most = cells.groupBy("x", "y").agg(F.sum("_n").alias("n")).agg(F.max("n"), F.count("n")).head()
    assert most[0] <= nearest.CROWD + 16 * k and most[1] == len(left)
    for far in (None, 40.0):
        got = {(r.lid, r["rank"]): r.rid for r in nearest.k_nearest(
            ls, rs, k, left_id="lid", right_id="rid", max_distance=far).collect()}
        want = {}
        for lid, x, y in left:
            order = sorted((math.hypot(t[1] - x, t[2] - y), t[0]) for t in right)[:k]
            want |= {(lid, i + 1): r for i, (d, r) in enumerate(order) if far is None or d <= far}
        assert got == want


def test_groups_with_fewer_places_than_asked(spark):
    ls = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 0.0, 0.0), ("c", 3, 0.0, 0.0),
                                ("a", 4, None, 0.0)], "g string, lid int, x double, y double")
    rs = spark.createDataFrame([("a", 7, 3e6, 4e6), ("b", 8, 0.0, 0.0), ("b", 9, 0.0, 0.0),
                                ("b", 5, -1.0, 0.0)], "g string, rid int, rx double, ry double")
    got = nearest.k_nearest(ls, rs, 2, left_id="lid", right_id="rid", on=["g"]).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 7, 5e6, 1), ("b", 2, 8, 0.0, 1), ("b", 2, 9, 0.0, 2)]


def test_nothing_to_find(spark):
    ls = spark.createDataFrame([(1, 0.0, 0.0)], "lid int, x double, y double")
    rs = spark.createDataFrame([], "rid int, rx double, ry double")
    out = nearest.min_distance(ls, rs, left_id="lid", right_id="rid").collect()
    assert [tuple(r) for r in out] == [(1, 0.0, 0.0, None)]


def test_scans_agree_with_windows_when_a_group_is_hot(spark):
    df = spark.range(400).select(
        (F.col("id") % 4).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(9)).otherwise(
            F.col("id") % 4).alias("g"), F.col("id"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    w = Window.partitionBy("g").orderBy("id")
    want = df.withColumn("s", F.sum("id").over(w)).withColumn("l", F.last("v", True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    hot = scan.running_total(df, ["g"], [F.col("id")], F.col("id"), "s", group_rows=10)
    hot = scan.last_before(hot, ["g"], [F.col("id")], F.col("v"), "l", group_rows=10)
    assert sorted(map(tuple, hot.select(*want.columns).collect()), key=str) == sorted(
        map(tuple, want.collect()), key=str)


def test_global_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("s"))
    out = {r.id: r["rank"] for r in scan.global_rank(df, [F.col("s").desc(), F.col("id")]).collect()}
    order = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert out == {i: n + 1 for n, i in enumerate(order)}


def test_union_area_counts_overlaps_once(spark):
    rng = random.Random(5)
    rows = [(i % 2, rng.randint(0, 20), rng.randint(0, 20)) for i in range(60)]
    rows = [(k, float(x), float(y), float(x + 5), float(y + 3)) for k, x, y in rows]
    df = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double")
    for cell in (None, 2.5):
        got = {r.k: r.area for r in overlay.union_area(df, ["k"], ("x0", "y0", "x1", "y1"),
                                                       cell=cell).collect()}
        for k in (0, 1):
            cells = {(a, b) for q, x, y, p, r in rows if q == k
                     for a in range(int(x), int(p)) for b in range(int(y), int(r))}
            assert abs(got[k] - len(cells)) < 1e-6


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """Small files can hold large rows: beyond the counted limit both sides are shuffled."""
    rng = random.Random(3)
    a, b = boxes(rng, 60), boxes(rng, 60)
    left = spark.createDataFrame(a, SCHEMA)
    right = prefixed(spark.createDataFrame(b, SCHEMA), "r_")

    def plan(*args, **kw):
        return gridjoin.box_pairs(*args, **kw)._jdf.queryExecution().sparkPlan().toString()

    monkeypatch.setattr(gridjoin, "BROADCAST_ROWS", 50)
    large = plan(left, right, BOX, pbox("r_"))
    assert "SortMergeJoin" in large and "Broadcast" not in large
    assert pairs(spark, a, b) == brute(a, b)


def test_hazard_roads_join_once(spark, monkeypatch):
    """The join of hazards and roads is not repeated for each of its readers."""
    calls = []
    real = exposure.cut
    monkeypatch.setattr(exposure, "cut", lambda df: calls.append(1) or real(df))
    h = spark.createDataFrame([(1, "fire", 0.0, 0.0, 100.0, 1.0, ["road_redundancy"])],
                              "hazard_id int, hazard_type string, cx double, cy double, radius_m double, intensity double, measures array<string>")
    lines = spark.range(1, 6).selectExpr(
        "id AS road_id", "array(array(named_struct('x', 10D * id, 'y', -5D), named_struct('x', 10D * id, 'y', 5D))) AS rings",
        "10D * id AS r_minx", "-5D AS r_miny", "10D * id AS r_maxx", "5D AS r_maxy")
    out = exposure.hazard_roads(exposure.build_hazards(h), lines, ["hazard_id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("line_") == 0 and len(calls) == 1
    assert {r.effect for r in out.collect()} == {"blocked"} and out.count() == 3


def test_large_joins_have_tasks_by_rows(spark, monkeypatch):
    """A task of a large join holds a bounded number of rows, whatever the session's number of partitions."""
    rng = random.Random(6)
    a, b = boxes(rng, 300), boxes(rng, 300)
    monkeypatch.setattr(gridjoin, "TASK_ROWS", 20)
    left, right = spark.createDataFrame(a, SCHEMA), prefixed(spark.createDataFrame(b, SCHEMA), "r_")
    out = gridjoin.box_pairs(left, right, BOX, pbox("r_"), cell_rows=200)
    assert out.rdd.getNumPartitions() == 30
    assert {(r.id, r.r_id) for r in out.collect()} == brute(a, b)


def test_land_blocks_across_squares(spark, monkeypatch):
    """Blocks that wind through many squares, slanted roads and areas that touch, against a flood fill."""
    from cityloom.operators import traversal
    from cityloom.plans import derive
    rng, cell, clearance = random.Random(3), 10.0, 6.0
    areas = [("a", -900.0, -300.0, 800.0, 700.0), ("b", 800.0, -305.0, 1000.0, 200.0), ("c", -900.0, -300.0, -850.0, -250.0)]
    roads = [(x, y, x + rng.choice([0.0, 300.0, -250.0]), y + rng.choice([0.0, 280.0, 120.0])) for x, y in (
        (rng.uniform(-1000, 1000), rng.uniform(-400, 700)) for _ in range(60))]
    calls = []
    monkeypatch.setattr(traversal, "cut", lambda df, f=traversal.cut: calls.append(1) or f(df))
    got = {}
    for r in derive.land_blocks(spark.createDataFrame(areas, "area_id string, minx double, miny double, maxx double, maxy double"),
                                spark.createDataFrame(roads, "ax double, ay double, bx double, by double"), cell, clearance).collect():
        got[r.area_id, r.cx, r.cy] = r.block
    want = {}
    for name, x0, y0, x1, y1 in areas:
        free = set()
        for cx in range(math.floor(x0 / cell), math.ceil(x1 / cell)):
            for cy in range(math.floor(y0 / cell), math.ceil(y1 / cell)):
                x, y = (cx + 0.5) * cell, (cy + 0.5) * cell
                if all(_segment_distance(x, y, *r) > clearance for r in roads):
                    free.add((cx, cy))
        for start in sorted(free):
            if (name, *start) in want:
                continue
            todo, label = [start], f"{name}/{start[0] + 10**9:012d}/{start[1] + 10**9:012d}"
            while todo:
                cx, cy = todo.pop()
                if (cx, cy) in free and (name, cx, cy) not in want:
                    want[name, cx, cy] = label
                    todo += [(cx + 1, cy), (cx - 1, cy), (cx, cy + 1), (cx, cy - 1)]
    assert got == want and len(set(want.values())) > 10 and len(calls) < 8


def _segment_distance(x, y, ax, ay, bx, by):
    l2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0.0 if l2 == 0 else min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / l2))
    return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
