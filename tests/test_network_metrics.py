"""Network times of sites and component sizes by region against plain searches."""

import heapq
import random

from pyspark.sql import functions as F

from cityloom.functions import geometry as g
from cityloom.operators import blocks, candidates, network, traversal

STEP = 100.0


def streets(spark, seed, side=7):
    """A grid with gaps, one-way and slow streets."""
    rng, rows = random.Random(seed), []
    for i in range(side):
        for j in range(side):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < side and j + dj < side and rng.random() < 0.75:
                    rows.append((len(rows), i * STEP, j * STEP, (i + di) * STEP, (j + dj) * STEP,
                                 float(rng.choice([18, 36, 41])), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, speed double, oneway boolean")
    return rows, df.select("id", F.array(g.vertex("x0", "y0"), g.vertex("x1", "y1")).alias("line"),
                           F.lit("local").alias("road_class"), "speed", F.lit(None).cast("double").alias("capacity"),
                           "oneway")


def links(rows):
    out = {}
    for _, x0, y0, x1, y1, speed, oneway in rows:
        t = STEP / (speed * 1000 / 3600)
        out.setdefault((x0, y0), []).append(((x1, y1), t))
        out.setdefault((x1, y1), [])
        if not oneway:
            out[(x1, y1)].append(((x0, y0), t))
    return out


def search(net, start):
    best, heap = {}, [(0.0, start)]
    while heap:
        t, n = heapq.heappop(heap)
        if n not in best:
            best[n] = t
            for m, w in net[n]:
                heapq.heappush(heap, (t + w, m))
    return best


def near(net, x, y):
    return min(net, key=lambda n: ((n[0] - x) ** 2 + (n[1] - y) ** 2, n))


def test_mean_time_of_zones_in_reach(spark):
    rows, roads = streets(spark, 5)
    net, rng, cutoff = links(rows), random.Random(6), 47.0
    points = [(i, rng.uniform(0, 650), rng.uniform(0, 650)) for i in range(30)]
    # Some zones share their middle, some are empty or of unknown population.
    middles = [(rng.uniform(0, 650), rng.uniform(0, 650)) for _ in range(25)] + [(333.0, 333.0)] * 3
    zones = [(x - 10, y - 5, x + 10, y + 5, rng.choice([None, 0.0, 5.0, 80.0])) for x, y in middles]
    got = {r[0]: r[1] for r in candidates.network_time(
        spark.createDataFrame(points, "id int, x double, y double"),
        spark.createDataFrame(zones, "minx double, miny double, maxx double, maxy double, population double"),
        network.build_edges(roads), cutoff, key="id").collect()}
    want = {}
    reach = [(search(net, near(net, x, y)), z[4] or 0.0) for (x, y), z in zip(middles, zones)]
    for i, x, y in points:
        home = near(net, x, y)
        ok = [(r[home], w) for r, w in reach if r.get(home, cutoff + 1) <= cutoff]
        if ok:
            total = sum(w for _, w in ok)
            want[i] = sum(t * w for t, w in ok) / total if total else sum(t for t, _ in ok) / len(ok)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_no_zone_in_reach_and_no_zone_at_all(spark):
    rows, roads = streets(spark, 7)
    points = spark.createDataFrame([(1, 5.0, 5.0)], "id int, x double, y double")
    schema = "minx double, miny double, maxx double, maxy double, population double"
    far = spark.createDataFrame([(590.0, 590.0, 610.0, 610.0, 9.0)], schema)
    edges = network.build_edges(roads)
    assert candidates.network_time(points, far, edges, 1.0, key="id").count() == 0
    assert candidates.network_time(points, far.limit(0), edges, 900.0, key="id").count() == 0


def test_component_sizes_by_region(spark):
    rows, roads = streets(spark, 8)
    roads = roads.withColumn("region", F.when(F.col("line")[0]["x"] < 300, "west").otherwise("east"))
    got = sorted((r.region, r.n) for r in traversal.component_sizes(
        network.build_edges(roads, by=["region"]), ["region"]).collect())
    want = []
    for name in ("west", "east"):
        parent = {}

        def find(a):
            while parent.setdefault(a, a) != a:
                a = parent[a]
            return a
        for _, x0, y0, x1, y1, *_ in rows:
            if (x0 < 300) == (name == "west"):
                parent[find((x0, y0))] = find((x1, y1))
        roots = [find(n) for n in list(parent)]
        want += [(name, roots.count(r)) for r in set(roots)]
    assert got == sorted(want)


def test_nearest_sources_against_plain_searches(spark):
    """The k nearest, and all up to the slack behind; labels of farther sources are not handed on."""
    rows, roads = streets(spark, 5)
    net = network.build_edges(roads)
    k, starts = 2, [(0.0, 0.0), (600.0, 600.0), (300.0, 0.0), (0.0, 500.0), (400.0, 400.0)]
    seeds = spark.createDataFrame(starts, "x double, y double").select(network.node_key(F.col("x"), F.col("y")).alias("node"))
    x, y = network.node_xy("node")
    sx, sy = network.node_xy("source")
    for slack in (0.0, 25.0):
        got = traversal.nearest_sources(net, seeds, k, slack=slack).select(
            x.alias("x"), y.alias("y"), sx.alias("sx"), sy.alias("sy"), "cost").collect()
        times = {s: search(links(rows), s) for s in starts if s in links(rows)}
        want = set()
        for node in {n for t in times.values() for n in t}:
            costs = sorted(t[node] for t in times.values() if node in t)
            far = costs[:k][-1] + slack + 1e-6
            want |= {(node, s) for s, t in times.items() if t.get(node, far + 1) <= far}
        found = {((r.x, r.y), (r.sx, r.sy)): r.cost for r in got if (r.sx, r.sy) in times}
        assert set(found) == want
        assert all(abs(c - times[s][n]) < 1e-6 for (n, s), c in found.items())
    assert any(len(t) > 10 for t in times.values())


def test_search_with_a_cutoff_of_its_own(spark):
    rows, roads = streets(spark, 6)
    net = network.build_edges(roads)
    one, two = sorted(links(rows))[3], sorted(links(rows))[-4]
    seeds = spark.createDataFrame([(*one, 1, 40.0), (*two, 2, 20.0)], "x double, y double, who int, reach double").select(
        network.node_key(F.col("x"), F.col("y")).alias("node"), "who", "reach", F.lit(0.0).alias("cost"))
    got = traversal.relax(net, seeds, by=["who", "reach"], cutoff="reach").groupBy("who").count().collect()
    want = {1: sum(c <= 40.0 for c in search(links(rows), one).values()),
            2: sum(c <= 20.0 for c in search(links(rows), two).values())}
    assert dict(map(tuple, got)) == want


def test_hub_is_not_bridged(spark):
    """A star of one-way links: two-edge ways across its middle would be a product."""
    star = [(i, 0) for i in range(1, 101)] + [(0, i) for i in range(101, 201)]
    net = spark.createDataFrame(star, "src long, dst long")
    assert traversal._two_hops(net, [], None, None).count() == 200
    ring = star + [(200, 1)]  # 1 -> 0 -> 200 -> 1
    got = traversal.strong_components(spark.createDataFrame(ring, "src long, dst long")).collect()
    assert {r.node for r in got if r.component == 0} == {0, 1, 200} and len(got) == 201


def _counted(monkeypatch, *modules):
    calls = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df, f=m.cut: calls.append(1) or f(df))
    return calls


def test_a_long_way_needs_few_rounds(spark, monkeypatch):
    """1,500 edges in a row: a round for each few edges would be hundreds of jobs."""
    calls = _counted(monkeypatch, traversal, blocks)
    net = spark.range(1500).selectExpr("id AS src", "id + 1 AS dst", "1.5D AS time", "'r' AS region")
    start = spark.createDataFrame([(0, 2.0, "r")], "node long, cost double, region string")
    got = {r.node: r.cost for r in traversal.relax(net, start, by=["region"], edge_by=["region"], cutoff=2000.0).collect()}
    assert got == {n: 2.0 + 1.5 * n for n in range(1333)}
    sizes = traversal.component_sizes(net, ["region"]).collect()
    assert [tuple(r) for r in sizes] == [("r", 0, 1501)] and len(calls) < 25


def test_search_and_components_across_small_blocks(spark, monkeypatch):
    """Blocks of six edges and tasks of one search give what one search over everything gives."""
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 6)
    monkeypatch.setattr(blocks, "BLOCK_RUNS", 1)
    monkeypatch.setattr(blocks, "FINE", 9)
    rows, roads = streets(spark, 6)
    net = network.build_edges(roads)
    starts = [sorted(links(rows))[i] for i in (0, 9, -3)]
    seeds = spark.createDataFrame([(*s, i) for i, s in enumerate(starts)], "x double, y double, who int").select(
        network.node_key(F.col("x"), F.col("y")).alias("node"), "who", F.lit(0.0).alias("cost"))
    got = {}
    x, y = network.node_xy("node")
    for r in traversal.relax(net, seeds, by=["who"], cutoff=60.0).withColumns({"x": x, "y": y}).collect():
        got[r.who, (r.x, r.y)] = r.cost
    want = {(i, n): c for i, s in enumerate(starts) for n, c in search(links(rows), s).items() if c <= 60.0}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one = traversal.components(net).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    both = traversal.component_sizes(net.withColumn("region", F.lit("r")), ["region"])
    assert sorted(map(tuple, both.drop("region").collect())) == sorted(map(tuple, one.collect()))


def test_strong_components_across_small_blocks(spark, monkeypatch):
    """Blocks of six edges give the components of every network by itself."""
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 6)
    monkeypatch.setattr(blocks, "FINE", 9)
    nets = {name: streets(spark, seed) for name, seed in (("a", 7), ("b", 8))}
    both = [network.build_edges(roads).withColumn("run", F.lit(n)) for n, (_, roads) in nets.items()]
    got = {}
    for r in traversal.strong_components(both[0].unionByName(both[1]), ["run"]).collect():
        got.setdefault((r.run, r.component), set()).add(r.node)
    for (run, name), nodes in got.items():
        assert name == min(nodes)
    key = {p: n for n, p in ((r.node, (r.x, r.y)) for r in network.nodes_of(both[0].unionByName(both[1])).collect())}
    want = set()
    for run, (rows, _) in nets.items():
        reach = {s: set(search(links(rows), s)) for s in links(rows)}
        want |= {(run, frozenset(key[n] for n in reach[s] if s in reach[n])) for s in reach}
    assert {(run, frozenset(n)) for (run, _), n in got.items()} == want and max(len(n) for _, n in want) > 10


def test_strong_components_need_few_rounds(spark, monkeypatch):
    """Rings in a row, tied by one-way links: trimming or colouring would take them one by one."""
    calls = _counted(monkeypatch, traversal, blocks)
    rings = spark.range(3000).selectExpr("id AS src", "CASE WHEN id%3=2 THEN id-2 ELSE id+1 END AS dst")
    tied = rings.unionByName(spark.range(999).selectExpr("id*3+2 AS src", "id*3+3 AS dst"))
    got = traversal.strong_components(tied).groupBy("component").count().collect()
    assert {tuple(r) for r in got} == {(3 * i, 3) for i in range(1000)} and len(calls) < 12


def test_first_of_equal_cores_is_named_by_junction(spark, tmp_path):
    from cityloom.catalog.network import routable_core
    spark.createDataFrame([(10, 1), (11, 1), (100, 1), (101, 1)], "p_partkey long, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    assert sorted(r.node for r in routable_core(spark, str(tmp_path)).collect()) == [10, 11]


def test_nearest_sources_across_small_blocks(spark, monkeypatch):
    """Blocks of six edges hand on the labels that one search over everything keeps."""
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 6)
    monkeypatch.setattr(blocks, "FINE", 9)
    rows, roads = streets(spark, 9)
    calls = _counted(monkeypatch, traversal, blocks)
    test_nearest_sources_against_plain_searches(spark)
    net = network.build_edges(roads).withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"))))
    nodes = [r.node for r in net.select(F.col("src").alias("node")).distinct().orderBy("node").collect()]
    seeds = spark.createDataFrame([("a", nodes[0]), ("a", nodes[9]), ("b", nodes[-5])], "run string, node long")
    got = {(r.run, r.node, r.source): r.cost for r in traversal.nearest_sources(net, seeds, 1, by=["run"]).collect()}
    place = {r.node: (r.x, r.y) for r in network.nodes_of(net).collect()}
    want = {}
    for run, starts in (("a", (nodes[0], nodes[9])), ("b", (nodes[-5],))):
        times = {s: search(links(rows), place[s]) for s in starts}
        for n, p in place.items():
            best = min((t.get(p, 1e9) for t in times.values()), default=1e9)
            want |= {(run, n, s): t[p] for s, t in times.items() if t.get(p, 2e9) <= best + 1e-6}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want) and calls


def test_nearest_sources_on_a_long_way_need_few_rounds(spark, monkeypatch):
    calls = _counted(monkeypatch, traversal, blocks)
    net = spark.range(1500).selectExpr("id AS src", "id + 1 AS dst", "1.5D AS time")
    seeds = spark.createDataFrame([(0,), (700,)], "node long")
    got = traversal.nearest_sources(net, seeds, 1).collect()
    assert {(r.node, r.source): r.cost for r in got} == {
        (n, 700 * (n >= 700)): 1.5 * (n - 700 * (n >= 700)) for n in range(1501)} and len(calls) < 12


def test_stations_at_one_node_are_not_paired_with_every_incident(spark):
    """Forty stations and forty incidents at the ends of one street: three pairs an incident, not forty."""
    from cityloom.plans import response
    net = spark.createDataFrame([(0, 1, 5.0, 9.0), (1, 0, 5.0, 9.0), (1, 2, 1.0, 9.0)], "src long, dst long, time double, length double")
    core = spark.createDataFrame([(0,), (1,)], "node long")
    inner = response.within(net, core)
    assert sorted((r.src, r.dst) for r in inner.collect()) == [(0, 1), (1, 0)]
    home = spark.range(40).selectExpr("id AS station_id", "0L AS node", "0D AS snap_m")
    at = spark.range(40).selectExpr("id AS incident_id", "1L AS node", "0D AS snap_m")
    few = response.first_at_node(home, 3)
    dist = response.nearest_times(inner, few, at, 3)
    pairs = response.responses(inner, core, at, None, dist, home=few)
    assert pairs.count() == 120
    both = [response.ranked(response.responses(inner, core, at, None, dist, home=h), 3) for h in (few, home)]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))
    best = response.ranked(pairs, 1)
    ways = response.first_ways(inner, best, at, dist).collect()
    assert sorted((r.incident_id, r.station_id, r.hop, r.length) for r in ways) == sorted(
        (i, 0, h, length) for i in range(40) for h, length in ((0, 9.0), (1, None)))
