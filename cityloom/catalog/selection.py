"""Site selection, budget allocation, capacity-aware assignment, emergency response."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import OFF_NETWORK_WARN_M
from ..operators import nearest, network, selection
from ..plans import analysis, response
from ..session import cut
from ..sources.layers import junction_xy, layer, with_layers
from . import query
from .network import core_sql, edge_sql, edges, facility_nodes, grid_node
from .spatial import stations, zone_points

REACH_M = 1500.0


def problem(spark, d):
    z, f = zone_points(spark, d), stations(spark, d)
    pairs = nearest.distance_pairs(z, f, REACH_M).select(
        F.col("zone_id").alias("demand"), F.col("facility_id").alias("candidate"),
        F.round("cost", 4).alias("cost"))
    demand = z.select(F.col("zone_id").alias("demand"), F.col("population").alias("weight"))
    return cut(pairs), demand, f.select(F.col("facility_id").alias("candidate"))


PAIRS = with_layers("zone", "facility") + """, pr AS (SELECT z.id AS demand, f.id AS candidate,
 round(sqrt(((minx+maxx)/2-x)*((minx+maxx)/2-x)+((miny+maxy)/2-y)*((miny+maxy)/2-y)),4) AS cost,
 population AS w FROM zone z CROSS JOIN facility f
 WHERE sqrt(((minx+maxx)/2-x)*((minx+maxx)/2-x)+((miny+maxy)/2-y)*((miny+maxy)/2-y))<=1500)"""


def cover_sql(rounds):
    parts, picks = [], []
    for i in range(1, rounds + 1):
        done = "" if i == 1 else (" WHERE demand NOT IN (SELECT demand FROM pr WHERE candidate IN ("
                                  + " UNION ALL ".join(f"SELECT candidate FROM g{j}"
                                                       for j in range(1, i)) + "))")
        parts.append(f"g{i} AS (SELECT candidate FROM pr{done} GROUP BY 1 "
                     "ORDER BY sum(w) DESC, candidate LIMIT 1)")
        picks.append(f"SELECT candidate FROM g{i}")
    return ", " + ", ".join(parts), " UNION ALL ".join(picks)


def median_sql(rounds, start="(SELECT max(cost)*2+1 FROM pr)"):
    parts, picks = [f"b0 AS (SELECT id AS demand, {start} AS best FROM zone)"], []
    for i in range(1, rounds + 1):
        parts.append(f"g{i} AS (SELECT candidate FROM pr JOIN b{i-1} USING (demand) GROUP BY 1 "
                     "ORDER BY sum(w*greatest(0,best-cost)) DESC, candidate LIMIT 1)")
        parts.append(f"b{i} AS (SELECT b.demand, least(best, cost) AS best FROM b{i-1} b LEFT JOIN "
                     f"(SELECT demand, cost FROM pr WHERE candidate=(SELECT candidate FROM g{i})) "
                     "USING (demand))")
        picks.append(f"SELECT candidate FROM g{i}")
    return ", " + ", ".join(parts), " UNION ALL ".join(picks)


_C, _CP = cover_sql(4)
_M, _MP = median_sql(4)


@query(f"{PAIRS}{_C} SELECT candidate FROM ({_CP})")
def max_coverage(spark, d):
    pairs, demand, cands = problem(spark, d)
    return selection.greedy_max_coverage(pairs, demand, cands, 4, REACH_M)


@query(f"""{PAIRS}{_C}, op AS ({_CP}), t AS (SELECT sum(population) AS t FROM zone), c AS (SELECT
 sum(population) AS c FROM zone WHERE id IN (SELECT demand FROM pr WHERE candidate IN
 (SELECT candidate FROM op))) SELECT c AS demand_covered, t AS demand_total,
 round_even(c/t,4) AS coverage_ratio FROM c, t""")
def max_coverage_metrics(spark, d):
    pairs, demand, cands = problem(spark, d)
    opened = selection.greedy_max_coverage(pairs, demand, cands, 4, REACH_M)
    return selection.coverage_metrics(pairs, demand, opened, REACH_M)


@query(f"{PAIRS}{_C} SELECT candidate FROM ({_CP})")
def optimized_locations(spark, d):
    """The composed optimisation: pairs within reach, checks, greedy choice."""
    z, f = zone_points(spark, d), stations(spark, d)
    sites = f.select(F.col("facility_id").alias("candidate"), "rx", "ry")
    demand = z.select(F.col("zone_id").alias("demand"), "x", "y", F.col("population").alias("weight"))
    return analysis.optimize_locations(sites, demand, 4, max_cost=REACH_M)[0]


@query(f"{PAIRS}{_M} SELECT candidate FROM ({_MP})")
def p_median(spark, d):
    pairs, demand, cands = problem(spark, d)
    return selection.greedy_p_median(pairs, demand, cands, 4)


@query(with_layers("zone", "facility") + """, op AS (SELECT * FROM facility ORDER BY id LIMIT 5), b AS (SELECT
 z.id, population AS w, min(round(sqrt(((minx+maxx)/2-x)*((minx+maxx)/2-x)+((miny+maxy)/2-y)*((miny+maxy)/2-y)),4))
 AS c FROM zone z CROSS JOIN op GROUP BY 1,2), t AS (SELECT sum(population) AS t FROM zone) SELECT
 round_even(sum(c*w),2) AS objective_weighted_cost, round_even(sum(c*w)/sum(w),2) AS mean_cost_per_demand_unit,
 sum(w) AS demand_served, any_value(t) AS demand_total, round_even(sum(w)/any_value(t),4)
 AS demand_coverage FROM b, t""")
def nearest_site_assignment(spark, d):
    """The plain first-p fallback, assigned at any distance and measured."""
    z, f = zone_points(spark, d), stations(spark, d).withColumnRenamed("facility_id", "candidate")
    opened = cut(selection.first_p(f, 5))
    pairs = nearest.nearest(z, f.join(opened, "candidate", "left_semi"), left_id="zone_id",
                            right_id="candidate").select(
        F.col("zone_id").alias("demand"), "candidate", F.round("distance", 4).alias("cost"))
    demand = z.select(F.col("zone_id").alias("demand"), F.col("population").alias("weight"))
    return selection.assignment_metrics(selection.assign_nearest(pairs, demand, opened), demand)


def items(spark, d):
    return layer(spark, d, "facility").select(
        "id", (F.col("capacity") + 1).alias("cost"), (F.col("id") % 13).cast("double").alias("benefit"))


BUDGET = with_layers("facility").replace("WITH ", "WITH RECURSIVE ", 1) + """, it AS (SELECT id,
 capacity+1 AS cost, CAST(id%13 AS DOUBLE) AS benefit, row_number() OVER (ORDER BY id) AS i
 FROM facility), f(i, id, spent, u) AS (SELECT 0::BIGINT, -1::BIGINT, 0e0, 0 UNION ALL
 SELECT it.i, it.id, CASE WHEN spent+cost<=3000 THEN spent+cost ELSE spent END,
 CASE WHEN spent+cost<=3000 THEN 1 ELSE 0 END FROM f JOIN it ON it.i=f.i+1)"""


@query(BUDGET + " SELECT id, u AS units_allocated FROM f WHERE i>0")
def budget_allocation(spark, d):
    return selection.allocate_budget(items(spark, d), 3000.0, [F.col("id")]).select(
        "id", "units_allocated")


@query(BUDGET + """ SELECT 3000e0 AS budget, sum(u*cost) AS budget_spent, 3000-sum(u*cost) AS
 budget_remaining, sum(u*benefit) AS total_benefit, CAST(sum(u) AS BIGINT) AS units_allocated
 FROM f JOIN it USING (id)""")
def budget_metrics(spark, d):
    return selection.allocation_metrics(
        selection.allocate_budget(items(spark, d), 3000.0, [F.col("id")]), 3000.0)


def assignment(spark, d):
    z, f = zone_points(spark, d), stations(spark, d)
    fac = f.select(F.col("facility_id").alias("facility"), "rx", "ry",
                   (F.col("capacity") * 150).alias("capacity"))
    got = selection.assign_widening(
        z.select(F.col("zone_id").alias("zone"), "x", "y", "population"), fac, REACH_M)
    return got, fac


@query()
def capacity_assignment(spark, d):
    """Zones to facilities, nearest first, while there is room anywhere."""
    return assignment(spark, d)[0].withColumn(
        "travel_time_seconds", F.bround("travel_time_seconds", 1))


@query()
def facility_loads(spark, d):
    got, fac = assignment(spark, d)
    return selection.facility_loads(cut(got), fac)


# ------------------------------------------------------------ emergency response
def two_runs(spark, d):
    """The network as it is and with closures: every street between junctions whose
    number ends in 3 is blocked, those ending in 5 are slowed."""
    net = edges(spark, d, "emergency")
    runs = net.withColumn("run", F.explode(F.array(F.lit("baseline"), F.lit("degraded"))))
    closures = net.select("road_id").distinct().withColumn(
        "effect", F.when(F.col("road_id").cast("long") % 10 == 3, "blocked")
        .when(F.col("road_id").cast("long") % 10 == 5, "slowed")).where(
        "effect IS NOT NULL").withColumn("run", F.lit("degraded"))
    return network.degrade(runs, closures, 3.0, ["run"])


EM = edge_sql("1.3e0")
(_SX, _SY), (_DX, _DY) = junction_xy("src"), junction_xy("dst")
DEG = """dg AS (SELECT src, dst, CASE WHEN id%10=5 THEN t*3 ELSE t END AS t, id FROM e
 WHERE id%10<>3)"""


@query(f"""WITH {EM}, {DEG} SELECT 'baseline' AS run, count(*) AS edges, round(sum(t),2) AS seconds
 FROM e UNION ALL SELECT 'degraded', count(*), round(sum(t),2) FROM dg""")
def degrade_graph(spark, d):
    return two_runs(spark, d).groupBy("run").agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.sum("time"), 2).alias("seconds"))


@query(with_layers("hazard") + f""", {EM}, hz AS (SELECT cx, cy, 32 AS k FROM hazard),
 pr AS (SELECT src, dst, unnest([{_SX},{_DX},({_SX}+{_DX})/2]) AS x,
 unnest([{_SY},{_DY},({_SY}+{_DY})/2]) AS y FROM e)
 SELECT src, dst FROM e EXCEPT SELECT src, dst FROM pr JOIN hz ON x>cx-150 AND x<cx+150
 AND y>cy-150 AND y<cy+150""")
def degrade_by_footprint(spark, d):
    """Edges closed by square hazard footprints."""
    from ..functions import geometry as g
    h = layer(spark, d, "hazard")
    b = [F.col("cx") - 150, F.col("cy") - 150, F.col("cx") + 150, F.col("cy") + 150]
    areas = h.select(g.box_rings(*b).alias("rings"), *[
        c.alias(n) for c, n in zip(b, ("f_minx", "f_miny", "f_maxx", "f_maxy"))])
    out = network.degrade(edges(spark, d, "emergency"), footprints=areas)
    return out.select(grid_node("src").alias("src"), grid_node("dst").alias("dst"))


def incidents(spark, d):
    """Every clinic is the place of one incident."""
    f = facility_nodes(spark, d, None, "clinic")
    return f.select(F.col("facility_id").alias("incident_id"), "x", "y")


def fire_stations(spark, d):
    return facility_nodes(spark, d, None, "fire_station").select(
        F.col("facility_id").alias("station_id"), "x", "y")


def primary(spark, d, top_n=1):
    net = cut(two_runs(spark, d))
    core = cut(response.cores(net, ["run"], grid_node))
    # Where people and stations stand may be off the core: they take its nearest node.
    at = cut(response.snap_per_run(incidents(spark, d), core, "incident_id", ["run"]))
    stations = fire_stations(spark, d)
    home = cut(response.first_at_node(response.snap_per_run(stations, core, "station_id", ["run"]), top_n, ["run"]))
    dist = response.nearest_times(cut(response.within(net, core, ["run"])), home, at, top_n, ["run"])
    resp = response.responses(net, core, at, stations, dist, home=home, by=["run"])
    return cut(response.ranked(resp, top_n, ["run"]))


# Response tables are large recursive searches: both runs in SQL, one keyed recursion each.
def rec(tag, edge, sel):
    return (f"{tag}(inc, node, c) USING KEY (inc, node) AS (SELECT facility_id, node, 0e0 FROM {sel}"
            f" WHERE type='clinic' UNION SELECT {tag}.inc, {edge}.src, min({tag}.c+{edge}.t) FROM {tag}"
            f" JOIN {edge} ON {edge}.dst={tag}.node LEFT JOIN recurring.{tag} r ON r.inc={tag}.inc AND"
            f" r.node={edge}.src WHERE r.node IS NULL OR {tag}.c+{edge}.t<r.c GROUP BY {tag}.inc,"
            f" {edge}.src)")


def on_core(tag, core):
    """Facilities at the nearest node of a core, with the distance to it."""
    (nx, ny), (jx, jy) = junction_xy("node"), junction_xy("j")
    return (f"{tag}pos AS (SELECT node, {nx} AS x, {ny} AS y FROM {core}), {tag}fs AS (SELECT facility_id, type,"
            f" near.node AS node, sqrt(near.d) AS snap FROM (SELECT id AS facility_id, type, {jx} AS px, {jy} AS py FROM"
            f" (SELECT id, type, (id*7919)%(SELECT count(*) FROM part) AS j FROM facility)), LATERAL (SELECT node,"
            f" (x-px)*(x-px)+(y-py)*(y-py) AS d FROM {tag}pos ORDER BY d, CAST(x AS BIGINT), CAST(y AS BIGINT)"
            " LIMIT 1) near)")


RESP = (with_layers("facility").replace("WITH ", "WITH RECURSIVE ", 1)
        + f", {EM}, {DEG}, {core_sql('', 'e')}, {core_sql('d', 'dg')}, {on_core('', 'core')}, {on_core('d', 'dcore')}, "
        + rec("b", "e", "fs") + ", " + rec("q", "dg", "dfs")
        + """, rs AS (SELECT 'baseline' AS run, inc, fs.facility_id AS st, round_even(c,1) AS drive,
 round_even(c+60,1) AS resp, round_even(fs.snap,1) AS home, round_even(h.snap,1) AS stage FROM b JOIN fs ON fs.node=b.node
 AND fs.type='fire_station' JOIN fs h ON h.facility_id=inc
 UNION ALL SELECT 'degraded', inc, dfs.facility_id, round_even(c,1), round_even(c+60,1), round_even(dfs.snap,1),
 round_even(h.snap,1) FROM q JOIN dfs ON dfs.node=q.node AND dfs.type='fire_station' JOIN dfs h ON h.facility_id=inc), rk AS (SELECT *, row_number() OVER (PARTITION BY
 run, inc ORDER BY resp, st) AS rank FROM rs)""")


@query(RESP + f""" SELECT run, inc AS incident_id, st AS station_id, drive AS drive_time_s,
 resp AS response_time_s, CAST(rank AS INTEGER) AS rank, rank=1 AS is_primary,
 stage AS staging_distance_m, home AS station_snap_distance_m, stage>{OFF_NETWORK_WARN_M} AS off_network FROM rk WHERE rank<=3""")
def emergency_routes(spark, d):
    return primary(spark, d, 3).select("run", "incident_id", "station_id", "drive_time_s",
                                       "response_time_s", "rank", "is_primary", "staging_distance_m",
                                       "station_snap_distance_m", "off_network")


@query(RESP + """, b1 AS (SELECT * FROM rk WHERE rank=1 AND run='baseline'), d1 AS (SELECT * FROM rk
 WHERE rank=1 AND run='degraded') SELECT coalesce(b1.inc,d1.inc) AS incident_id,
 b1.resp AS baseline_response_s, d1.resp AS degraded_response_s,
 round_even(d1.resp-b1.resp,1) AS delay_s, b1.resp IS NOT NULL AND d1.resp IS NULL AS cut_off,
 coalesce(d1.st<>b1.st,false) AS responder_changed FROM b1 FULL JOIN d1 ON b1.inc=d1.inc""")
def compare_routes(spark, d):
    return response.compare(primary(spark, d)).select(
        "incident_id", "baseline_response_s", "degraded_response_s", "delay_s", "cut_off",
        "responder_changed")


@query()
def route_geometry(spark, d):
    """Node by node way of the first responder to every incident."""
    net = cut(edges(spark, d, "emergency"))
    core = cut(response.cores(net, name=grid_node))
    net = cut(response.within(net, core))
    at = cut(network.snap(incidents(spark, d), core, "incident_id"))
    stations = fire_stations(spark, d)
    home = cut(response.first_at_node(network.snap(stations, core, "station_id"), 1))
    near = response.nearest_times(net, home, at)
    best = cut(response.ranked(response.responses(net, core, at, stations, near, home=home), 1))
    return response.first_ways(net, best, at, near).select("incident_id", "station_id", "hop", "x", "y", "length")
