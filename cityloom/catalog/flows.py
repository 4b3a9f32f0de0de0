"""Composed analyses over the street grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import network, scenario, traversal
from ..plans import analysis
from ..session import cut
from ..sources.layers import layer, table, with_layers
from . import query
from .hazards import DELTAS, MEASURES, SUMMARY, facility_boxes, street_lines
from .network import (AT, FAC_AT, REACH, ZONE_AT, edge_sql, edges, facility_nodes, roads, zones_at)
from .spatial import boxes


def facility_log(spark, d):
    """Scenario s closes the facilities numbered s modulo 5 and enlarges the next ones."""
    s = table(spark, d, "supplier")
    return s.selectExpr("stack(2, s_suppkey*2, s_suppkey%5, 'DELETE', '{}', s_suppkey*2+1, "
                        "(s_suppkey+1)%5, 'UPDATE', '{\"capacity\": 999}') AS "
                        "(change_id, scenario_id, operation, parameters)", "s_suppkey AS object_id",
                        "'facilities' AS object_type")


def metrics(spark, d):
    f = facility_nodes(spark, d, None)
    base = f.select(F.lit("facility").alias("entity_type"), F.col("facility_id").alias("id"))
    judged = scenario.judge(scenario.engine_changes(facility_log(spark, d)), base)
    return cut(analysis.evaluate_scenarios(
        roads(spark, d), f, zones_at(spark, d), scenario.resolve(judged, base),
        [0, 1, 2, 3, 4], threshold=120.0))


EVAL = (with_layers("facility", "zone").replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", {edge_sql()}, {AT}, {FAC_AT}, {ZONE_AT}, sc AS (SELECT unnest([0,1,2,3,4]) AS s),
 fsc AS (SELECT s, fs.facility_id, node, CASE WHEN (fs.facility_id+1)%5=s THEN 999e0 ELSE capacity END
 AS capacity FROM sc JOIN fs ON fs.facility_id%5<>s JOIN facility f ON f.id=fs.facility_id
 WHERE fs.type='hospital'), sp(s, node, c) USING KEY (s, node) AS (SELECT s, node, 0e0 FROM fsc
 GROUP BY 1,2 UNION SELECT sp.s, e.src, min(sp.c+e.t) FROM sp JOIN e ON e.dst=sp.node LEFT JOIN
 recurring.sp r ON r.s=sp.s AND r.node=e.src WHERE r.node IS NULL OR sp.c+e.t<r.c GROUP BY sp.s, e.src),
 ac AS (SELECT sc.s, zone_id, population, c FROM sc CROSS JOIN zs LEFT JOIN sp ON sp.s=sc.s AND
 sp.node=zs.node), m AS (SELECT s, round_even(sum(CASE WHEN c<=120 THEN population ELSE 0 END)
 /sum(population),4) AS coverage_ratio, round_even(sum(c*population)/sum(CASE WHEN c IS NOT NULL THEN
 population END),1) AS mean_travel_time, sum(CASE WHEN c<=120 THEN population ELSE 0e0 END) AS pw,
 sum(population)/1000 AS need FROM ac GROUP BY 1), h AS (SELECT s, sum(capacity) AS have FROM fsc
 GROUP BY 1)""")


@query(EVAL + """ SELECT CAST(s AS INTEGER) AS scenario_id, coverage_ratio, mean_travel_time, pw AS
 population_within_threshold, round_even(greatest(0,need-have),2) AS capacity_deficit FROM m
 JOIN h USING (s)""")
def evaluate_scenarios(spark, d):
    m = metrics(spark, d)
    return m.groupBy("scenario_id").pivot("metric", [
        "coverage_ratio", "mean_travel_time", "population_within_threshold",
        "capacity_deficit"]).agg(F.first("value"))


@query(EVAL + """, v AS (UNPIVOT (SELECT s, coverage_ratio, mean_travel_time,
 pw AS population_within_threshold, round_even(greatest(0,need-have),2) AS capacity_deficit FROM m JOIN h
 USING (s)) ON coverage_ratio, mean_travel_time, population_within_threshold, capacity_deficit
 INTO NAME metric VALUE v), g AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi,
 CASE metric WHEN 'coverage_ratio' THEN 0.25e0 WHEN 'mean_travel_time' THEN 0.20e0 WHEN
 'population_within_threshold' THEN 0.15e0 ELSE 0.08e0 END AS w FROM v WINDOW w AS (PARTITION BY metric)),
 n AS (SELECT *, CASE WHEN hi=lo THEN 0.5e0 WHEN metric IN ('mean_travel_time','capacity_deficit')
 THEN 1-(v-lo)/(hi-lo) ELSE (v-lo)/(hi-lo) END AS n FROM g), p AS (SELECT s, round_even(sum(n*w)/sum(w),6)
 AS overall_score, round_even(sum(w)/(SELECT sum(w) FROM (SELECT DISTINCT metric, w FROM g)),4) AS weight_coverage,
 CAST((SELECT count(DISTINCT metric) FROM g)-count(*) AS BIGINT) AS gaps FROM n GROUP BY s)
 SELECT CAST(s AS INTEGER) AS scenario_id, overall_score, weight_coverage, gaps, row_number() OVER (
 ORDER BY coalesce(overall_score,-1) DESC, s) AS rank FROM p""")
def compare_evaluated_scenarios(spark, d):
    """Ranking of the five evaluated plans."""
    return analysis.compare_scenarios(metrics(spark, d)).select(
        "scenario_id", "overall_score", "weight_coverage",
        F.size("missing_metrics").cast("bigint").alias("gaps"), "rank")


@query()
def resilience_analysis(spark, d):
    """Weak spots of the street network."""
    return analysis.network_resilience(edges(spark, d))


@query(REACH.replace("WITH RECURSIVE ", with_layers("facility").replace("WITH ", "WITH RECURSIVE ", 1)
                     + ", ", 1) + f""", {AT}, {FAC_AT}, big AS (SELECT l FROM lab GROUP BY l
 ORDER BY count(*) DESC LIMIT 1) SELECT facility_id FROM fs JOIN lab USING (node)
 WHERE l<>(SELECT l FROM big)""")
def facilities_off_main_network(spark, d):
    net = cut(edges(spark, d))
    nodes = network.nodes_of(net)
    at = network.snap(facility_nodes(spark, d, nodes), nodes, "facility_id")
    return traversal.off_main_network(cut(traversal.components(net)), at, "facility_id")


@query(SUMMARY + DELTAS.format(before="before", after="after"))
def simulate_hazards(spark, d):
    """Every hazard without and with measures, roads included."""
    out = analysis.simulate_hazards(
        layer(spark, d, "hazard").withColumnRenamed("id", "hazard_id"),
        buildings=boxes(spark, d, "building", extra=["population_estimate"]),
        zones=boxes(spark, d, "zone", "z_", ["population"]).withColumn(
            "z_population", F.col("z_population") * 1.0137), facilities=facility_boxes(spark, d),
        roads=street_lines(spark, d), measures=MEASURES)
    return out["comparison"]


@query()
def network_assignment(spark, d):
    """Zones to hospitals by travel time, while there is room."""
    f = facility_nodes(spark, d, None).withColumn("capacity", F.col("capacity") * 150)
    got, _ = analysis.facility_assignment(roads(spark, d), f, zones_at(spark, d), cutoff=300.0)
    return got.withColumn("travel_time_seconds", F.bround("travel_time_seconds", 1))


@query("""SELECT s_suppkey AS id, sha256(s_suppkey||'|'||CASE WHEN s_nationkey%2=0 THEN 'None' ELSE
 CAST(s_nationkey AS VARCHAR) END||'|car|0.1.0')[1:16] AS signature FROM supplier""")
def graph_signature(spark, d):
    s = table(spark, d, "supplier")
    version = F.when(F.col("s_nationkey") % 2 != 0, F.col("s_nationkey"))
    return s.select(F.col("s_suppkey").alias("id"), scalars.graph_signature(
        "s_suppkey", version, F.lit("car"), F.lit("0.1.0")).alias("signature"))
