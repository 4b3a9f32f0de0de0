"""Composed analyses: what a planner runs in one go.

Layers are DataFrames in the vocabulary of the operators. Scenarios, hazard runs and
regions are key columns, so variants share the jobs instead of repeating them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (ACCESS_THRESHOLD_SECONDS, HAZARDS, RESPONSE_TARGET_SECONDS)
from ..operators import (aggregation, comparison, exposure, nearest, network, scenario,
                         scorecard, selection, traversal)
from ..session import cut
from . import response


def zone_access(edges: DataFrame, facilities: DataFrame, zones: DataFrame, *,
                by: Sequence[str] = ()) -> DataFrame:
    """Zones with the time to their nearest facility. ``edges`` are shared by the runs;
    ``facilities`` (facility_id, x, y) and ``zones`` (zone_id, x, y, population) carry the
    run keys ``by``."""
    at = _snapped(edges, facilities, zones)
    fac = facilities.join(at, ["x", "y"]).select(*by, "node")
    org = zones.join(at, ["x", "y"]).select(*by, "zone_id", "node")
    times = traversal.nearest_time(edges, org, fac, origin_key="zone_id", by=by, edge_by=())
    return aggregation.zone_access(zones, times, by=by)


def _snapped(edges: DataFrame, *layers: DataFrame) -> DataFrame:
    """``x, y, node``: positions repeat between layers and runs, each is snapped once."""
    spots = reduce(DataFrame.unionByName, [df.select("x", "y") for df in layers])
    spots = cut(spots.distinct().withColumn("spot", F.struct("x", "y")))
    got = network.snap(spots, cut(network.nodes_of(edges)), "spot")
    return cut(got.select("spot.x", "spot.y", "node"))


def accessibility(roads: DataFrame, facilities: DataFrame, zones: DataFrame, *,
                  facility_type: str | None = "hospital", mode: str = "car",
                  threshold: float = ACCESS_THRESHOLD_SECONDS,
                  by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(zone records, summary)."""
    fac = facilities if facility_type is None else facilities.where(
        F.col("type") == facility_type)
    acc = cut(zone_access(cut(network.build_edges(roads, mode)), fac, zones, by=by))
    return aggregation.access_records(acc, threshold), aggregation.access_summary(
        acc, threshold, by)


def emergency_coverage(roads: DataFrame, facilities: DataFrame, zones: DataFrame,
                       seconds: float = RESPONSE_TARGET_SECONDS) -> DataFrame:
    """Zones and people outside the response time of the fire stations."""
    fac = facilities.where("type = 'fire_station'")
    acc = zone_access(cut(network.build_edges(roads, "emergency")), fac, zones)
    return aggregation.response_gap(acc, seconds)


def facility_assignment(roads: DataFrame, facilities: DataFrame, zones: DataFrame,
                        facility_type: str = "hospital", respect_capacity: bool = True,
                        cutoff: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(zone assignments, facility loads) by travel time."""
    net = cut(network.build_edges(roads))
    fac = facilities.where(F.col("type") == facility_type)
    at = _snapped(net, fac, zones)
    f_at = cut(fac.join(at, ["x", "y"]).select("facility_id", "node"))
    z_at = cut(zones.join(at, ["x", "y"]).select("zone_id", "node"))
    # Facilities are few: search backwards from them, one search each.
    times = traversal.travel_times(network.reversed_edges(net), f_at, z_at,
                                   origin_key="facility_id", dest_key="zone_id", cutoff=cutoff)
    pairs = times.select(F.col("zone_id").alias("zone"), F.col("facility_id").alias("facility"),
                         "cost")
    sites = fac.select(F.col("facility_id").alias("facility"), "capacity", F.col("x").alias("rx"), F.col("y").alias("ry"))
    got = cut(selection.assign_with_capacity(
        pairs, zones.select(F.col("zone_id").alias("zone"), "population"), sites,
        respect_capacity))
    return got, selection.facility_loads(got, sites)


def demand_by_horizon(zones: DataFrame, facilities: DataFrame, facility_types: Sequence[str],
                      years: Sequence[int], annual_rate: float) -> DataFrame:
    """Required against installed capacity for each number of years from now (a key column), so all
    horizons share the jobs."""
    ahead = F.explode(F.array(*[F.lit(y) for y in years])).alias("years")
    grown = zones.select("population", ahead).withColumn("population", F.coalesce(
        "population", F.lit(0.0)) * F.pow(F.lit(1.0 + annual_rate), F.col("years")))
    return aggregation.demand_vs_capacity(grown, facilities.select("type", "capacity", ahead),
                                          facility_types, ["years"])


def network_resilience(edges: DataFrame) -> DataFrame:
    """Components, weak spots and average degree of a road network, in one row."""
    edges = cut(edges)
    bridges, nodes = traversal.cut_structure(edges)
    weak = traversal.resilience(edges, cut(bridges), cut(nodes))
    comp = traversal.component_summary(traversal.components(edges))
    one = F.lit(1).alias("_one")
    return (traversal.degree_summary(edges).withColumn("_one", one)
            .join(comp.withColumn("_one", one), "_one")
            .join(weak.withColumn("_one", one), "_one").drop("_one"))


# ---------------------------------------------------------------------- scenarios
def evaluate_scenarios(roads: DataFrame, facilities: DataFrame, zones: DataFrame,
                       resolved: DataFrame, scenario_ids: Sequence, *,
                       facility_type: str = "hospital",
                       threshold: float = ACCESS_THRESHOLD_SECONDS,
                       dataset_version: int = 1) -> DataFrame:
    """Long metrics of the standard battery for all given scenarios at once."""
    by = ["scenario_id"]
    fac = cut(scenario.apply_to_base(
        facilities, resolved, "facility", scenario_ids,
        {"type": "string", "capacity": "double"}, key="facility_id"))
    zon = zones.withColumn("scenario_id", F.explode(F.array(*[F.lit(s) for s in scenario_ids])))
    _, acc = accessibility(roads, fac, zon, facility_type=facility_type, threshold=threshold,
                           by=by)
    dem = aggregation.demand_vs_capacity(zon, fac, [facility_type], by)
    parts = []
    for seq, (df, names) in enumerate((
            (acc, ("coverage_ratio", "mean_travel_time", "population_within_threshold")),
            (dem, ("capacity_deficit", "required_capacity", "installed_capacity")))):
        parts.append(exposure.metric_rows(df, by, names).withColumn("seq", F.lit(seq)))
    return parts[0].unionByName(parts[1]).withColumn("dataset_version", F.lit(dataset_version))


def compare_scenarios(metrics: DataFrame, names: DataFrame | None = None) -> DataFrame:
    ranked = comparison.rank_plans(comparison.compare_plans(metrics))
    return ranked if names is None else comparison.with_names(ranked, names)


# ------------------------------------------------------------------------ hazards
def simulate_hazards(events: DataFrame, *, buildings: DataFrame, zones: DataFrame,
                     facilities: DataFrame, roads: DataFrame,
                     measures: Sequence[str]) -> dict[str, DataFrame]:
    """Each event without and with measures: summary, comparison, road effects."""
    key = ["hazard_id", "run"]
    runs = F.explode(F.array(
        F.struct(F.lit("base").alias("run"), F.array().cast("array<string>").alias("measures")),
        F.struct(F.lit("mitigated").alias("run"),
                 F.array(*[F.lit(m) for m in measures]).cast("array<string>").alias("measures"))))
    h = cut(exposure.build_hazards(events.withColumn("_r", runs).select("*", "_r.*").drop("_r")))
    closed = cut(exposure.hazard_roads(h, roads, key))
    summary = cut(exposure.hazard_summary(
        h, key, buildings=exposure.hazard_hits(h, buildings),
        zones=exposure.hazard_population(h, zones, key),
        facilities=exposure.hazard_hits(h, facilities, ("f_minx", "f_miny", "f_maxx", "f_maxy")),
        roads=closed))
    rows = exposure.metric_rows(summary, key)
    return {"hazards": h, "roads": closed, "summary": summary,
            "comparison": comparison.run_deltas(rows, "base", "mitigated", by=["hazard_id"],
                                                digits=2, pct_digits=1, zero_pct=0.0)}


def hazard_response(edges: DataFrame, closed: DataFrame, hazard: DataFrame,
                    stations: DataFrame) -> DataFrame:
    """First responder to one event on the free network, during it, and with measures.
    ``hazard``: its rows by run; stations: station_id, type, x, y."""
    kind, *place = hazard.select("hazard_type", "cx", "cy").head()
    responder = HAZARDS.get(kind, HAZARDS["fire"])[4]
    runs = edges.withColumn("run", F.explode(F.array(
        F.lit("normal"), F.lit("base"), F.lit("mitigated"))))
    net = cut(network.degrade(runs, closed.select("run", "road_id", "effect"), 3.0, ["run"]))
    core = cut(response.cores(net, ["run"], ["normal", "base", "mitigated"]))
    incident = edges.sparkSession.createDataFrame([(0, *place)], "incident_id int, x double, y double")
    at = cut(response.snap_per_run(incident, core, "incident_id", ["run"]))
    mine = stations.where(F.col("type") == responder)
    return response.ranked(response.responses(net, core, at, mine, by=["run"]), 1, ["run"])


# ------------------------------------------------------------------- optimisation
def optimize_locations(sites: DataFrame, demand: DataFrame, p: int, *,
                       objective: str = "max_coverage", max_cost: float = 15000.0
                       ) -> tuple[DataFrame, DataFrame]:
    """(chosen sites, metrics). ``sites``: candidate, rx, ry; ``demand``: demand, x, y,
    weight. Only pairs within ``max_cost`` metres exist, so the table stays sparse."""
    pairs = cut(nearest.distance_pairs(demand.select("demand", "x", "y"), sites, max_cost)
                .select("demand", "candidate", "cost"))
    who, cands = demand.select("demand", "weight"), sites.select("candidate")
    selection.check_costs(pairs, who, cands, p)
    if objective == "max_coverage":
        chosen = selection.greedy_max_coverage(pairs, who, cands, p, max_cost)
        return chosen, selection.coverage_metrics(pairs, who, chosen, max_cost)
    chosen = selection.greedy_p_median(pairs, who, cands, p)
    return chosen, selection.assignment_metrics(
        selection.assign_nearest(pairs, who, chosen), who)


# --------------------------------------------------------------------- scorecards
def development_packages(scored: DataFrame, variants: DataFrame, *, max_actions: int = 12
                         ) -> dict[str, DataFrame]:
    """Packages per region and variant (``variant, priorities, target_uplift, budget``),
    their comparison, and the cheapest per point."""
    by = ["region", "variant"]
    # Variants are a handful of rows chosen by the planner.
    tagged = scored.withColumn("_k", F.lit(1)).join(
        F.broadcast(variants.withColumn("_k", F.lit(1))), "_k").drop("_k")
    chosen = cut(scorecard.packages(
        scorecard.gaps(tagged, by), scorecard.remedies(scored.sparkSession), by,
        target_uplift=F.col("target_uplift"), budget=F.col("budget"), max_actions=max_actions))
    rows, best = scorecard.compare_packages(scorecard.package_summary(chosen, by), ["region"])
    return {"actions": scorecard.package_actions(chosen, by), "comparison": rows,
            "recommended": best}
