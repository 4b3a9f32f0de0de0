"""Zone statistics, coverage, accessibility, demand and population summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ACCESS_THRESHOLD_SECONDS, SERVICE_STANDARDS
from ..functions.scalars import half_even, lookup, ratio
from .overlay import BOX, containers_of, coverage, population_within

STATISTICS = {"sum": F.sum, "count": F.count, "mean": F.avg, "max": F.max, "min": F.min}


def aggregate_by_zone(features: DataFrame, zones: DataFrame, *, feature_key: str,
                      zone_key: str, zone_box=BOX, xy=("x", "y"), value: Column | None = None,
                      statistics: dict[str, str] | None = None,
                      rings: str | None = None) -> DataFrame:
    """Each feature point counts in one zone (lowest id when several hold it); zones
    without features get 0.0 for every statistic."""
    statistics = statistics or {"value": "sum"}
    unknown = set(statistics.values()) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistic: {sorted(unknown)}")
    v = F.lit(1.0) if value is None else value
    points = features.select(feature_key, *xy, v.cast("double").alias("_v"))
    shape = [zone_key, *zone_box] + ([rings] if rings else [])
    pairs = containers_of(points, zones.select(*dict.fromkeys(shape)), xy, zone_box,
                          rings=rings)
    home = pairs.groupBy(feature_key).agg(F.min(zone_key).alias(zone_key),
                                          F.first("_v").alias("_v"))
    stats = home.groupBy(zone_key).agg(*[
        STATISTICS[s]("_v").cast("double").alias(n) for n, s in statistics.items()])
    return zones.select(zone_key).join(stats, zone_key, "left").select(
        zone_key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in statistics])


def coverage_summary(areas: DataFrame, zones: DataFrame, area_box, zone_box,
                     population: str) -> DataFrame:
    """served, total and clamped ratio for one served area given as disjoint pieces."""
    served = population_within(areas.withColumn("_one", F.lit(1)), zones, area_box, zone_box,
                               area_key=["_one"], population=population)
    total = zones.agg(F.sum(population)).scalar()
    whole = F.coalesce(total, F.lit(0.0))
    got = served.agg(F.coalesce(F.sum("population"), F.lit(0.0)).alias("s"))
    return got.select(F.round("s", 2).alias("served"), F.round(whole, 2).alias("total"),
                      F.round(coverage(F.col("s"), whole), 4).alias("ratio"))


# ---------------------------------------------------------------- accessibility
def zone_access(zones: DataFrame, pairs: DataFrame, *, zone_key: str = "zone_id",
                cost: str = "cost", by: Sequence[str] = ()) -> DataFrame:
    """Every zone with its cheapest reachable facility (NULL when there is none)."""
    best = pairs.groupBy(*by, zone_key).agg(F.min(cost).alias("best"))
    return zones.join(best, [*by, zone_key], "left")


def access_records(access: DataFrame, threshold: float = ACCESS_THRESHOLD_SECONDS) -> DataFrame:
    return access.withColumns({
        "nearest_facility_seconds": half_even("best", 1),
        "within_threshold": F.coalesce(F.col("best") <= threshold, F.lit(False))})


def access_summary(access: DataFrame, threshold: float = ACCESS_THRESHOLD_SECONDS,
                   by: Sequence[str] = ()) -> DataFrame:
    """Population-weighted accessibility; one row per run."""
    pop = F.coalesce(F.col("population"), F.lit(0.0))
    out = access.groupBy(*by).agg(
        F.sum(pop).alias("_total"),
        F.sum(F.when(F.col("best") <= threshold, pop).otherwise(0.0)).alias("_served"),
        F.sum(F.when(F.col("best").isNull(), pop).otherwise(0.0)).alias("_lost"),
        F.sum(F.when(F.col("best").isNotNull(), F.col("best") * pop).otherwise(0.0))
        .alias("_weighted"))
    reachable = F.col("_total") - F.col("_lost")
    return out.select(
        *by, half_even("_total", 1).alias("population_total"),
        half_even("_served", 1).alias("population_within_threshold"),
        F.coalesce(half_even(ratio(F.col("_served"), F.col("_total")), 4), F.lit(0.0))
        .alias("coverage_ratio"),
        half_even(F.when(reachable > 0, F.col("_weighted") / reachable), 1)
        .alias("mean_travel_time"),
        half_even("_lost", 1).alias("population_unreachable"),
        F.lit(float(threshold)).alias("threshold"))


def response_gap(access: DataFrame, threshold: float = 480.0, by: Sequence[str] = ()) -> DataFrame:
    """Zones that cannot be reached inside the response time."""
    out = F.coalesce(F.col("best") > threshold, F.lit(True))
    return access.groupBy(*by).agg(
        F.count_if(out).alias("zones_outside_response_time"),
        half_even(F.sum(F.when(out, F.coalesce("population", F.lit(0.0))).otherwise(0.0)), 1)
        .alias("population_outside_response_time"))


# ------------------------------------------------------------- demand, projection
def with_projection(zones: DataFrame, projected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Projected population where there is one, else the current one."""
    return zones.join(projected.select(*key, F.col("population_projected").alias("_p")),
                      list(key), "left").withColumn(
        "population", F.coalesce("_p", "population", F.lit(0.0))).drop("_p")


def required_capacity(population: Column, facility_type: Column | str) -> Column:
    rates = {k: v[0] for k, v in SERVICE_STANDARDS.items()}
    t = F.lit(facility_type) if isinstance(facility_type, str) else facility_type
    return population / 1000.0 * lookup(rates, t)


def zone_demand(zones: DataFrame, facility_type: str) -> DataFrame:
    pop = F.coalesce(F.col("population"), F.lit(0.0))
    return zones.withColumns({
        "required_capacity": half_even(required_capacity(pop, facility_type), 2),
        "population": half_even(pop, 1)})


def demand_vs_capacity(zones: DataFrame, facilities: DataFrame, facility_types: Sequence[str],
                       by: Sequence[str] = ()) -> DataFrame:
    """Required against installed capacity, one row per run and facility type that has
    a service standard."""
    known = [t for t in facility_types if t in SERVICE_STANDARDS]
    pop = zones.groupBy(*by).agg(F.sum(F.coalesce(F.col("population"), F.lit(0.0))).alias("_pop"))
    have = facilities.where(F.col("type").isin(known)).groupBy(*by, "type").agg(
        F.sum(F.coalesce(F.col("capacity"), F.lit(0.0))).alias("_have"),
        F.count(F.lit(1)).alias("_n"))
    grid = pop.withColumn("type", F.explode(F.array(*[F.lit(t) for t in known])))
    df = grid.join(have, [*by, "type"], "left").fillna(0, ["_have", "_n"])
    need = required_capacity(F.col("_pop"), F.col("type"))
    units = {k: v[1] for k, v in SERVICE_STANDARDS.items()}
    installed = F.col("_have")
    return df.select(
        *by, F.col("type").alias("facility_type"), lookup(units, F.col("type")).alias("unit"),
        half_even("_pop", 1).alias("population_served_basis"),
        half_even(need, 2).alias("required_capacity"),
        half_even(installed, 2).alias("installed_capacity"),
        half_even(F.greatest(F.lit(0.0), need - installed), 2).alias("capacity_deficit"),
        half_even(F.greatest(F.lit(0.0), installed - need), 2).alias("capacity_surplus"),
        half_even(F.when(installed > 0, need / installed), 4).alias("utilization_ratio"),
        F.col("_n").cast("long").alias("facilities_counted"))


def project_population(zones: DataFrame, years: int, annual_rate: float = 0.02, *,
                       rate: str | None = None, ceiling: str | None = None,
                       area_m2: Column | None = None) -> DataFrame:
    """Compound growth per zone, with its own rate and ceiling where given."""
    if years < 0:
        return zones.limit(0)
    p0 = F.coalesce(F.col("population"), F.lit(0.0))
    r = F.lit(float(annual_rate)) if rate is None else F.coalesce(
        F.col(rate), F.lit(float(annual_rate)))
    grown = p0 * F.pow(1.0 + r, F.lit(float(years)))
    cap = F.lit(None).cast("double") if ceiling is None else F.col(ceiling)
    capped = F.coalesce(grown > cap, F.lit(False))
    p1 = F.when(capped, cap).otherwise(grown)
    out = zones.withColumns({"_p0": p0, "_p1": p1, "_r": r, "capacity_capped": capped})
    area = (F.lit(None).cast("double") if area_m2 is None else area_m2 / 1e6)
    return out.withColumns({
        "population_base": half_even("_p0", 1), "population_projected": half_even("_p1", 1),
        "absolute_growth": half_even(F.col("_p1") - F.col("_p0"), 1),
        "growth_ratio": half_even(F.when(F.col("_p0") > 0, F.col("_p1") / F.col("_p0")), 4),
        "annual_rate": F.col("_r"),
        "density_projected": half_even(F.when(area > 0, F.col("_p1") / area), 1)})


def projection_totals(projected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = projected.groupBy(*by).agg(F.sum("_p0").alias("b"), F.sum("_p1").alias("p"))
    return out.select(
        *by, half_even("b", 1).alias("population_base"),
        half_even("p", 1).alias("population_projected"),
        half_even(F.col("p") - F.col("b"), 1).alias("absolute_growth"),
        half_even(ratio(F.col("p"), F.col("b")), 4).alias("growth_ratio"))


# ------------------------------------------------------------------- inventories
def extent(*layers: DataFrame, box=BOX) -> DataFrame:
    """Bounds of the union of several layers."""
    parts = [df.select(*[F.col(c).alias(n) for c, n in zip(box, BOX)]) for df in layers]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                   F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, n; empty layers count 0."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n")
             for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def total_population(zones: DataFrame) -> DataFrame:
    return zones.agg(F.coalesce(F.sum("population"), F.lit(0.0)).alias("population"))


def headline(bounds: DataFrame, population: Column) -> DataFrame:
    """City card: extent centre, rough area in km2, people and households."""
    dx, dy = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return bounds.select(
        ((F.col("minx") + F.col("maxx")) / 2).alias("center_lon"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("center_lat"),
        half_even(F.abs(dx * 111.0 * dy * 105.0), 2).alias("area_km2"),
        population.cast("long").alias("population"),
        (population / 4.5).cast("long").alias("households"))
