"""Metrics of candidate parcels: people in reach, travel time, distance to the next
facility of the same type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import half_even
from ..session import cut
from .gridjoin import box_pairs
from .nearest import min_distance
from .network import nodes_of, reversed_edges, snap
from .overlay import BOX, pbox
from .traversal import relax


def population_in_reach(points: DataFrame, zones: DataFrame, radius: float, *, key: str,
                        method: str = "areal") -> DataFrame:
    """key, population within ``radius`` of each point; absent when nobody is.

    Zones with the same bounds are merged first. ``areal`` splits a zone by the share of
    its area inside the disc; zones without extent, and ``centroid``, count wholly when
    their middle is inside.
    """
    zb = pbox("z_")
    merged = zones.groupBy(*[F.col(c).alias("z_" + c) for c in BOX]).agg(
        F.sum(F.coalesce(F.col("population"), F.lit(0.0))).alias("_pop"))
    mx, my = (F.col("z_minx") + F.col("z_maxx")) / 2, (F.col("z_miny") + F.col("z_maxy")) / 2
    whole = F.when(g.in_disc(mx, my, "x", "y", F.lit(radius)), 1.0).otherwise(0.0)
    own = g.box_area(*zb)
    share = whole if method == "centroid" else F.when(own > 0, g.disc_area_in_box(
        "x", "y", F.lit(radius), zb) / own).otherwise(whole)
    pairs = box_pairs(points.select(key, "x", "y"), merged, ("x", "y", "x", "y"), zb,
                      margin=radius, condition=g.box_distance("x", "y", *zb) < radius)
    return pairs.groupBy(key).agg(F.sum(F.col("_pop") * share).alias("population"))


def mean_travel_time(times: DataFrame, *, key: str = "parcel_id", cost: str = "cost",
                     weight: str = "population", cutoff: float = 900.0) -> DataFrame:
    """Population-weighted mean time of the zones within the cutoff; the plain mean when
    all weights are 0; absent when no zone is in reach."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    near = times.where(F.col(cost) <= cutoff).groupBy(key).agg(
        F.sum(w).alias("_w"), F.sum(F.col(cost) * w).alias("_wt"), F.avg(cost).alias("_m"))
    return near.select(key, F.when(F.col("_w") > 0, F.col("_wt") / F.col("_w"))
                       .otherwise(F.col("_m")).alias("travel_time_mean"))


def network_time(points: DataFrame, zones: DataFrame, edges: DataFrame, cutoff: float, *,
                 key: str) -> DataFrame:
    """key, travel_time_mean: mean time over the network from the zones within ``cutoff`` seconds
    to each point, weighted by population (the plain mean when all weights are 0); absent when
    no zone is in reach.

    Points and zone middles take their nearest node. Zones are added up by node first, and one
    search a distinct node of the points runs backwards, all at once, so that rows are pairs of
    nodes within the cutoff, whatever the number of zones and points.
    """
    nodes = cut(nodes_of(edges))
    at = cut(snap(points.select(key, "x", "y"), nodes, key).select(key, "node"))
    people = F.coalesce(F.col("population"), F.lit(0.0))
    middle = zones.groupBy(((F.col("minx") + F.col("maxx")) / 2).alias("x"),
                           ((F.col("miny") + F.col("maxy")) / 2).alias("y")).agg(
        F.struct(F.sum(people).alias("w"), F.count(F.lit(1)).alias("n")).alias("_z"))
    load = snap(middle, nodes, "_z").groupBy("node").agg(F.sum("_z.w").alias("_w"),
                                                         F.sum("_z.n").alias("_n"))
    seeds = at.select(F.col("node").alias("_from"), "node").distinct().withColumn("cost", F.lit(0.0))
    reach = relax(reversed_edges(edges), seeds, by=["_from"], edge_by=[], cutoff=cutoff)
    sums = reach.join(load, "node").groupBy(F.col("_from").alias("node")).agg(
        F.sum("_w").alias("_w"), F.sum(F.col("cost") * F.col("_w")).alias("_wt"),
        F.sum("_n").alias("_n"), F.sum(F.col("cost") * F.col("_n")).alias("_nt"))
    mean = F.when(F.col("_w") > 0, F.col("_wt") / F.col("_w")).otherwise(F.col("_nt") / F.col("_n"))
    return at.join(sums, "node").select(key, mean.alias("travel_time_mean"))


def generate(parcels: DataFrame, zones: DataFrame | None, same_type: DataFrame | None, *,
             service_radius: float = 2000.0, times: DataFrame | None = None,
             edges: DataFrame | None = None, cutoff: float = 900.0, method: str = "areal",
             penalties: DataFrame | None = None) -> DataFrame:
    """One candidate per surviving parcel with the six scoring metrics.

    ``parcels``: id, bounds, area, slope, flood_risk; ``zones``: bounds, population;
    ``same_type``: id, x, y of existing facilities; ``times``: parcel_id, cost, population;
    without it ``edges``, a network to find the times on.
    """
    base = parcels.select(
        F.col("id").alias("parcel_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"), "area", "slope", "flood_risk")
    out = base
    if zones is not None:
        reach = population_in_reach(base, zones, service_radius, key="parcel_id",
                                    method=method)
        out = out.join(reach, "parcel_id", "left")
    else:
        out = out.withColumn("population", F.lit(0.0))
    if same_type is not None:
        sites = same_type.select(F.col("id").alias("_fid"), F.col("x").alias("rx"),
                                 F.col("y").alias("ry"))
        near = min_distance(base, sites, left_id="parcel_id", right_id="_fid",
                            name="_same").select("parcel_id", "_same")
        out = out.join(near, "parcel_id", "left")
    else:
        out = out.withColumn("_same", F.lit(None).cast("double"))
    if times is not None:
        out = out.join(mean_travel_time(times, cutoff=cutoff), "parcel_id", "left")
    elif edges is not None and zones is not None:
        out = out.join(network_time(base, zones, edges, cutoff, key="parcel_id"), "parcel_id", "left")
    else:
        out = out.withColumn("travel_time_mean", F.lit(None).cast("double"))
    if penalties is not None:
        out = out.join(penalties.select(F.col("id").alias("parcel_id"), "soft_penalty"),
                       "parcel_id", "left")
    else:
        out = out.withColumn("soft_penalty", F.lit(0.0))
    return out.select(
        F.concat(F.lit("cand-"), F.col("parcel_id").cast("string")).alias("candidate_id"),
        "parcel_id", "x", "y",
        half_even(F.coalesce("population", F.lit(0.0)), 2).alias("population_served"),
        half_even("travel_time_mean", 2).alias("travel_time_mean"),
        half_even("_same", 2).alias("distance_to_same_type"), "flood_risk", "slope",
        half_even("area", 2).alias("area"),
        F.coalesce("soft_penalty", F.lit(0.0)).alias("soft_penalty"))
