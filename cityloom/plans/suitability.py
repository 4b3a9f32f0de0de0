"""Site search: hard rules, candidate metrics, post rules, scoring, ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import candidates, constraints, mcda
from ..operators.overlay import BOX
from ..session import cut


@dataclass
class SiteSearch:
    """Result tables of one search. ``scored`` holds every candidate, unranked."""

    reports: DataFrame
    hits: DataFrame | None
    scored: DataFrame
    rejected: DataFrame
    records: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Requirements:
    facility_type: str = "hospital"
    required_area: float | None = 5000.0
    max_slope: float | None = 15.0
    max_flood_risk: float | None = 0.30
    allowed_zoning: Sequence[str] = ()
    allowed_status: Sequence[str] = ()
    max_travel_time: float | None = None
    min_distance_same_type: float | None = None
    service_radius: float = 2000.0
    travel_time_cutoff: float = 900.0
    top_n: int = 10
    method: str = "areal"


def site_suitability(parcels: DataFrame, req: Requirements, *,
                     constraint_layer: DataFrame | None = None,
                     zones: DataFrame | None = None, facilities: DataFrame | None = None,
                     times: DataFrame | None = None, edges: DataFrame | None = None,
                     profile: DataFrame | None = None, labels: DataFrame | None = None) -> SiteSearch:
    """``constraint_layer`` is ``c_``-prefixed (see ``constraint_hits``). ``profile`` is a profile table;
    else a planner's ``labels`` (label, weight), else the built-in one of the facility type.
    Travel times come from ``times`` (see ``candidates.generate``) or are found on ``edges``."""
    if profile is None:
        profile = (mcda.builtin_profile(parcels.sparkSession, req.facility_type) if labels is None
                   else mcda.planner_profile(labels, req.facility_type))
    parcels = parcels if "area" in parcels.columns else parcels.withColumn(
        "area", g.box_area(*BOX))
    hits = None if constraint_layer is None else constraints.constraint_hits(
        parcels.select("id", "area", *BOX), constraint_layer, key=["id"])
    reports = constraints.evaluate(
        parcels, key=["id"], hits=hits, min_area=req.required_area,
        max_slope=req.max_slope, max_flood_risk=req.max_flood_risk,
        allowed_zoning=req.allowed_zoning, allowed_status=req.allowed_status)
    # Reports feed the survivors, the penalties and the summary: computed once.
    reports = cut(reports)
    alive = constraints.survivors(parcels, reports)
    if edges is not None:
        alive = cut(alive)  # read for people, distances and times
    same = None if facilities is None else facilities.where(
        F.col("type") == req.facility_type).select("id", "x", "y")
    found = candidates.generate(alive, zones, same, service_radius=req.service_radius,
                                times=times, edges=edges, cutoff=req.travel_time_cutoff, method=req.method,
                                penalties=reports.select("id", "soft_penalty"))
    kept, rejected = constraints.post_rules(
        cut(found), max_travel_time=req.max_travel_time,
        min_distance_same_type=req.min_distance_same_type)
    scored = cut(mcda.score(kept, profile, "soft_penalty"))
    records = mcda.rank(scored, top_n=req.top_n)
    parcels_n = reports.agg(F.count(F.lit(1)).alias("parcels_evaluated"),
                            F.count_if(~F.col("passed")).alias("_bad"))
    late = rejected.agg(F.count(F.lit(1))).scalar()
    made = scored.agg(F.count(F.lit(1))).scalar()
    best = scored.agg(F.max("score")).scalar()
    summary = parcels_n.select(
        "parcels_evaluated", (F.col("_bad") + late).alias("parcels_rejected"),
        made.alias("candidates_generated"),
        F.least(made, F.lit(req.top_n).cast("long")).alias("candidates_returned"),
        best.alias("best_score"))
    return SiteSearch(reports, hits, scored, rejected, records, summary)


def median_score(search: SiteSearch) -> DataFrame:
    """Score of the middle candidate (element n // 2 of the descending order)."""
    return mcda.middle_score(mcda.rank(search.scored))
