"""Attribute and spatial rules with recorded reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LANE_CAPACITY, LANE_WIDTH_M, ROAD_SPEEDS, SEVERITY, SEVERITY_WEIGHT
from ..functions import geometry as g
from ..functions.scalars import half_even, lookup
from ..session import written
from . import sweep
from .gridjoin import box_pairs
from .overlay import BOX, pbox

VERDICT = "struct<rule:string,threshold:string,observed:string,severity:string>"


def severity_of(word: Column | str) -> Column:
    """Stored severity word -> hard / soft. A missing word counts as HIGH."""
    w = F.upper(F.coalesce(F.col(word) if isinstance(word, str) else word, F.lit("HIGH")))
    return lookup(SEVERITY, w, "hard")


def weight_of(word: Column | str) -> Column:
    w = F.upper(F.coalesce(F.col(word) if isinstance(word, str) else word, F.lit("HIGH")))
    return lookup(SEVERITY_WEIGHT, w, 1.0)


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def verdict(rule: str | Column, threshold, observed, severity="hard") -> Column:
    return F.struct(_text(rule).alias("rule"), _text(threshold).alias("threshold"),
                    _text(observed).alias("observed"), _text(severity).alias("severity"))


def attribute_rules(*, area: str = "area", min_area: float | None = None,
                    max_slope: float | None = None, max_flood_risk: float | None = None,
                    allowed_zoning: Sequence[str] = (), allowed_status: Sequence[str] = (),
                    slope: str = "slope", flood_risk: str = "flood_risk",
                    zoning: str = "zoning", status: str = "status"
                    ) -> tuple[Column, Column]:
    """(failed, satisfied) verdict arrays. Limits include their bound; a NULL slope or
    flood risk skips its rule, a NULL zoning or status fails it."""
    checks: list[tuple[Column, Column]] = []  # (passes or NULL to skip, verdict)
    if min_area is not None:
        checks.append((F.col(area) >= min_area,
                       verdict("min_area", min_area, half_even(area, 2))))
    if max_slope is not None:
        checks.append((F.col(slope) <= max_slope,
                       verdict("max_slope", max_slope, F.col(slope))))
    if max_flood_risk is not None:
        checks.append((F.col(flood_risk) <= max_flood_risk,
                       verdict("max_flood_risk", max_flood_risk, F.col(flood_risk))))
    if allowed_zoning:
        checks.append((F.coalesce(F.col(zoning).isin(list(allowed_zoning)), F.lit(False)),
                       verdict("allowed_zoning", ",".join(allowed_zoning), F.col(zoning))))
    if allowed_status:
        checks.append((F.coalesce(F.col(status).isin(list(allowed_status)), F.lit(False)),
                       verdict("allowed_development_status", ",".join(allowed_status),
                               F.col(status))))
    empty = F.array().cast(f"array<{VERDICT}>")

    def gather(want: bool) -> Column:
        if not checks:
            return empty
        return F.array_compact(F.array(*[
            F.when(ok if want else ~ok, v) for ok, v in checks]))
    return gather(False), gather(True)


def constraint_hits(parcels: DataFrame, constraints: DataFrame, *, key: Sequence[str],
                    area: str = "area", rings: bool = False, **kw) -> DataFrame:
    """Parcel x constraint pairs that meet, with the share of the parcel covered.

    ``parcels``: key, area, bounds (and ``rings``); ``constraints``: ``c_``-prefixed
    ``c_type, c_severity, c_weight, c_buffer`` and bounds (and ``c_rings``). The share is that of
    the buffered constraint, whose ``c_id`` is unique if there are rings.
    """
    cb = pbox("c_")
    buffer = F.coalesce(F.col("c_buffer"), F.lit(0.0))
    if rings:
        meets = F.when(buffer > 0, g.shape_distance("c_rings", "rings") <= buffer).otherwise(
            g.intersects("rings", "c_rings"))
        shared = F.coalesce("_shared", F.lit(0.0))
    else:
        meets = g.box_box_distance(cb, BOX) <= buffer
        shared = F.when(buffer > 0, g.ring_area_in_box(g.buffered_box_ring(
            *cb, buffer), BOX)).otherwise(g.box_overlap(BOX, cb))
    pairs = box_pairs(constraints, parcels, cb, BOX, margin=buffer, condition=meets, **kw)
    if rings:
        pair = [*key, "c_id"]
        pairs = written(pairs.select(*pair, "c_type", "c_severity", "c_weight", area, buffer.alias("_d"), "c_rings",
                                     F.col("rings").alias("_own"), *[F.col(b).alias(w) for b, w in zip(BOX, sweep.WINDOW)]))
        # Only shapes that meet are grown, and only the parts near the parcel are laid over it.
        grown = sweep.buffer_shapes(pairs.select(*pair, F.col("c_rings").alias("_other"), "_d", *sweep.WINDOW), "_other", F.col("_d"))
        x0, y0, x1, y1 = (F.col(c) for c in sweep.WINDOW)
        near = (F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0)
        covered = sweep.shared_areas(pairs, grown.where(near), pair).withColumnRenamed("area", "_shared")
        pairs = pairs.join(covered.hint("merge"), pair, "left")
    overlap = F.when(F.col(area) > 0, shared / F.col(area)).otherwise(F.lit(0.0))
    return pairs.select(*key, "c_id", "c_type", "c_severity", "c_weight",
                        overlap.alias("overlap"))


def evaluate(parcels: DataFrame, constraints: DataFrame | None = None, *,
             key: Sequence[str] = ("id",), hits: DataFrame | None = None,
             rings: bool = False, **rules) -> DataFrame:
    """One report per parcel: ``passed``, the attribute verdicts ``failed`` and
    ``satisfied``, ``hard_hits``, ``soft_hits`` and ``soft_penalty``.

    Spatial reasons stay rows (:func:`reasons`), because one parcel may meet any number
    of constraints; here they are only counted and summed.
    """
    failed, satisfied = attribute_rules(**rules)
    base = parcels.select(*key, failed.alias("failed"), satisfied.alias("satisfied"))
    if hits is None and constraints is not None:
        hits = constraint_hits(parcels, constraints, key=key, rings=rings)
    if hits is not None:
        hard = F.col("c_severity") == "hard"
        spatial = hits.groupBy(*key).agg(
            F.count_if(hard).alias("hard_hits"), F.count_if(~hard).alias("soft_hits"),
            F.sum(F.when(~hard, F.col("c_weight") * F.col("overlap"))).alias("_soft"))
        base = base.join(spatial, list(key), "left")
    else:
        base = base.withColumns({"hard_hits": F.lit(0), "soft_hits": F.lit(0),
                                 "_soft": F.lit(0.0)})
    n = F.coalesce("hard_hits", F.lit(0)).cast("long")
    return base.select(
        *key, ((F.size("failed") == 0) & (n == 0)).alias("passed"), "failed", "satisfied",
        n.alias("hard_hits"), F.coalesce("soft_hits", F.lit(0)).cast("long").alias("soft_hits"),
        half_even(F.coalesce("_soft", F.lit(0.0)), 6).alias("soft_penalty"))


def reasons(reports: DataFrame, hits: DataFrame | None, key: Sequence[str] = ("id",)) -> DataFrame:
    """Every failed rule as a row: ``rule, threshold, observed, severity``."""
    rows = reports.select(*key, F.explode("failed").alias("v")).select(*key, "v.*")
    if hits is None:
        return rows
    hard = F.col("c_severity") == "hard"
    v = verdict(F.concat(F.lit("constraint:"), F.col("c_type")),
                F.when(hard, F.lit("no overlap")).otherwise("prefer no overlap"),
                half_even("overlap", 4), F.col("c_severity"))
    return rows.unionByName(hits.select(*key, v.alias("v")).select(*key, "v.*"))


def survivors(parcels: DataFrame, reports: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    return parcels.join(reports.where("passed").select(*key), list(key), "left_semi")


def committed(features: DataFrame, reports: DataFrame, key: Sequence[str]) -> DataFrame:
    """Data side of a commit gate: only features whose validation passed."""
    return features.join(reports.where("passed").select(*key), list(key), "left_semi")


def post_rules(candidates: DataFrame, *, max_travel_time: float | None = None,
               min_distance_same_type: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with the first failing rule). NULL metrics pass."""
    reject = F.lit(None).cast(VERDICT)
    if min_distance_same_type is not None:
        reject = F.when(F.col("distance_to_same_type") < min_distance_same_type, verdict(
            "min_distance_same_type", min_distance_same_type,
            F.col("distance_to_same_type"))).otherwise(reject)
    if max_travel_time is not None:
        reject = F.when(F.col("travel_time_mean") > max_travel_time, verdict(
            "max_travel_time", max_travel_time, F.col("travel_time_mean"))).otherwise(reject)
    tagged = candidates.withColumn("reject", reject)
    return (tagged.where(F.col("reject").isNull()).drop("reject"),
            tagged.where(F.col("reject").isNotNull()))


# ----------------------------------------------------------------- road alignments
def validate_alignments(lines: DataFrame, constraints: DataFrame, buildings: DataFrame, *,
                        key: str = "alignment_id", min_length: float = 10.0) -> DataFrame:
    """Proposed road lines (``rings`` = one line) against constraints and buildings.

    ``constraints``: ``c_severity, c_weight, c_rings``; ``buildings``: ``b_id, b_rings``.
    A hard crossing fails the line and its crossing length is summed; a soft one adds its
    full weight; displaced buildings are counted (:func:`displaced_buildings` has their ids).
    """
    lines = lines.withColumns({c: g.bounds("rings")[c] for c in BOX})
    cons = constraints.withColumns({f"c_{c}": g.bounds("c_rings")[c] for c in BOX})
    hard = F.col("c_severity") == "hard"
    crossed = box_pairs(lines, cons, BOX, pbox("c_"),
                        condition=g.intersects("rings", "c_rings")).groupBy(key).agg(
        F.count_if(hard).alias("_hard"),
        F.sum(F.when(hard, length_inside("rings", "c_rings"))).alias("_crossed"),
        F.sum(F.when(~hard, F.col("c_weight"))).alias("_soft"))
    counts = displaced_buildings(lines.select(key, "rings"), buildings, key=key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    whole, simple = g.length("rings"), g.is_simple("rings")
    df = lines.join(crossed, key, "left").join(counts, key, "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    hits = F.coalesce("_hard", F.lit(0)).cast("long")
    failed = F.array_compact(F.array(
        F.when(whole < min_length, verdict("min_length", min_length, half_even(whole, 2))),
        F.when(~simple, verdict("self_intersection", "none", "alignment self-intersects")),
        F.when(n > 0, verdict("building_displacement", 0, n, "soft"))))
    return df.select(
        key, ((whole >= min_length) & simple & (hits == 0)).alias("passed"),
        failed.alias("failed"), half_even(whole, 2).alias("length_m"),
        hits.alias("hard_crossings"),
        half_even(F.coalesce("_crossed", F.lit(0.0)), 2).alias("hard_crossing_m"),
        half_even(F.coalesce("_soft", F.lit(0.0)), 6).alias("soft_penalty"),
        n.alias("buildings_displaced"))


def displaced_buildings(lines: DataFrame, buildings: DataFrame, *,
                        key: str = "alignment_id") -> DataFrame:
    """``key, b_id``: a row for every building that a line crosses."""
    lines = lines.withColumns({c: g.bounds("rings")[c] for c in BOX})
    blds = buildings.withColumns({f"b_{c}": g.bounds("b_rings")[c] for c in BOX})
    return box_pairs(lines, blds, BOX, pbox("b_"),
                     condition=g.intersects("rings", "b_rings")).select(key, "b_id")


def length_inside(line, polygon) -> Column:
    """Length of a line inside a polygon: cut each piece at the boundary, keep the pieces
    whose middle is inside."""
    def pieces(e):
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]

        def at(f):
            fx, fy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
            den = ex * fy - ey * fx
            t = ((f["a"]["x"] - e["a"]["x"]) * fy - (f["a"]["y"] - e["a"]["y"]) * fx) / den
            return F.when(den != 0, t)
        cuts = F.filter(F.transform(g.all_edges(polygon), at), lambda t: (t > 0) & (t < 1))
        ts = F.array_sort(F.array_distinct(F.concat(
            F.array(F.lit(0.0)), F.coalesce(cuts, F.array().cast("array<double>")),
            F.array(F.lit(1.0)))))
        span = g.let(ts, lambda a: F.zip_with(
            F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1),
            lambda s, t: F.when(g.covers_point(
                polygon, e["a"]["x"] + (s + t) / 2 * ex, e["a"]["y"] + (s + t) / 2 * ey),
                t - s).otherwise(F.lit(0.0))))
        return F.aggregate(span, F.lit(0.0), lambda a, v: a + v) * F.hypot(ex, ey)
    return F.aggregate(F.transform(g.all_edges(line), pieces), F.lit(0.0),
                       lambda a, v: a + v)


def road_attributes(road_class: str = "road_class", lanes: str = "lanes",
                    speed: str = "speed") -> dict[str, Column]:
    """Derived columns of a road drawn by a planner."""
    return {"width": F.col(lanes) * LANE_WIDTH_M,
            "speed": F.coalesce(F.when(F.col(speed) != 0, F.col(speed)).cast("double"),
                                lookup(ROAD_SPEEDS, F.col(road_class), 30.0)),
            "capacity": F.col(lanes) * lookup(LANE_CAPACITY, F.col(road_class), 600.0)}


def sanity_checks(df: DataFrame, *, score: str = "site_score", cost: str = "estimated_cost",
                  minutes: str = "travel_time_minutes") -> DataFrame:
    """APPROVED / REJECTED with messages for out-of-range results."""
    errors = F.array_compact(F.array(
        F.when(~F.col(score).between(0.0, 100.0), F.lit("score must be within 0..100")),
        F.when(F.col(cost) < 0, F.lit("cost must not be negative")),
        F.when(F.col(minutes) < 0, F.lit("travel time must not be negative"))))
    return df.withColumn("errors", errors).withColumn(
        "status", F.when(F.size("errors") == 0, "APPROVED").otherwise("REJECTED"))
