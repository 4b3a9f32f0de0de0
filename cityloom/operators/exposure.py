"""Hazard, flood and environmental exposure. Hazards are rows: base and mitigated runs,
or thousands of events, share one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (DEFAULT_SENSITIVITY, GREEN_COVER, HAZARDS, MEASURES, SENSITIVITY)
from ..functions import geometry as g
from ..functions.scalars import clamp, half_even, lookup, ratio
from ..session import cut
from .gridjoin import box_pairs
from . import sweep
from .overlay import BOX, pbox, union_area


def proximity_exposure(buildings: DataFrame, water: DataFrame, level_m: float,
                       key: str = "id") -> DataFrame:
    """Buildings within max(level, 0.1) x 120 m of a water body: count, people, share."""
    reach = max(level_m, 0.1) * 120.0
    wb = pbox("w_")
    hit = box_pairs(water, buildings, wb, BOX, margin=reach,
                    condition=g.box_box_distance(wb, BOX) <= reach).select(key).distinct()
    total = buildings.agg(F.count(F.lit(1))).scalar()
    out = buildings.join(hit, key, "left_semi").agg(
        F.count(F.lit(1)).alias("buildings_exposed"),
        F.coalesce(F.sum("population_estimate"), F.lit(0.0)).alias("population_exposed"))
    share = F.when(total > 0, F.col("buildings_exposed") / total).otherwise(F.lit(0.0))
    return out.withColumn("exposure_share", half_even(share, 4))


# ----------------------------------------------------------------------- hazards
def _applies(name: str, hazard: Column) -> Column:
    kinds = MEASURES[name][3]
    return F.lit(True) if kinds is None else hazard.isin(list(kinds))


def measure_factor(quantity: str, measures: Column, hazard: Column) -> Column:
    """Product of the factors of the active measures that act on ``quantity``."""
    parts = [F.when(F.array_contains(measures, F.lit(m)) & _applies(m, hazard),
                    F.lit(spec[2])).otherwise(F.lit(1.0))
             for m, spec in MEASURES.items() if spec[1] == quantity]
    return reduce(lambda a, b: a * b, parts, F.lit(1.0))


def measure_notes(measures: Column, hazard: Column) -> Column:
    """Notes on the measures that act on the extent, or cannot for this hazard."""
    notes = []
    for m, (label, quantity, _, kinds) in MEASURES.items():
        if quantity == "hazard_radius":
            on = F.array_contains(measures, F.lit(m))
            notes.append(F.when(on & _applies(m, hazard), F.lit(f"{label} reduced the extent")))
            if kinds:
                notes.append(F.when(on & ~_applies(m, hazard), F.concat(
                    F.lit(f"{label} has no effect on a "), hazard, F.lit(" event; ignored"))))
    return F.array_compact(F.array(*notes))


def build_hazards(events: DataFrame) -> DataFrame:
    """``hazard_id, run, hazard_type, cx, cy, radius_m, intensity, measures`` (array) with
    the effective radius, core and slow radius, factors and bounds added. Unknown types
    behave like fire; unknown measures do nothing."""
    kind = F.when(F.col("hazard_type").isin(list(HAZARDS)), F.col("hazard_type")).otherwise("fire")
    m, t = F.col("measures"), F.col("hazard_type")
    default = lookup({k: v[3] for k, v in HAZARDS.items()}, kind)
    core = lookup({k: v[1] for k, v in HAZARDS.items()}, kind)
    own = F.coalesce(F.when(F.col("radius_m") > 0, F.col("radius_m")), default)
    out = events.withColumns({
        "radius_m": own * measure_factor("hazard_radius", m, t),
        "core_ratio": core, "intensity": clamp("intensity", 0.0, 1.0),
        "f_buildings": measure_factor("buildings_damaged", m, t),
        "f_population": measure_factor("population_exposed", m, t),
        "f_facilities": measure_factor("facilities_offline", m, t),
        "f_roads": measure_factor("roads_blocked", m, t),
        "notes": measure_notes(m, t)})
    r = F.greatest(F.col("radius_m"), F.lit(1.0))
    return out.withColumns({
        "reach_m": r, "core_m": F.greatest(F.col("radius_m") * F.col("core_ratio"), F.lit(1.0)),
        "h_minx": F.col("cx") - r, "h_miny": F.col("cy") - r,
        "h_maxx": F.col("cx") + r, "h_maxy": F.col("cy") + r})


HBOX = ("h_minx", "h_miny", "h_maxx", "h_maxy")


def severity(distance: Column) -> Column:
    """Linear decay from the centre, zero from the radius on."""
    return F.when(distance >= F.col("radius_m"), F.lit(0.0)).otherwise(
        F.col("intensity") * (1.0 - distance / F.col("radius_m")))


def damage_state(sev: Column) -> Column:
    return F.when(sev > 0.66, "severe").when(sev > 0.33, "moderate").otherwise("light")


def hazard_hits(hazards: DataFrame, things: DataFrame, box=BOX) -> DataFrame:
    """hazard x thing pairs with a positive severity at the thing's middle."""
    b = [F.col(c) for c in box]
    mx, my = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    d = g.point_distance("cx", "cy", mx, my)
    touched = g.box_distance("cx", "cy", *box) <= F.col("reach_m")
    pairs = box_pairs(hazards, things, HBOX, box, condition=touched & (d < F.col("radius_m")))
    return pairs.withColumn("severity", severity(d)).where(F.col("severity") > 0).withColumns(
        {"damage_state": damage_state(F.col("severity"))})


def hazard_population(hazards: DataFrame, zones: DataFrame, key: Sequence[str]) -> DataFrame:
    """People inside each footprint by shared area (zones: ``z_`` bounds, z_population)."""
    zb = pbox("z_")
    pairs = box_pairs(hazards, zones, HBOX, zb,
                      condition=g.box_distance("cx", "cy", *zb) < F.col("reach_m"))
    own = g.box_area(*zb)
    middle = g.in_disc((F.col("z_minx") + F.col("z_maxx")) / 2,
                       (F.col("z_miny") + F.col("z_maxy")) / 2, "cx", "cy", "reach_m")
    share = F.when(own > 0, g.disc_area_in_box("cx", "cy", "reach_m", zb) / own).otherwise(
        F.when(middle, 1.0).otherwise(0.0))
    return pairs.groupBy(*key).agg(F.sum(F.coalesce("z_population", F.lit(0.0)) * share)
                                   .alias("population_exposed"))


def hazard_roads(hazards: DataFrame, roads: DataFrame, key: Sequence[str]) -> DataFrame:
    """Roads touched by each hazard: ``effect`` blocked (meets the core) or slowed. With a
    road measure only the first ``round(n x factor)`` blocked ids stay blocked, in text
    order; the rest reopen.

    ``roads``: road_id and one straight or bent line in ``rings``, with ``r_`` bounds.
    """
    d = g.line_distance("rings", "cx", "cy")
    pairs = box_pairs(hazards, roads, HBOX, pbox("r_"), condition=d <= F.col("reach_m"))
    # Read four times below: the join runs once.
    rows = cut(pairs.select(*key, "f_roads", F.col("road_id").cast("string").alias("road_id"),
                            F.when(d <= F.col("core_m"), "blocked").otherwise("slowed")
                            .alias("effect")))
    blocked, slowed = rows.where("effect = 'blocked'"), rows.where("effect = 'slowed'")
    n = blocked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    partial = blocked.where("f_roads < 1.0")
    keep = _first_per_group(partial.join(n, list(key)), list(key), "road_id",
                            F.bround(F.col("_n") * F.col("f_roads")))
    return (blocked.where("f_roads >= 1.0").unionByName(keep.drop("_n"))
            .unionByName(slowed).select(*key, "road_id", "effect"))


def _first_per_group(df: DataFrame, key: list[str], order: str, n: Column) -> DataFrame:
    from .scan import running_total

    one = running_total(df.withColumn("_one", F.lit(1)), key, [F.col(order)],
                        F.col("_one"), "_pos")
    return one.where(F.col("_pos") <= n).drop("_pos", "_one")


def hazard_summary(hazards: DataFrame, key: Sequence[str], *, buildings: DataFrame | None = None,
                   zones: DataFrame | None = None, facilities: DataFrame | None = None,
                   roads: DataFrame | None = None) -> DataFrame:
    """Metrics per hazard run; layers that were not supplied count as empty. ``buildings``
    and ``facilities`` are hits, ``roads`` is the result of :func:`hazard_roads`."""
    out = hazards
    zero = F.lit(0)
    if buildings is not None:
        b = buildings.groupBy(*key).agg(
            F.count(F.lit(1)).alias("_b"), F.count_if(F.col("damage_state") == "severe").alias("_s"),
            F.sum(F.coalesce("population_estimate", F.lit(0.0))).alias("_bp"))
        out = out.join(b, list(key), "left")
    else:
        out = out.withColumns({"_b": zero, "_s": zero, "_bp": F.lit(0.0)})
    if zones is not None:
        out = out.join(zones, list(key), "left").withColumnRenamed("population_exposed", "_p")
    else:
        out = out.withColumn("_p", F.col("_bp"))
    if facilities is not None:
        out = out.join(facilities.groupBy(*key).agg(F.count(F.lit(1)).alias("_f")), list(key), "left")
    else:
        out = out.withColumn("_f", zero)
    if roads is not None:
        out = out.join(roads.groupBy(*key).agg(
            F.count_if(F.col("effect") == "blocked").alias("_rb"),
            F.count_if(F.col("effect") == "slowed").alias("_rs")), list(key), "left")
    else:
        out = out.withColumns({"_rb": zero, "_rs": zero})

    def n(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("long")
    people = F.coalesce("_p", F.lit(0.0))
    return out.select(
        *key, half_even("radius_m", 1).alias("hazard_radius_m"),
        half_even(g.disc_area("reach_m") / 1e6, 4).alias("hazard_area_km2"),
        n("_b").alias("buildings_affected"),
        F.bround(n("_s") * F.col("f_buildings")).cast("long").alias("buildings_severe"),
        half_even(people, 1).alias("population_exposed"),
        half_even(people * F.col("f_population"), 1).alias("population_at_risk"),
        n("_f").alias("facilities_affected"),
        F.bround(n("_f") * F.col("f_facilities")).cast("long").alias("facilities_offline"),
        n("_rb").alias("roads_blocked"), n("_rs").alias("roads_slowed"))


COMPARED = ("population_at_risk", "buildings_severe", "facilities_offline", "roads_blocked",
            "hazard_radius_m", "hazard_area_km2")


def metric_rows(summary: DataFrame, key: Sequence[str],
                metrics: Sequence[str] = COMPARED) -> DataFrame:
    """Wide summary to long ``metric, value`` rows."""
    return summary.unpivot(list(key), [F.col(m).cast("double").alias(m) for m in metrics],
                           "metric", "value")


def network_impact(base: DataFrame, mitigated: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Closure rows of the base run, and those a measure reopens."""
    b = base.where("effect = 'blocked'")
    m = mitigated.where("effect = 'blocked'").select(*key, "road_id")
    reopened = b.join(m, [*key, "road_id"], "left_anti").withColumn("effect", F.lit("reopened"))
    return base.unionByName(reopened)


# ------------------------------------------------------------------ flood overlays
def flood_exposure(hazards: DataFrame, buildings: DataFrame, zones: DataFrame,
                   facilities: DataFrame, rings: bool = False) -> DataFrame:
    """Exposure to the union of hazard areas (``h_`` bounds): nothing counts twice.

    ``buildings``: id, bounds, population_estimate; ``zones``: z_ columns; ``facilities``:
    f_id, x, y. With ``rings`` the three layers have shapes (``h_rings``, ``rings``, ``z_rings``);
    without, their boxes are the shapes.
    """
    meets = g.intersects("h_rings", "rings") if rings else None
    holds = g.covers_point("h_rings", "x", "y") if rings else None
    hit = box_pairs(hazards, buildings, HBOX, BOX, condition=meets).select("id").distinct()
    b = buildings.join(hit, "id", "left_semi").agg(
        F.count(F.lit(1)).alias("buildings_exposed"),
        F.coalesce(F.sum("population_estimate"), F.lit(0.0)).alias("_bp"))
    total = buildings.agg(F.count(F.lit(1))).scalar()
    zb = [F.col("z_" + c) for c in BOX]
    hb = [F.col(c) for c in HBOX]
    one = hazards.withColumn("_one", F.lit(1))
    if rings:
        covered = sweep.covered_areas(zones, hazards, pbox("z_"), HBOX, ["z_id"], ("z_rings", "h_rings")
                                      ).withColumnRenamed("area", "_a")
        whole, union = g.area("z_rings"), sweep.union_area(one, ["_one"], "h_rings", "_u")
    else:
        pieces = box_pairs(zones, hazards, pbox("z_"), HBOX).select(
            "z_id", F.greatest(zb[0], hb[0]).alias("x0"), F.greatest(zb[1], hb[1]).alias("y0"),
            F.least(zb[2], hb[2]).alias("x1"), F.least(zb[3], hb[3]).alias("y1"))
        covered = union_area(pieces.where("x1 > x0 AND y1 > y0"), ["z_id"], ("x0", "y0", "x1", "y1"), "_a")
        whole, union = g.box_area(*pbox("z_")), union_area(one, ["_one"], HBOX, "_u")
    # Zones look small as a file; with their shapes they are a hundred times as large, and none are sent through the driver.
    own = zones.select("z_id", "z_population", whole.alias("_whole"))
    pop = own.join(covered.hint("merge"), "z_id").agg(F.coalesce(F.sum(
        F.col("z_population") * F.col("_a") / F.col("_whole")), F.lit(0.0))).scalar()
    fac = box_pairs(facilities, hazards, ("x", "y", "x", "y"), HBOX, condition=holds).select(
        "f_id").distinct().agg(F.count(F.lit(1))).scalar()
    area = union.agg(F.sum("_u")).scalar()
    return b.select(
        half_even(area, 2).alias("hazard_area"), "buildings_exposed",
        total.alias("buildings_total"),
        half_even(ratio(F.col("buildings_exposed"), total), 4).alias("buildings_exposed_ratio"),
        half_even(pop, 1).alias("population_exposed"),
        half_even("_bp", 1).alias("population_exposed_from_buildings"),
        fac.alias("facilities_exposed"))


# -------------------------------------------------------------------- environment
def land_conversion(footprints: DataFrame, landcover: DataFrame, *, key: str = "id",
                    land_use: str = "l_land_use", sensitivity: dict | None = None,
                    rings: tuple[str, str] | None = None) -> DataFrame:
    """footprint x land use: area converted, share and sensitivity weight. ``rings``: shape columns of both
    layers (``landcover`` then has l_id); without, their boxes are the shapes."""
    sens = sensitivity or SENSITIVITY
    use = F.coalesce(F.col(land_use), F.lit("unknown"))
    if rings:
        pairs = sweep.covered_areas(footprints, landcover.withColumn(land_use, use), BOX, pbox("l_"), [key], rings, group=["l_id", land_use]
                                    ).withColumnRenamed("area", "_a")
    else:
        pairs = box_pairs(footprints, landcover, BOX, pbox("l_")).withColumn("_a", g.box_overlap(BOX, pbox("l_")))
    rows = pairs.where("_a > 0").groupBy(key, use.alias("land_use")).agg(F.sum("_a").alias("_area"))
    whole = footprints.select(key, (g.area(rings[0]) if rings else g.box_area(*BOX)).alias("_whole"))
    return rows.join(whole, key).select(
        key, "land_use", "_area", "_whole", half_even("_area", 2).alias("area_converted"),
        half_even(ratio("_area", "_whole"), 4).alias("share_of_footprint"),
        lookup(sens, F.col("land_use"), DEFAULT_SENSITIVITY).alias("sensitivity_weight"))


def water_intrusion(footprints: DataFrame, water: DataFrame, distance: float, *, key: str = "id",
                    rings: tuple[str, str] = ("rings", "w_rings"), quarter_segments: int = 16) -> DataFrame:
    """``key, area``: how much of each footprint lies in the union of the water bodies grown by ``distance``. Both
    layers have shapes and ``footprints`` bounds; footprints that no buffer meets are absent."""
    near = sweep.buffer_shapes(water.select(rings[1]), rings[1], distance, quarter_segments)
    near = near.select(rings[1], *[F.col(c).alias("_w" + c) for c in BOX])
    return sweep.covered_areas(footprints, near, BOX, ["_w" + c for c in BOX], [key], rings)


def environmental_summary(conversion: DataFrame, footprints: DataFrame,
                          intrusion: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One row per footprint. ``intrusion``: key, area in the water buffer."""
    green = F.col("land_use").isin(list(GREEN_COVER))
    s = conversion.groupBy(key).agg(
        F.sum("_area").alias("_a"), F.sum(F.when(green, F.col("_area")).otherwise(0.0)).alias("_g"),
        F.sum(F.col("_area") * F.col("sensitivity_weight")).alias("_w"),
        F.count(F.lit(1)).alias("_n"))
    out = footprints.select(key, g.box_area(*BOX).alias("_f")).join(s, key, "left")
    out = (out.withColumn("_i", F.lit(0.0)) if intrusion is None else
           out.join(intrusion.select(key, F.col("area").alias("_i")), key, "left"))
    zero = F.lit(0.0)
    return out.select(
        key, half_even("_f", 2).alias("footprint_area"),
        half_even(F.coalesce("_a", zero), 2).alias("area_converted"),
        half_even(F.coalesce("_g", zero), 2).alias("green_cover_lost"),
        half_even(F.coalesce("_i", zero), 2).alias("water_buffer_intrusion"),
        half_even(ratio(F.coalesce("_w", zero), "_f"), 4).alias("impact_index"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("landcover_classes_affected"))
