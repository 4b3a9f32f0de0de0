"""Comparison regions: one feature table partitioned by region and layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (DEFAULT_FLOORS, FLOOD_BUFFER_M, FLOOD_PROXY_RISK,
                            FLOOR_AREA_PER_PERSON, NON_RESIDENTIAL, REGIONS,
                            REGION_LABELS, RESIDENTIAL, RESIDENTIAL_FRACTION)
from ..functions.geometry import box_rings
from ..functions.projection import utm_srid_of
from ..operators.gridjoin import box_pairs
from ..operators.overlay import BOX, pbox
from ..operators.scan import top_per_group


def region_table(spark: SparkSession) -> DataFrame:
    """region, label, bounds, centre and metric system (fixed, four rows)."""
    rows = [(r, REGION_LABELS[r], *b, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2,
             utm_srid_of((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)) for r, b in REGIONS.items()]
    return spark.createDataFrame(rows, "region string, label string, minx double, miny double, "
                                       "maxx double, maxy double, lon double, lat double, srid int")


def region_polygon(region: str) -> Column:
    key = region.lower().strip()
    if key not in REGIONS:
        raise ValueError(f"unknown region: {region}; valid: {sorted(REGIONS)}")
    return box_rings(*[F.lit(v) for v in REGIONS[key]])


def scaled_bounds(bounds: tuple[float, float, float, float], scale: float):
    """Bounds grown around their centre."""
    cx, cy = (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
    hw, hh = (bounds[2] - bounds[0]) / 2 * scale, (bounds[3] - bounds[1]) / 2 * scale
    return (cx - hw, cy - hh, cx + hw, cy + hh)


def feature_id(kind: str) -> Column:
    return F.concat_ws("_", "region", F.lit(kind), F.col("id").cast("string"))


def _type_word(default: str) -> Column:
    def known(c):
        return F.when(F.col(c) != "", F.col(c))
    return F.coalesce(known("category"), known("kind"), F.lit(default))


def roads(features: DataFrame) -> DataFrame:
    """Longest part of each (multi)line."""
    from ..functions import geometry as g
    longest = F.array_max(F.transform("rings", lambda r: F.struct(
        g.length(F.array(r)).alias("len"), F.array(r).alias("line"))))
    kind = F.when(F.col("kind") != "", F.col("kind"))
    return features.where("layer = 'roads'").select(
        "region", feature_id("road").alias("id"), longest["line"].alias("rings"),
        F.coalesce(kind, F.lit("local")).alias("road_class"))


def facilities(features: DataFrame) -> DataFrame:
    return features.where("layer = 'facilities'").select(
        "region", feature_id("fac").alias("id"), _type_word("generic").alias("type"), "x", "y")


def parcels(features: DataFrame) -> DataFrame:
    """Land-use polygons with the flood proxy: exposed when their bounds, grown by 150 m,
    meet the bounds of mapped water in the same region."""
    land = features.where("layer = 'landuse'")
    water = features.where("layer = 'water'").select("region", *[
        F.col(c).alias("w_" + c) for c in BOX])
    wet = box_pairs(land.select("region", "id", *BOX), water, BOX, pbox("w_"),
                    margin=FLOOD_BUFFER_M, on=["region"]).select("region", "id").distinct(
        ).withColumn("_wet", F.lit(True))
    return land.join(wet, ["region", "id"], "left").select(
        "region", feature_id("parcel").alias("id"), *BOX, "area", _type_word("").alias("land_use"),
        F.when(F.col("_wet"), FLOOD_PROXY_RISK).otherwise(0.0).alias("flood_risk"))


def residential_share(kind: Column) -> Column:
    """1 for housing, 0.75 for untagged and other buildings, NULL for what is no housing."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(~k.isin(list(NON_RESIDENTIAL)), F.when(
        k.isin(list(RESIDENTIAL)), 1.0).otherwise(RESIDENTIAL_FRACTION))


def footprint_population(features: DataFrame) -> DataFrame:
    """Residents per building footprint, as point zones."""
    b = features.where("layer = 'buildings' AND area > 0").withColumn(
        "_share", residential_share(F.col("kind"))).where("_share IS NOT NULL")
    return b.select("region", feature_id("pz").alias("id"), "area", (
        F.col("area") * DEFAULT_FLOORS * F.col("_share") / FLOOR_AREA_PER_PERSON)
        .alias("population"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"))


def population_evidence(features: DataFrame) -> DataFrame:
    """How the estimate came about, per region."""
    total = features.where("layer = 'buildings'").groupBy("region").agg(
        F.count(F.lit(1)).alias("buildings_total"))
    pop = footprint_population(features).groupBy("region").agg(
        F.count(F.lit(1)).alias("buildings_residential"),
        F.bround(F.sum("area")).alias("residential_footprint_m2"),
        F.bround(F.sum("population")).alias("estimated_population"))
    return total.join(pop, "region", "left")


def inventory(regions: DataFrame, features: DataFrame) -> DataFrame:
    """Regions with the layers they have: count and extent. A region without features is
    listed once, without a layer."""
    per = features.groupBy("region", "layer").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias("ext_" + c) for c in BOX[:2]],
        *[F.max(c).alias("ext_" + c) for c in BOX[2:]])
    return regions.join(per, "region", "left")


def loaded(features: DataFrame, region: str) -> bool:
    """Whether a region holds rows already (then a load skips it). Prunes to its partition."""
    return len(features.where(F.col("region") == region).head(1)) > 0


def collection(features: DataFrame, limit: int, limits: dict[tuple[str, str], int] | None = None,
               dense: tuple[str, ...] = ("rotterdam", "chandigarh"),
               excluded_classes: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` features of each region and layer for a map (``limits`` has other numbers
    for some of them), buildings of dense regions largest first, unwanted road classes left out (a
    missing class stays)."""
    wanted = features.where(~((F.col("region") == "rotterdam") & (F.col("layer") == "roads")
                              & F.coalesce(F.col("kind").isin(list(excluded_classes)),
                                           F.lit(False)))) if excluded_classes else features
    cap = F.lit(limit)
    for (r, ly), n in (limits or {}).items():
        cap = F.when((F.col("region") == r) & (F.col("layer") == ly), n).otherwise(cap)
    by_size = F.col("region").isin(list(dense)) & (F.col("layer") == "buildings")
    order = F.when(by_size, -F.col("area")).otherwise(F.lit(0.0))
    highest = max([limit, *(limits or {}).values()])
    ranked = top_per_group(wanted, ["region", "layer"], [order, F.col("id")], highest, "_rn")
    return ranked.where(F.col("_rn") <= cap).drop("_rn")
