"""Scans of the stored city tables, in the vocabulary of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..operators.constraints import severity_of, weight_of
from ..operators.overlay import BOX

Bounds = tuple[float, float, float, float]


def in_bounds(bounds: Bounds | None, box: Sequence[str] = BOX) -> Column:
    """Bounds meet the window: four plain comparisons that reach the file scan."""
    if bounds is None:
        return F.lit(True)
    b = [F.col(c) for c in box]
    return ((b[2] >= bounds[0]) & (b[3] >= bounds[1]) & (b[0] <= bounds[2])
            & (b[1] <= bounds[3]))


def scan(table: DataFrame, bounds: Bounds | None = None, *, equals: dict | None = None,
         one_of: dict[str, Sequence] | None = None, min_area_m2: float | None = None,
         limit: int | None = None, box: Sequence[str] = BOX) -> DataFrame:
    """Filtered scan; empty conditions do not filter."""
    out = table if bounds is None else table.where(in_bounds(bounds, box))
    for c, v in (equals or {}).items():
        if v:
            out = out.where(F.col(c) == v)
    for c, vs in (one_of or {}).items():
        if vs:
            out = out.where(F.col(c).isin(list(vs)))
    if min_area_m2:
        out = out.where(F.col("area_m2") >= min_area_m2)
    return out.limit(limit) if limit else out


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def _shape(df: DataFrame) -> list[str]:
    return [c for c in ("rings", *BOX, "x", "y") if c in df.columns]


def to_parcels(t: DataFrame) -> DataFrame:
    return t.select(
        _text("id").alias("id"), _num("area_m2").alias("area"), "land_use", "zoning",
        F.coalesce("development_status", F.lit("candidate")).alias("status"),
        _num("slope_deg").alias("slope"), _num("elevation_m").alias("elevation"),
        _num("flood_risk").alias("flood_risk"), *_shape(t))


def to_buildings(t: DataFrame) -> DataFrame:
    return t.select(_text("id").alias("id"), _num("height_m").alias("height"), "floors",
                    "building_type", "land_use", _num("confidence").alias("confidence"),
                    _num("population_estimate").alias("population_estimate"), *_shape(t))


def to_roads(t: DataFrame) -> DataFrame:
    speed = F.when(_num("speed_limit") != 0, _num("speed_limit"))
    return t.select(
        _text("id").alias("id"), F.coalesce("road_class", F.lit("residential")).alias("road_class"),
        _num("width_m").alias("width"), F.coalesce(F.when(F.col("lanes") != 0, F.col("lanes")),
                                                   F.lit(2)).alias("lanes"),
        F.coalesce(speed, F.lit(40.0)).alias("speed"), _num("capacity").alias("capacity"),
        F.coalesce("oneway", F.lit(False)).alias("oneway"), *_shape(t))


def to_facilities(t: DataFrame) -> DataFrame:
    return t.select(_text("id").alias("id"), "type", "name", _num("capacity").alias("capacity"),
                    _num("service_radius_m").alias("service_radius"), *_shape(t))


def to_zones(t: DataFrame) -> DataFrame:
    return t.select(_text("id").alias("id"),
                    F.coalesce(_num("population"), F.lit(0.0)).alias("population"),
                    _num("density_per_sqkm").alias("density"), "households", *_shape(t))


def to_constraints(t: DataFrame) -> DataFrame:
    return t.select(_text("id").alias("id"), "type", severity_of("severity").alias("severity"),
                    weight_of("severity").alias("weight"), F.lit(0.0).alias("buffer"), *_shape(t))


def constraints_with_water(constraints: DataFrame, water: DataFrame,
                           buffer_m: float | None) -> DataFrame:
    """Planning constraints, and every water body as a hard constraint with a buffer."""
    out = to_constraints(constraints)
    if not buffer_m:
        return out
    wet = water.select(
        F.concat(F.lit("water-"), _text("id")).alias("id"),
        F.concat(F.lit("water_buffer:"), F.col("type")).alias("type"),
        F.lit("hard").alias("severity"), F.lit(1.0).alias("weight"),
        F.lit(float(buffer_m)).alias("buffer"), *_shape(water))
    return out.unionByName(wet)


def with_counts(catalogue: DataFrame, counts: DataFrame, key: str = "layer") -> DataFrame:
    """Layer catalogue with row counts; layers without rows show 0."""
    return catalogue.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def default_height(types: dict[str, str], default: str, kind: str = "building_type") -> dict:
    """Columns of an extruded building export."""
    h = F.coalesce(F.col("height_m"), F.lit(9.0))
    return {"height_m": h, "extrude_height": h,
            "building_color": lookup(types, F.col(kind), default)}
