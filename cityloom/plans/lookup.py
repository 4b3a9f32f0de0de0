"""Small interactive look-ups composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projection as p
from ..functions.geometry import point_distance
from ..functions.scalars import half_even

DISTANCES = {"plane": point_distance, "mercator": p.mercator_distance,
             "local": p.local_distance, "degree": p.degree_distance}


def nearby(facilities: DataFrame, x: float, y: float, radius_m: float,
           facility_type: str | None = None, limit: int | None = None,
           mode: str = "plane") -> DataFrame:
    """Facilities within a radius, nearest first. ``mode`` picks the metre: planar,
    Web-Mercator, local ground distance or degrees times 111 km."""
    df = facilities if facility_type is None else facilities.where(
        F.col("type") == facility_type)
    d = DISTANCES[mode]("x", "y", F.lit(float(x)), F.lit(float(y)))
    best = df.withColumn("_d", d).where(F.col("_d") <= radius_m).orderBy("_d", "id")
    best = best if limit is None else best.limit(limit)
    return best.withColumn("distance_m", half_even("_d", 2)).drop("_d")


def feature_by_ref(features: DataFrame, ref: str) -> DataFrame:
    """Row of a union view (``kind, id, ...``) named ``kind:id``; further parts after a
    second colon are ring numbers, and a bare id is a facility."""
    parts = ref.split(":")
    kind, raw = ("facility", parts[0]) if len(parts) == 1 else (parts[0], parts[1])
    if not raw.lstrip("-").isdigit():
        raise ValueError("feature id must be numeric")
    return features.where((F.col("kind") == kind) & (F.col("id") == int(raw)))


def attach_positions(records: DataFrame, positions: DataFrame, id_col: str) -> DataFrame:
    """Add ``lon, lat`` by the id text in front of ``#``. ``positions``: id, lon, lat."""
    key = F.substring_index(F.col(id_col).cast("string"), "#", 1).try_cast("long")
    where = positions.select(F.col("id").cast("long").alias("_pid"), "lon", "lat")
    return records.withColumn("_pid", key).join(where, "_pid", "left").drop("_pid")
