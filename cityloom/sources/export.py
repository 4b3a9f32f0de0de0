"""GeoJSON rows for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BUILDING_COLOURS, DEFAULT_COLOUR
from ..functions.geometry import parts
from .city import default_height, scan

# Layers that may be exported and the columns they show.
LAYER_COLUMNS = {
    "roads": ("id", "road_class", "lanes", "speed_limit", "surface"),
    "buildings": ("id", "building_type", "land_use", "height_m", "floors",
                  "population_estimate"),
    "facilities": ("id", "name", "type", "capacity", "service_radius_m"),
    "land_parcels": ("id", "land_use", "zoning", "development_status", "slope_deg",
                     "flood_risk"),
    "population_zones": ("id", "population", "households", "density_per_sqkm"),
    "planning_constraints": ("id", "type", "severity"),
    "administrative_areas": ("id", "name", "type", "population"),
    "water_bodies": ("id", "type", "seasonality"),
}


def geometry(kind: str, rings: str | Column = "rings") -> Column:
    """Struct that serialises to a GeoJSON geometry."""
    r = F.col(rings) if isinstance(rings, str) else rings
    pairs = F.transform(r, lambda ring: F.transform(ring, lambda v: F.array(v["x"], v["y"])))
    if kind == "Point":
        coordinates = F.element_at(F.element_at(pairs, 1), 1)
    elif kind == "LineString":
        coordinates = F.element_at(pairs, 1)
    elif kind in ("Polygon", "MultiLineString"):
        coordinates = pairs
    elif kind == "MultiPolygon":
        coordinates = F.transform(parts(r), lambda part: F.transform(
            part, lambda ring: F.transform(ring, lambda v: F.array(v["x"], v["y"]))))
    else:
        raise ValueError(f"unsupported kind: {kind}")
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


def features_geojson(table: DataFrame, layer: str, kind: str, bounds=None,
                     limit: int | None = None) -> DataFrame:
    """One JSON text per feature; layers outside the list are refused."""
    if layer not in LAYER_COLUMNS:
        raise KeyError(layer)
    cols = [c for c in LAYER_COLUMNS[layer] if c in table.columns]
    rows = scan(table, bounds, limit=limit)
    return rows.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry(kind).alias("geometry"),
        F.struct(*cols).alias("properties"))).alias("feature"))


def combined(layers: dict[str, DataFrame]) -> DataFrame:
    """Union of layers with a ``layer`` column; times become text, nested columns JSON."""
    parts = []
    for name, df in layers.items():
        cols = []
        for c, t in df.dtypes:
            if t in ("timestamp", "date", "timestamp_ntz"):
                cols.append(F.col(c).cast("string").alias(c))
            elif t.startswith(("array", "map", "struct")) and c != "rings":
                cols.append(F.to_json(c).alias(c))
            else:
                cols.append(F.col(c))
        parts.append(df.select(F.lit(name).alias("layer"), *cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def buildings_3d(buildings: DataFrame) -> DataFrame:
    return buildings.withColumns(default_height(BUILDING_COLOURS, DEFAULT_COLOUR))
