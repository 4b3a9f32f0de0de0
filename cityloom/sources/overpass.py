"""Map snapshots (Overpass JSON) to city layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (FACILITY_CATEGORY, FLOOR_HEIGHT_M, HOUSEHOLD_SIZE, INGEST_AMENITIES,
                            INGEST_CAPACITY, INGEST_RADIUS, INGEST_SPEEDS, INGEST_ZONING,
                            LANDUSE_CATEGORY, TYPICAL_FLOORS)
from ..functions import geometry as g
from ..functions.scalars import half_even, jitter, lookup, tag_number

POSITION = "struct<lat:double,lon:double>"
ELEMENT = (f"type string, id long, lat double, lon double, nodes array<long>, "
           f"center {POSITION}, geometry array<{POSITION}>, tags map<string,string>")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """All elements of one or many snapshot files, with their arrival order."""
    snapshot = ELEMENT.replace(" string", ":string").replace(" long", ":long")
    for name in ("lat", "lon"):
        snapshot = snapshot.replace(f"{name} double,", f"{name}:double,")
    snapshot = (snapshot.replace("nodes array", "nodes:array").replace("center struct", "center:struct")
                .replace("geometry array", "geometry:array").replace("tags map", "tags:map"))
    raw = spark.read.schema(f"elements array<struct<{snapshot}>>").json(path, multiLine=True)
    return raw.select(F.input_file_name().alias("file"), F.posexplode("elements").alias(
        "pos", "e")).select("file", "pos", "e.*")


def with_node_geometry(elements: DataFrame) -> DataFrame:
    """Ways that carry node references get the positions of those nodes. A way has at most
    a few thousand nodes, so its list fits one row."""
    spots = elements.where("type = 'node'").groupBy(F.col("id").alias("_n")).agg(
        F.min_by(F.struct("lat", "lon"), F.struct("file", "pos")).alias("_p")).select(
        "_n", "_p.lat", "_p.lon")
    refs = elements.where("type = 'way' AND geometry IS NULL AND nodes IS NOT NULL").select(
        F.col("id").alias("_way"), F.posexplode("nodes").alias("_i", "_n")).distinct()
    found = refs.join(spots, "_n").groupBy("_way").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_i", "lat", "lon"))),
        lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("_g"))
    out = elements.join(found, (F.col("type") == "way") & (F.col("id") == F.col("_way")), "left")
    return out.withColumn("geometry", F.coalesce("geometry", "_g")).drop("_way", "_g")


def vertices(geometry: str = "geometry") -> Column:
    whole = F.filter(F.coalesce(F.col(geometry), F.array().cast(f"array<{POSITION}>")),
                     lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.transform(whole, lambda p: g.vertex(p["lon"], p["lat"]))


def way_rings(polygon: bool) -> Column:
    """Closed valid ring as a polygon, or the line; NULL when it is neither."""
    def ring(vs):
        closed = (F.size(vs) >= 4) & (F.element_at(vs, 1) == F.element_at(vs, -1))
        ccw = F.when(g.ring_area(vs) < 0, F.reverse(vs)).otherwise(vs)
        return F.when(F.size(vs) >= 4, F.when(closed, F.array(ccw)))

    def line(vs):
        return F.when(F.size(vs) >= 2, F.array(vs))
    shape = g.let(vertices(), ring if polygon else line)
    return F.when(shape.isNotNull() & g.is_valid_polygon(shape), shape) if polygon else shape


def element_point() -> Column:
    """Own position, else the given centre, else the middle of the outline."""
    vs = vertices()
    return (F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), g.vertex("lon", "lat"))
            .when(F.col("center.lat").isNotNull() & F.col("center.lon").isNotNull(),
                  g.vertex("center.lon", "center.lat"))
            .when(F.size(vs) > 0, g.centroid(F.array(vs))))


def _tag(key: str) -> Column:
    return F.try_element_at("tags", F.lit(key))


def _first_match(keys: Sequence[str], table: dict[str, str], special=None) -> Column:
    """(kind, category) of the first tag key, in order, whose value is in the table."""
    hits = []
    for key in keys:
        value = F.lower(F.when(_tag(key) != "", _tag(key)))
        category = lookup(table, value)
        if special:
            category = F.coalesce(category, special(key, value))
        hits.append(F.when(category.isNotNull(), F.struct(
            value.alias("kind"), category.alias("category"))))
    return F.coalesce(*hits)


def classify_facility() -> Column:
    def special(key, value):
        if key == "healthcare":
            return F.when(value.isNotNull(), F.lit("health"))
        if key == "shop":
            return F.when(value == "chemist", F.lit("pharmacy"))
        return F.lit(None).cast("string")
    return _first_match(("amenity", "healthcare", "leisure", "shop"), FACILITY_CATEGORY, special)


def classify_landuse() -> Column:
    return _first_match(("landuse", "leisure", "natural"), LANDUSE_CATEGORY)


def extract_layer(elements: DataFrame, layer: str, region: str | None = None) -> DataFrame:
    """Usable features of one layer: ``osm_id, name, kind, category, rings | x, y``.
    The first arrival of an (id, type) counts."""
    e = elements
    if layer in ("facilities", "landuse"):
        hit = classify_facility() if layer == "facilities" else classify_landuse()
        e = e.withColumn("_c", hit).where("_c IS NOT NULL")
        kind, category = F.col("_c.kind"), F.col("_c.category")
    else:
        tags = [F.when(_tag(k) != "", _tag(k)) for k in ("highway", "building", "waterway",
                                                         "natural")]
        kind, category = F.coalesce(*tags, F.lit("")), F.lit("")
    if layer == "facilities":
        e = e.withColumn("_p", element_point()).where("_p IS NOT NULL")
        shape = [F.col("_p.x").alias("x"), F.col("_p.y").alias("y")]
    else:
        polygon = layer in ("buildings", "landuse")
        e = e.withColumn("_r", way_rings(polygon)).where("_r IS NOT NULL")
        shape = [F.col("_r").alias("rings")]
    row = F.struct(F.coalesce(_tag("name"), F.lit("")).alias("name"), kind.alias("kind"),
                   category.alias("category"), *shape)
    order = F.struct(*[F.col(c) for c in ("file", "pos") if c in e.columns])
    first = e.groupBy(F.col("id").alias("osm_id"), "type").agg(F.min_by(row, order).alias("r"))
    out = first.select("osm_id", "r.*")
    return out if region is None else out.withColumns(
        {"region": F.lit(region), "layer": F.lit(layer)})


# ------------------------------------------------------------------ pilot ingestion
def first_arrivals(elements: DataFrame) -> DataFrame:
    """One row for each (id, type): the one that arrived first, by file and position.

    Column by column, so that tags and outlines nobody reads later are not carried; and after the exchange, as
    Spark would else sort all that a task reads.
    """
    order = [F.col(c) for c in ("file", "pos") if c in elements.columns]
    if not order:
        return elements
    rest = [c for c in elements.columns if c not in ("id", "type")]
    return elements.repartition("id", "type").groupBy("id", "type").agg(
        *[F.min_by(F.col(c), F.struct(*order)).alias(c) for c in rest])


def _arrival(elements: DataFrame) -> list[str]:
    return [c for c in ("id", "type", "file", "pos") if c in elements.columns]


def ingest_roads(edges: DataFrame) -> DataFrame:
    """Tagged edges to road rows (class, lanes, speed, capacity, surface, one-way)."""
    cls = F.coalesce(_tag("highway"), F.lit("residential"))
    lanes = F.when(_tag("lanes").rlike("^[0-9]+$"), _tag("lanes").cast("int")).otherwise(2)
    return first_arrivals(edges.withColumns({
        "road_class": cls, "lanes": lanes, "width_m": F.lit(7.0),
        "speed_limit": lookup(INGEST_SPEEDS, cls, 30), "capacity": lanes * 600,
        "surface": F.coalesce(_tag("surface"), F.lit("asphalt")),
        "oneway": F.coalesce(_tag("oneway").isin("yes", "true", "1"), F.lit(False))}))


def ingest_facilities(elements: DataFrame) -> DataFrame:
    kind = _tag("amenity")
    rows = first_arrivals(elements.select(
        *_arrival(elements), kind.alias("_kind"), _tag("name").alias("_name"), element_point().alias("_p")))
    kind = F.col("_kind")
    return rows.where(kind.isin(list(INGEST_AMENITIES)) & F.col("_p").isNotNull()).select(
        "id", kind.alias("type"),
        F.coalesce("_name", F.concat(F.lit("Unnamed "), kind)).alias("name"),
        lookup(INGEST_CAPACITY, kind, 50).alias("capacity"),
        lookup(INGEST_RADIUS, kind, 2000.0).alias("service_radius_m"),
        F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def height_model(area: Column, key: Column) -> Column:
    """struct<height, floors, confidence>: surveyed height, tagged storeys, or a guess from
    building type and footprint, varied by the key; the confidence tells which."""
    h, lv, roof = tag_number(_tag("height")), tag_number(_tag("building:levels")), tag_number(
        _tag("roof:levels"))
    base = lookup(TYPICAL_FLOORS, F.lower(F.coalesce(_tag("building"), F.lit("yes"))),
                  TYPICAL_FLOORS["yes"])
    base = (F.when(area < 30, F.least(base, F.lit(1))).when(area < 60, F.least(base, F.lit(2)))
            .when(area < 120, F.least(base, F.lit(3)))
            .when(area > 2000, F.greatest(base, F.lit(4))).otherwise(base))
    guess = F.least(F.lit(40), F.greatest(F.lit(1), F.bround(
        base * jitter(key, 0.75, 1.35)).cast("int")))
    storeys = F.floor(lv).cast("int")

    def row(height, floors, confidence):
        return F.struct(half_even(height, 2).alias("height"), floors.cast("int").alias("floors"),
                        F.lit(confidence).alias("confidence"))
    return (F.when((h >= 1.5) & (h <= 999.0), row(h, F.greatest(
        F.lit(1), F.bround(h / FLOOR_HEIGHT_M)), 0.95))
        .when((lv >= 1) & (lv <= 163), row(F.least(F.lit(999.0), (storeys + F.least(
            F.coalesce(roof, F.lit(0.0)), F.lit(3.0))) * FLOOR_HEIGHT_M), storeys, 0.85))
        .otherwise(row(guess * FLOOR_HEIGHT_M, guess, 0.35)))


def ingest_buildings(elements: DataFrame, area: Column) -> DataFrame:
    """Buildings with modelled height and about 20 m2 of floor per person."""
    rows = elements.withColumn("_area", area)
    rows = rows.withColumn("_h", height_model(F.col("_area"), F.col("id")))
    people = F.bround(F.least(F.lit(5000.0), F.greatest(
        F.lit(0.0), F.col("_area") * F.col("_h.floors") / 20.0)))
    return first_arrivals(rows.withColumns({
        "height_m": F.least(F.lit(999.0), F.col("_h.height")), "floors": F.col("_h.floors"),
        "building_type": _tag("building"), "land_use": F.lit("mixed"),
        "confidence": F.col("_h.confidence"), "population_estimate": people.cast("int"),
        "risk_score": F.lit(0.0)}).drop("_h", "_area")).where("building_type IS NOT NULL")


def ingest_water(elements: DataFrame) -> DataFrame:
    first = first_arrivals(elements.select(
        *_arrival(elements), "geometry", _tag("natural").alias("_natural"), _tag("water").alias("_water")))
    return first.where("_natural = 'water'").withColumn("rings", way_rings(True)).where(
        "rings IS NOT NULL").select("id", F.coalesce("_water", F.lit("lake")).alias("type"),
                                    F.lit("perennial").alias("seasonality"), "rings")


def ingest_parcels(elements: DataFrame) -> DataFrame:
    """Land-use polygons to parcels: derived zoning, planning defaults, one row per part."""
    first = first_arrivals(elements.select(*_arrival(elements), "geometry", _tag("landuse").alias("_use")))
    use = F.col("_use")
    return first.where(use.isNotNull()).withColumn("rings", way_rings(True)).where(
        "rings IS NOT NULL").select(
        "id", use.alias("land_use"), lookup(INGEST_ZONING, use, "R1").alias("zoning"),
        F.lit("vacant").alias("development_status"), F.lit(2.0).alias("slope_deg"),
        F.lit(20.0).alias("elevation_m"), F.lit(0.1).alias("flood_risk"),
        F.explode(F.transform("rings", lambda r: F.array(r))).alias("rings"))


def population_zones(buildings: DataFrame, cell: float, *, box=("minx", "miny", "maxx", "maxy"),
                     population: str = "population_estimate",
                     cell_km2: Column | None = None) -> DataFrame:
    """People per square grid cell. A building on a cell edge counts in each cell it
    touches; cells without people are absent."""
    b = [F.col(c) for c in box]

    def cells(lo, hi):
        # A box that ends exactly on a grid line touches the next cell as well.
        first = F.when(F.floor(lo / cell) * cell == lo, F.floor(lo / cell) - 1).otherwise(
            F.floor(lo / cell))
        return F.sequence(first.cast("long"), F.floor(hi / cell).cast("long"))
    spread = buildings.select(
        F.col(population).alias("_p"), F.explode(cells(b[0], b[2])).alias("cx"), b[1].alias("_y0"),
        b[3].alias("_y1"))
    spread = spread.withColumn("cy", F.explode(cells(F.col("_y0"), F.col("_y1"))))
    people = spread.groupBy("cx", "cy").agg(F.sum("_p").alias("population")).where("population > 0")
    km2 = F.lit(cell * cell / 1e6) if cell_km2 is None else cell_km2
    return people.select(
        "cx", "cy", (F.col("cx") * cell).alias("minx"), (F.col("cy") * cell).alias("miny"),
        ((F.col("cx") + 1) * cell).alias("maxx"), ((F.col("cy") + 1) * cell).alias("maxy"),
        F.round("population").cast("long").alias("population"),
        F.round(F.col("population") / HOUSEHOLD_SIZE).cast("long").alias("households"),
        F.round(F.col("population") / km2, 2).alias("density_per_sqkm"))


# ------------------------------------------------------------------------ cleaning
def clean(features: DataFrame, shape: str = "rings") -> DataFrame:
    """Drop missing and empty shapes, exact copies, and columns tables cannot take."""
    out = features.where(F.col(shape).isNotNull() & (F.size(F.flatten(shape)) > 0))
    nested = [n for n, t in features.dtypes
              if n != shape and (t.startswith(("array", "map", "struct")))]
    return out.dropDuplicates([shape]).drop(*nested)


def repair_polygons(features: DataFrame, shape: str = "rings",
                    is_polygon: Column | None = None) -> DataFrame:
    """Close and orient rings of polygons, drop repeated vertices, flag what stays invalid.
    Lines and points are never touched. A column ``outer`` (see ``codec.decode``) tells which rings
    begin a part; without it only the first does."""
    def fix(r):
        def put(acc, v):
            last = F.try_element_at(acc, F.lit(-1))
            return F.when(last.isNull() | (last != v), F.concat(acc, F.array(v))).otherwise(acc)

        def close(vs):
            ring = F.when(F.element_at(vs, 1) == F.element_at(vs, -1), vs).otherwise(
                F.concat(vs, F.slice(vs, 1, 1)))
            return ring
        return g.let(F.aggregate(r, g.no_vertices(), put), close)

    first = (lambda i: F.get("outer", i)) if "outer" in features.columns else (lambda i: i == 0)

    def orient(r, i):
        a = g.ring_area(r)
        flip = F.when(first(i), a < 0).otherwise(a > 0)
        return F.when(flip, F.reverse(r)).otherwise(r)
    poly = F.lit(True) if is_polygon is None else is_polygon
    fixed = F.transform(F.transform(F.col(shape), fix), orient)
    return features.withColumn(shape, F.when(poly, fixed).otherwise(F.col(shape))).withColumn(
        "valid", ~poly | g.is_valid_polygon(shape))


def single_parts(features: DataFrame, shape: str = "rings") -> DataFrame:
    """One row per part: an outer ring (counter-clockwise) with its holes (clockwise)."""
    return features.withColumn(shape, F.explode(g.parts(shape)))


# ------------------------------------------------------------------------- reports
def layer_report(fetched: DataFrame, written: DataFrame, layers: Sequence[str]) -> DataFrame:
    """layer, fetched, written, status. Nothing fetched is ``empty``; rows fetched but none
    usable is ``empty`` too; a layer that could not be read at all (no row) is ``failed``."""
    spark = fetched.sparkSession
    names = spark.createDataFrame([(n,) for n in layers], "layer string")
    f = fetched.groupBy("layer").agg(F.sum("n").alias("fetched"))
    w = written.groupBy("layer").agg(F.sum("n").alias("written"))
    out = names.join(f, "layer", "left").join(w, "layer", "left")
    n = F.coalesce("written", F.lit(0))
    return out.select(
        "layer", F.coalesce("fetched", F.lit(0)).alias("fetched"), n.alias("written"),
        F.when(F.col("fetched").isNull(), "failed").when(n == 0, "empty").otherwise("ok")
        .alias("status"))
