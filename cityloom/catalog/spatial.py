"""Joins, predicates, distances and overlays between layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import aggregation, constraints, nearest, overlay
from ..operators.gridjoin import box_pairs
from ..operators.overlay import BOX, pbox, prefixed
from ..sources.layers import layer, with_layers
from . import query

MEET = "{a}.minx<={b}.maxx AND {a}.maxx>={b}.minx AND {a}.miny<={b}.maxy AND {a}.maxy>={b}.miny"
OVERLAP = ("greatest(0,least({a}.maxx,{b}.maxx)-greatest({a}.minx,{b}.minx))"
           "*greatest(0,least({a}.maxy,{b}.maxy)-greatest({a}.miny,{b}.miny))")
AREA = "(({a}.maxx-{a}.minx)*({a}.maxy-{a}.miny))"


def meet(a, b):
    return MEET.format(a=a, b=b)


def shared(a, b):
    return OVERLAP.format(a=a, b=b)


def area(a):
    return AREA.format(a=a)


def gap(a, b):
    """Distance between two boxes, and its square root kept out for exactness."""
    dx = f"greatest({a}.minx-{b}.maxx,{b}.minx-{a}.maxx,0)"
    dy = f"greatest({a}.miny-{b}.maxy,{b}.miny-{a}.maxy,0)"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def boxes(spark, d, name, prefix="", extra=()):
    df = layer(spark, d, name).select("id", *BOX, *extra)
    return prefixed(df, prefix) if prefix else df


@query(with_layers("parcel", "zone") + f"""
 SELECT p.id AS parcel_id, z.id AS zone_id FROM parcel p LEFT JOIN zone z ON {meet('p','z')}""")
def spatial_join_intersects(spark, d):
    out = overlay.spatial_join(boxes(spark, d, "parcel"), boxes(spark, d, "zone", "z_"),
                               "intersects", BOX, pbox("z_"), key=["id"])
    return out.select(F.col("id").alias("parcel_id"), F.col("z_id").alias("zone_id"))


@query(with_layers("building", "parcel") + """
 SELECT b.id AS building_id, p.id AS parcel_id FROM building b JOIN parcel p
 ON b.minx>=p.minx AND b.maxx<=p.maxx AND b.miny>=p.miny AND b.maxy<=p.maxy""")
def spatial_join_within(spark, d):
    out = overlay.spatial_join(boxes(spark, d, "building"), boxes(spark, d, "parcel", "p_"),
                               "within", BOX, pbox("p_"), keep_unmatched=False)
    return out.select(F.col("id").alias("building_id"), F.col("p_id").alias("parcel_id"))


@query(with_layers("zone", "building") + """
 SELECT z.id AS zone_id, count(*) AS buildings FROM zone z JOIN building b
 ON b.minx>=z.minx AND b.maxx<=z.maxx AND b.miny>=z.miny AND b.maxy<=z.maxy GROUP BY z.id""")
def spatial_join_contains(spark, d):
    out = overlay.spatial_join(boxes(spark, d, "zone"), boxes(spark, d, "building", "b_"),
                               "contains", BOX, pbox("b_"), keep_unmatched=False)
    return out.groupBy(F.col("id").alias("zone_id")).agg(F.count(F.lit(1)).alias("buildings"))


@query(with_layers("parcel", "zone") + f"""
 SELECT p.id AS parcel_id, z.id AS zone_id FROM parcel p JOIN zone z ON {meet('p','z')}""")
def spatial_join_polygons(spark, d):
    """The polygon predicate on rings instead of bounds."""
    p = boxes(spark, d, "parcel").withColumn("rings", g.box_rings(*BOX))
    z = boxes(spark, d, "zone", "z_").withColumn("z_rings", g.box_rings(*pbox("z_")))
    out = overlay.spatial_join(p, z, "intersects", BOX, pbox("z_"), keep_unmatched=False,
                               rings=("rings", "z_rings"))
    return out.select(F.col("id").alias("parcel_id"), F.col("z_id").alias("zone_id"))


@query(with_layers("parcel", "constraint") .replace("constraint AS", "cons AS") + f"""
 SELECT id AS parcel_id FROM parcel p WHERE EXISTS
 (SELECT 1 FROM cons c WHERE {meet('p','c')})""")
def intersects_any(spark, d):
    out = overlay.intersects_any(boxes(spark, d, "parcel"), boxes(spark, d, "constraint", "c_"),
                                 BOX, pbox("c_"), ["id"])
    return out.select(F.col("id").alias("parcel_id"))


@query(with_layers("parcel", "ward") + """
 SELECT p.id AS parcel_id, w.id AS ward_id FROM parcel p JOIN ward w
 ON p.minx>=w.minx AND p.maxx<=w.maxx AND p.miny>=w.miny AND p.maxy<=w.maxy""")
def containment(spark, d):
    out = overlay.spatial_join(boxes(spark, d, "parcel"), boxes(spark, d, "ward", "w_"),
                               "within", BOX, pbox("w_"), keep_unmatched=False)
    return out.select(F.col("id").alias("parcel_id"), F.col("w_id").alias("ward_id"))


@query(with_layers("facility", "ward", "parcel") + """
 SELECT f.id AS facility_id, w.name AS containing_ward, min(p.id) AS containing_parcel_id
 FROM facility f
 JOIN ward w ON f.x>w.minx AND f.x<w.maxx AND f.y>w.miny AND f.y<w.maxy
 LEFT JOIN parcel p ON f.x>p.minx AND f.x<p.maxx AND f.y>p.miny AND f.y<p.maxy
 GROUP BY f.id, w.name""")
def point_in_polygon(spark, d):
    f = layer(spark, d, "facility").select("id", "x", "y")
    wards = prefixed(layer(spark, d, "ward").select("id", "name", *BOX), "w_")
    in_ward = overlay.containers_of(f, wards, ("x", "y"), pbox("w_")).select("id", "w_name")
    in_parcel = overlay.containers_of(f, boxes(spark, d, "parcel", "p_"), ("x", "y"),
                                      pbox("p_")).groupBy("id").agg(F.min("p_id").alias("p"))
    return in_ward.join(in_parcel, "id", "left").select(
        F.col("id").alias("facility_id"), F.col("w_name").alias("containing_ward"),
        F.col("p").alias("containing_parcel_id"))


@query(with_layers("building", "water") + f"""
 SELECT count(*) AS buildings_exposed,
 CAST(coalesce(sum(population_estimate),0) AS DOUBLE) AS population_exposed,
 round_even(count(*)/CAST((SELECT count(*) FROM building) AS DOUBLE),4) AS exposure_share
 FROM building b WHERE EXISTS (SELECT 1 FROM water w WHERE {gap('b','w')}<=60)""")
def flood_proximity_screen(spark, d):
    """Buildings within max(level, 0.1) x 120 m of water, level 0.5."""
    from ..operators.exposure import proximity_exposure
    return proximity_exposure(boxes(spark, d, "building", extra=["population_estimate"]),
                              boxes(spark, d, "water", "w_"), 0.5)


@query(with_layers("zone", "parcel") + f"""
 SELECT z.id AS zone_id, count(*) AS parcels FROM zone z JOIN parcel p
 ON {gap('z','p')}<=75 GROUP BY z.id""")
def within_distance_counts(spark, d):
    out = overlay.within_distance(boxes(spark, d, "zone"), boxes(spark, d, "parcel", "p_"),
                                  BOX, pbox("p_"), 75.0)
    return out.groupBy(F.col("id").alias("zone_id")).agg(F.count(F.lit(1)).alias("parcels"))


@query(with_layers("parcel", "constraint").replace("constraint AS", "cons AS") + f"""
 SELECT id AS parcel_id FROM parcel p WHERE EXISTS (SELECT 1 FROM cons c
 WHERE {gap('p','c')} <= CASE c.id%3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 120 END)""")
def exclusion_mask(spark, d):
    c = boxes(spark, d, "constraint", "c_").withColumn(
        "c_buffer", F.expr("CASE c_id%3 WHEN 0 THEN 0D WHEN 1 THEN 50D ELSE 120D END"))
    out = overlay.excluded(boxes(spark, d, "parcel"), c, BOX, pbox("c_"), ["id"],
                           F.col("c_buffer"))
    return out.select(F.col("id").alias("parcel_id"))


@query(with_layers("facility") + """
 SELECT id AS facility_id, type, round_even(sqrt((x-5000)*(x-5000)+(y-5000)*(y-5000)),2)
 AS distance_m FROM facility WHERE sqrt((x-5000)*(x-5000)+(y-5000)*(y-5000))<=3000
 ORDER BY sqrt((x-5000)*(x-5000)+(y-5000)*(y-5000)), id LIMIT 10""")
def nearby_facilities(spark, d):
    from ..plans.lookup import nearby
    return nearby(layer(spark, d, "facility"), 5000.0, 5000.0, 3000.0, limit=10).select(
        F.col("id").alias("facility_id"), "type", "distance_m")


@query(with_layers("zone", "facility") + """, c AS (SELECT id, (minx+maxx)/2 AS x,
 (miny+maxy)/2 AS y FROM zone), r AS (SELECT c.id AS zone_id, f.id AS facility_id,
 sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y)) AS dist, row_number() OVER (PARTITION BY c.id
 ORDER BY sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y)), f.id) AS rn FROM c CROSS JOIN facility f)
 SELECT zone_id, facility_id, round(dist,4) AS distance FROM r WHERE rn=1""")
def nearest_facility(spark, d):
    out = nearest.nearest(zone_points(spark, d), stations(spark, d), left_id="zone_id",
                          right_id="facility_id")
    return out.select("zone_id", "facility_id", F.round("distance", 4).alias("distance"))


def zone_points(spark, d):
    return layer(spark, d, "zone").select(
        F.col("id").alias("zone_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"), "population")


def stations(spark, d, kind=None):
    f = layer(spark, d, "facility")
    f = f.where(F.col("type") == kind) if kind else f
    return f.select(F.col("id").alias("facility_id"), F.col("x").alias("rx"),
                    F.col("y").alias("ry"), "capacity")


KNN_SQL = with_layers("zone", "facility") + """, c AS (SELECT id, (minx+maxx)/2 AS x,
 (miny+maxy)/2 AS y FROM zone), r AS (SELECT c.id AS zone_id, f.id AS facility_id,
 sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y)) AS dist, row_number() OVER (PARTITION BY c.id
 ORDER BY sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y)), f.id) AS rn
 FROM c CROSS JOIN facility f WHERE f.type='hospital'
 AND sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y))<=2500)
 SELECT zone_id, facility_id, round(dist,4) AS distance, CAST(rn AS INTEGER) AS rank
 FROM r WHERE rn<=3"""


@query(KNN_SQL)
def k_nearest_facilities(spark, d):
    out = nearest.k_nearest(zone_points(spark, d), stations(spark, d, "hospital"), 3,
                            left_id="zone_id", right_id="facility_id", max_distance=2500.0)
    return out.select("zone_id", "facility_id", F.round("distance", 4).alias("distance"),
                      "rank")


@query(with_layers("parcel", "facility") + """
 SELECT p.id AS parcel_id, round(min(sqrt(((p.minx+p.maxx)/2-f.x)*((p.minx+p.maxx)/2-f.x)
 +((p.miny+p.maxy)/2-f.y)*((p.miny+p.maxy)/2-f.y))),4) AS distance_to_same_type
 FROM parcel p LEFT JOIN facility f ON f.type='school' GROUP BY p.id""")
def min_distance_to_any(spark, d):
    p = layer(spark, d, "parcel").select(
        F.col("id").alias("parcel_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    out = nearest.min_distance(p, stations(spark, d, "school"), left_id="parcel_id",
                               right_id="facility_id")
    return out.select("parcel_id", F.round("distance", 4).alias("distance_to_same_type"))


@query(with_layers("zone", "facility") + """, c AS (SELECT id, (minx+maxx)/2 AS x,
 (miny+maxy)/2 AS y FROM zone) SELECT c.id AS zone_id, f.id AS facility_id,
 round(sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y)),4) AS cost FROM c CROSS JOIN facility f
 WHERE sqrt((c.x-f.x)*(c.x-f.x)+(c.y-f.y)*(c.y-f.y))<=1500""")
def distance_matrix(spark, d):
    out = nearest.distance_pairs(zone_points(spark, d), stations(spark, d), 1500.0)
    return out.select("zone_id", "facility_id", F.round("cost", 4).alias("cost"))


@query(with_layers("ward", "zone") + f"""
 SELECT w.id AS ward_id, round(sum(z.population*{shared('w','z')}/{area('z')}),2) AS population
 FROM ward w JOIN zone z ON {meet('w','z')} GROUP BY w.id""")
def population_within_areal(spark, d):
    z = boxes(spark, d, "zone", "z_", ["population"])
    out = overlay.population_within(boxes(spark, d, "ward"), z, BOX, pbox("z_"),
                                    area_key=["id"], population="z_population")
    return out.select(F.col("id").alias("ward_id"), F.round("population", 2).alias("population"))


@query(with_layers("parcel", "zone") + f"""
 SELECT p.id AS parcel_id, round(sum(z.population*{shared('p','z')}/{area('z')}),2) AS population
 FROM parcel p JOIN zone z ON {meet('p','z')} GROUP BY p.id""")
def population_within_polygons(spark, d):
    """Areal weighting through the general polygon overlay."""
    p = boxes(spark, d, "parcel").withColumn("rings", g.box_rings(*BOX))
    z = boxes(spark, d, "zone", "z_", ["population"]).withColumn(
        "z_rings", g.box_rings(*pbox("z_")))
    out = overlay.population_within(p, z, BOX, pbox("z_"), area_key=["id"],
                                    population="z_population", rings=("rings", "z_rings"))
    return out.select(F.col("id").alias("parcel_id"),
                      F.round("population", 2).alias("population"))


@query(with_layers("ward", "zone") + f"""
 SELECT w.id AS ward_id, round(sum(CASE WHEN (z.minx+z.maxx)/2>w.minx AND (z.minx+z.maxx)/2<w.maxx
 AND (z.miny+z.maxy)/2>w.miny AND (z.miny+z.maxy)/2<w.maxy THEN z.population ELSE 0 END),2)
 AS population FROM ward w JOIN zone z ON {meet('w','z')} GROUP BY w.id""")
def population_within_centroid(spark, d):
    z = boxes(spark, d, "zone", "z_", ["population"])
    out = overlay.population_within(boxes(spark, d, "ward"), z, BOX, pbox("z_"),
                                    area_key=["id"], population="z_population",
                                    method="centroid")
    return out.select(F.col("id").alias("ward_id"), F.round("population", 2).alias("population"))


@query(with_layers("ward", "zone") + f""", s AS (SELECT
 sum(z.population*{shared('w','z')}/{area('z')}) AS served FROM ward w JOIN zone z
 ON {meet('w','z')}), t AS (SELECT sum(population) AS total FROM zone)
 SELECT round(served,2) AS served, round(total,2) AS total,
 round(CASE WHEN total>0 THEN least(1,greatest(0,served/total)) ELSE 0 END,4) AS ratio
 FROM s, t""")
def coverage_ratio(spark, d):
    return aggregation.coverage_summary(
        boxes(spark, d, "ward"),
        boxes(spark, d, "zone", "z_", ["population"]), BOX, pbox("z_"), "z_population")


@query(with_layers("zone", "constraint").replace("constraint AS", "cons AS") + f""",
 hit AS (SELECT z.id, greatest(z.minx,c.minx) AS x0, greatest(z.miny,c.miny) AS y0,
 least(z.maxx,c.maxx) AS x1, least(z.maxy,c.maxy) AS y1 FROM zone z JOIN cons c
 ON {meet('z','c')}), xs AS (SELECT DISTINCT id, unnest([x0,x1]) AS x FROM hit),
 sl AS (SELECT id, x AS a, lead(x) OVER (PARTITION BY id ORDER BY x) AS b FROM xs),
 ys AS (SELECT DISTINCT sl.id, a, b, unnest([y0,y1]) AS y FROM sl JOIN hit h ON h.id=sl.id
 AND h.x0<=a AND h.x1>=b WHERE b IS NOT NULL),
 cl AS (SELECT id, a, b, y AS c, lead(y) OVER (PARTITION BY id,a,b ORDER BY y) AS d2 FROM ys),
 cov AS (SELECT id, sum((b-a)*(d2-c)) AS ar FROM cl WHERE d2 IS NOT NULL AND EXISTS
 (SELECT 1 FROM hit h WHERE h.id=cl.id AND h.x0<=a AND h.x1>=b AND h.y0<=c AND h.y1>=d2)
 GROUP BY id)
 SELECT z.id AS zone_id, round(least(1,coalesce(ar,0)/{area('z')}),4) AS fraction
 FROM zone z LEFT JOIN cov USING (id)""")
def overlay_area_fraction(spark, d):
    out = overlay.overlay_fraction(boxes(spark, d, "zone"), boxes(spark, d, "constraint", "c_"),
                                   BOX, pbox("c_"), ["id"])
    return out.select(F.col("id").alias("zone_id"), F.round("fraction", 4).alias("fraction"))


@query(with_layers("zone", "building") + """, h AS (SELECT b.id, b.population_estimate AS v,
 min(z.id) AS zid FROM building b JOIN zone z ON (b.minx+b.maxx)/2>z.minx
 AND (b.minx+b.maxx)/2<z.maxx AND (b.miny+b.maxy)/2>z.miny AND (b.miny+b.maxy)/2<z.maxy
 GROUP BY b.id, b.population_estimate)
 SELECT z.id AS zone_id, coalesce(CAST(sum(v) AS DOUBLE),0) AS total,
 CAST(count(v) AS DOUBLE) AS n, round(coalesce(avg(v),0),4) AS mean,
 coalesce(max(v),0) AS largest, coalesce(min(v),0) AS smallest
 FROM zone z LEFT JOIN h ON h.zid=z.id GROUP BY z.id""")
def aggregate_by_zone(spark, d):
    b = layer(spark, d, "building").select(
        F.col("id").alias("b_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"), "population_estimate")
    out = aggregation.aggregate_by_zone(
        b, boxes(spark, d, "zone"), feature_key="b_id", zone_key="id", zone_box=BOX,
        value=F.col("population_estimate"),
        statistics={"total": "sum", "n": "count", "mean": "mean", "largest": "max",
                    "smallest": "min"})
    return out.withColumnRenamed("id", "zone_id").withColumn("mean", F.round("mean", 4))
