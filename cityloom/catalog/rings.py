"""Overlays of shapes that are no boxes: six-cornered areas with a hole, and grown ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import half_even
from ..operators import constraints, exposure, sweep
from ..operators.overlay import BOX, pbox
from ..sources.layers import layer, with_layers
from . import query
from .hazards import landcover
from .shapes import SWEEP, WATER_BUFFER, both, grown_sql, hexagon, hexagon_area, shaped
from .spatial import meet

@query(with_layers("zone", "constraint").replace("constraint AS", "cons AS") + f""", poly AS (
 SELECT z.id AS k, 0 AS layer, {both('z')} AS p FROM zone z UNION ALL
 SELECT z.id, 1, {both('c')} FROM zone z JOIN cons c ON {meet('z','c')}), {SWEEP}
 SELECT z.id AS zone_id, round(least(1,coalesce(sw.both,0)/{hexagon_area('z')}),4) AS fraction
 FROM zone z LEFT JOIN sw ON sw.k=z.id""")
def ring_overlay_fraction(spark, d):
    """Share of each zone's shape that the union of the constraints' shapes covers."""
    out = sweep.overlay_fraction(shaped(spark, d, "zone"), shaped(spark, d, "constraint", "c_"), BOX, pbox("c_"),
                                 ["id"], ("rings", "c_rings"))
    return out.select(F.col("id").alias("zone_id"), F.round("fraction", 4).alias("fraction"))


@query(with_layers("constraint").replace("constraint AS", "cons AS") + f""", poly AS (
 SELECT coalesce(severity,'none') AS k, 0 AS layer, {both('c')} AS p FROM cons c), {SWEEP}
 SELECT k AS severity, round_even(one,2) AS area FROM sw""")
def ring_dissolved_area(spark, d):
    """Area of the dissolved constraint shapes of each severity."""
    c = shaped(spark, d, "constraint", extra=["severity"]).withColumn("severity", F.coalesce("severity", F.lit("none")))
    return sweep.union_area(c, ["severity"]).select("severity", half_even("area", 2).alias("area"))


@query(with_layers("water") + f""", ri AS (SELECT id, {WATER_BUFFER}+id%3*10 AS d, {both('w')} AS p FROM water w),
 {grown_sql('ri')}, {SWEEP} SELECT k AS water_id, round_even(one,2) AS area FROM sw""")
def ring_buffer_area(spark, d):
    """Area of each lake's shape grown by its own distance."""
    grown = sweep.buffer_areas(shaped(spark, d, "water"), ["id"], "rings", F.lit(WATER_BUFFER) + F.col("id") % 3 * 10)
    return grown.select(F.col("id").alias("water_id"), half_even("area", 2).alias("area"))


@query(with_layers("constraint", "zone", "building", "facility").replace("constraint AS", "cons AS") + f""",
 pa AS (SELECT 'u' AS k, 0 AS layer, {both('c')} AS p FROM cons c UNION ALL
 SELECT 'z'||z.id, 0, {both('z')} FROM zone z UNION ALL
 SELECT 'z'||z.id, 1, {both('c')} FROM zone z JOIN cons c ON {meet('z','c')} UNION ALL
 SELECT 'b'||b.id||' '||c.id, 0, {both('b')} FROM building b JOIN cons c ON {meet('b','c')} UNION ALL
 SELECT 'b'||b.id||' '||c.id, 1, {both('c')} FROM building b JOIN cons c ON {meet('b','c')}),
 poly AS (SELECT * FROM pa), {SWEEP}, tn AS (SELECT a.k, (a.x1-a.x0)*(b.y0-a.y0)-(a.y1-a.y0)*(b.x0-a.x0) AS t0,
 (a.x1-a.x0)*(b.y1-a.y0)-(a.y1-a.y0)*(b.x1-a.x0) AS t1, (b.x1-b.x0)*(a.y0-b.y0)-(b.y1-b.y0)*(a.x0-b.x0) AS t2,
 (b.x1-b.x0)*(a.y1-b.y0)-(b.y1-b.y0)*(a.x1-b.x0) AS t3 FROM eg a JOIN eg b ON a.k=b.k AND a.layer=0 AND b.layer=1 AND a.k LIKE 'b%'
 AND a.x0<=b.x1 AND b.x0<=a.x1 AND least(a.y0,a.y1)<=greatest(b.y0,b.y1) AND least(b.y0,b.y1)<=greatest(a.y0,a.y1)),
 eb AS (SELECT * FROM building WHERE id IN (SELECT CAST(split_part(substr(k,2),' ',1) AS BIGINT) FROM (
 SELECT k FROM sw WHERE k LIKE 'b%' AND "both">0 UNION ALL SELECT k FROM tn WHERE t0*t1<=0 AND t2*t3<=0))), inr AS (SELECT f.id, abs(f.x-(c.minx+c.maxx)/2)/(c.maxx-c.minx) AS u,
 abs(f.y-(c.miny+c.maxy)/2)/(c.maxy-c.miny) AS v FROM facility f JOIN cons c ON f.x BETWEEN c.minx AND c.maxx AND f.y BETWEEN c.miny AND c.maxy)
 SELECT round_even((SELECT one FROM sw WHERE k='u'),2) AS hazard_area,
 (SELECT count(*) FROM eb) AS buildings_exposed, (SELECT count(*) FROM building) AS buildings_total,
 round_even((SELECT count(*) FROM eb)/CAST((SELECT count(*) FROM building) AS DOUBLE),4) AS buildings_exposed_ratio,
 round_even((SELECT coalesce(sum(population*"both"/{hexagon_area('z')}),0) FROM zone z JOIN sw ON sw.k='z'||z.id),1) AS population_exposed,
 (SELECT coalesce(sum(population_estimate),0) FROM eb) AS population_exposed_from_buildings,
 (SELECT count(DISTINCT id) FROM inr WHERE u<=0.5-v/2 AND u+v>=0.25) AS facilities_exposed""")
def ring_flood_exposure(spark, d):
    """Exposure to the union of flood shapes with dry middles."""
    f = layer(spark, d, "facility").select(F.col("id").alias("f_id"), "x", "y")
    return exposure.flood_exposure(shaped(spark, d, "constraint", "h_"), shaped(spark, d, "building", extra=["population_estimate"]),
                                   shaped(spark, d, "zone", "z_", ["population"]), f, rings=True)


@query(with_layers("parcel", "zone") + f""", pr AS (SELECT p.id||' '||z.id AS k, p.id AS pid, z.id%6 AS kind, p.minx, p.miny, p.maxx,
 p.maxy, {both('z')} AS lp FROM parcel p JOIN zone z ON {meet('p','z')}),
 poly AS (SELECT k, 1 AS layer, lp AS p FROM pr UNION ALL SELECT k, 0, {both('q')} FROM (SELECT DISTINCT k, minx, miny, maxx, maxy FROM pr) q),
 {SWEEP}, cv AS (SELECT pid, CASE kind WHEN 0 THEN 'forest' WHEN 1 THEN 'grassland' WHEN 2 THEN 'built' WHEN 3 THEN 'cropland'
 WHEN 4 THEN 'mystery' ELSE 'unknown' END AS land_use, sum("both") AS a FROM sw JOIN (SELECT DISTINCT k, pid, kind FROM pr) USING (k)
 WHERE "both">0 GROUP BY ALL)
 SELECT p.id, cv.land_use, round_even(a,2) AS area_converted, round_even(a/{hexagon_area('p')},4) AS share_of_footprint,
 CASE cv.land_use WHEN 'forest' THEN 1e0 WHEN 'grassland' THEN 0.6e0 WHEN 'built' THEN 0.05e0 WHEN 'cropland' THEN 0.5e0
 ELSE 0.3e0 END AS sensitivity_weight FROM cv JOIN parcel p ON p.id=cv.pid""")
def ring_land_conversion(spark, d):
    """Area of each land cover under the footprints, shape by shape."""
    cover = landcover(spark, d).withColumn("l_rings", hexagon("l_"))
    return exposure.land_conversion(shaped(spark, d, "parcel"), cover, rings=("rings", "l_rings")).drop("_area", "_whole")


@query(with_layers("parcel", "constraint").replace("constraint AS", "cons AS") + f""", cb AS (SELECT *, CASE id%3 WHEN 0 THEN 0e0
 WHEN 1 THEN 20e0 ELSE 45e0 END AS d FROM cons), nr AS (SELECT p.id AS pid, c.id AS cid, c.d FROM parcel p JOIN cb c ON
 c.minx-d<=p.maxx AND c.maxx+d>=p.minx AND c.miny-d<=p.maxy AND c.maxy+d>=p.miny),
 ri AS (SELECT id, d, {both('c')} AS p FROM cb c), {grown_sql('(SELECT * FROM ri WHERE d>0)').replace("poly AS", "gp AS")},
 poly AS (SELECT pid||' '||cid AS k, 0 AS layer, {both('q')} AS p FROM nr JOIN parcel q ON q.id=pid UNION ALL
 SELECT pid||' '||cid, 1, p FROM nr JOIN (SELECT k AS id, p FROM gp UNION ALL SELECT id, p FROM ri WHERE d=0) x ON x.id=cid), {SWEEP}
 SELECT pid AS parcel_id, cid AS constraint_id, round_even(sw."both"/{hexagon_area('p')},4) AS overlap FROM nr
 JOIN sw ON sw.k=pid||' '||cid JOIN parcel p ON p.id=pid WHERE round_even(sw."both"/{hexagon_area('p')},4)>0""")
def ring_constraint_overlap(spark, d):
    """Share of each parcel's shape inside each constraint's shape, grown by its buffer."""
    p = shaped(spark, d, "parcel").withColumn("area", g.area("rings"))
    c = shaped(spark, d, "constraint", "c_").withColumns({
        "c_type": F.lit("area"), "c_severity": F.lit("soft"), "c_weight": F.lit(1.0),
        "c_buffer": F.expr("CASE c_id%3 WHEN 0 THEN 0D WHEN 1 THEN 20D ELSE 45D END")})
    hits = constraints.constraint_hits(p, c, key=["id"], rings=True)
    return hits.select(F.col("id").alias("parcel_id"), F.col("c_id").alias("constraint_id"),
                       half_even("overlap", 4).alias("overlap")).where("overlap > 0")
