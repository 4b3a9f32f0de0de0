"""Hazard, flood and environmental exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import comparison, exposure, overlay
from ..operators.overlay import BOX, pbox, prefixed
from ..session import cut
from ..sources.layers import STREETS_SQL, layer, streets, with_layers
from . import query
from .planning import disc_sql
from .shapes import SWEEP, WATER_BUFFER, rounded_sql
from .spatial import area, boxes, meet, shared

MEASURES = ["early_warning", "flood_barrier", "fire_break", "building_retrofit",
            "road_redundancy", "backup_power"]
KEY = ["hazard_id", "run"]


def hazards(spark, d):
    """Every hazard twice: as it is, and with all measures."""
    runs = F.explode(F.array(
        F.struct(F.lit("base").alias("run"), F.array().cast("array<string>").alias("measures")),
        F.struct(F.lit("mitigated").alias("run"),
                 F.array(*[F.lit(m) for m in MEASURES]).alias("measures"))))
    h = layer(spark, d, "hazard").withColumnRenamed("id", "hazard_id").withColumn("r", runs)
    return exposure.build_hazards(h.select("*", "r.run", "r.measures").drop("r"))


HAZ = """hz AS (SELECT id AS hazard_id, run, hazard_type, cx, cy, intensity,
 radius_m*CASE WHEN run='mitigated' AND hazard_type='flood' THEN 0.70e0
 WHEN run='mitigated' AND hazard_type='fire' THEN 0.75e0 ELSE 1e0 END AS r,
 CASE hazard_type WHEN 'fire' THEN 0.55e0 WHEN 'flood' THEN 1e0 WHEN 'earthquake' THEN 0.35e0
 ELSE 0.9e0 END AS core, CASE WHEN run='mitigated' THEN 0.55e0 ELSE 1e0 END AS fb,
 CASE WHEN run='mitigated' THEN 0.45e0 ELSE 1e0 END AS fp,
 CASE WHEN run='mitigated' THEN 0.25e0 ELSE 1e0 END AS ff
 FROM hazard, (SELECT unnest(['base','mitigated']) AS run))"""
DIST = "sqrt(({x}-cx)*({x}-cx)+({y}-cy)*({y}-cy))"
BD = DIST.format(x="((b.minx+b.maxx)/2)", y="((b.miny+b.maxy)/2)")


@query(with_layers("hazard") + f", {HAZ} SELECT hazard_id, run, round(r,4) AS radius_m, fb AS f_buildings, fp AS f_population FROM hz")
def measure_factors(spark, d):
    return hazards(spark, d).select("hazard_id", "run", F.round("radius_m", 4).alias("radius_m"),
                                    "f_buildings", "f_population")


BHIT = f"""bh AS (SELECT hazard_id, run, b.id, intensity*(1-{BD}/r) AS sev, population_estimate
 FROM hz JOIN building b ON {BD}<r)"""


@query(with_layers("hazard", "building") + f""", {HAZ}, {BHIT} SELECT hazard_id, run,
 id AS building_id, round(sev,6) AS severity, CASE WHEN sev>0.66 THEN 'severe' WHEN sev>0.33
 THEN 'moderate' ELSE 'light' END AS damage_state FROM bh WHERE sev>0""")
def hazard_buildings(spark, d):
    hits = exposure.hazard_hits(hazards(spark, d), boxes(spark, d, "building"))
    return hits.select("hazard_id", "run", F.col("id").alias("building_id"),
                       F.round("severity", 6).alias("severity"), "damage_state")


ZPOP = f"""zp AS (SELECT hazard_id, run, sum(population*1.0137e0*{disc_sql('cx','cy','r','z')}
 /((z.maxx-z.minx)*(z.maxy-z.miny))) AS pop FROM hz JOIN zone z ON z.minx<cx+r AND z.maxx>cx-r
 AND z.miny<cy+r AND z.maxy>cy-r GROUP BY 1,2)"""


def facility_boxes(spark, d):
    f = layer(spark, d, "facility")
    return f.select(F.col("id").alias("f_id"), F.col("x").alias("f_minx"), F.col("y").alias("f_miny"),
                    F.col("x").alias("f_maxx"), F.col("y").alias("f_maxy"))


def street_lines(spark, d):
    s = streets(spark, d)
    return s.select(F.col("id").alias("road_id"), F.array(F.array(
        g.vertex("x0", "y0"), g.vertex("x1", "y1"))).alias("rings"),
        F.col("x0").alias("r_minx"), F.col("y0").alias("r_miny"),
        F.col("x1").alias("r_maxx"), F.col("y1").alias("r_maxy"))


RD = ("sqrt(pow(greatest(x0-cx,cx-x1,0),2)+pow(greatest(y0-cy,cy-y1,0),2))")
ROADS = f"""st AS ({STREETS_SQL}), rh AS (SELECT hazard_id, run, CAST(st.id AS VARCHAR) AS road_id,
 CASE WHEN {RD}<=greatest(r*core,1) THEN 'blocked' ELSE 'slowed' END AS effect FROM hz JOIN st
 ON {RD}<=greatest(r,1)), rk AS (SELECT *, row_number() OVER (PARTITION BY hazard_id, run, effect
 ORDER BY road_id) AS rn, count(*) OVER (PARTITION BY hazard_id, run, effect) AS n FROM rh),
 rr AS (SELECT hazard_id, run, road_id, effect FROM rk WHERE effect='slowed' OR run='base'
 OR rn<=round_even(n*0.60e0,0))"""


def summary(spark, d):
    h = cut(hazards(spark, d))
    zones = boxes(spark, d, "zone", "z_", ["population"]).withColumn(
        "z_population", F.col("z_population") * 1.0137)
    return exposure.hazard_summary(
        h, KEY, buildings=exposure.hazard_hits(
            h, boxes(spark, d, "building", extra=["population_estimate"])),
        zones=exposure.hazard_population(h, zones, KEY),
        facilities=exposure.hazard_hits(h, facility_boxes(spark, d), pbox("f_")),
        roads=cut(exposure.hazard_roads(h, street_lines(spark, d), KEY)))


SUMMARY = with_layers("hazard", "building", "zone", "facility") + f""", {HAZ}, {BHIT}, {ZPOP}, {ROADS},
 rc AS (SELECT hazard_id, run, count(*) FILTER (effect='blocked') AS rb,
 count(*) FILTER (effect='slowed') AS rs FROM rr GROUP BY 1,2),
 bs AS (SELECT hazard_id, run, count(*) AS n, count(*) FILTER (sev>0.66) AS s FROM bh
 WHERE sev>0 GROUP BY 1,2), fh AS (SELECT hazard_id, run, count(*) AS f FROM hz JOIN facility
 ON {DIST.format(x='x', y='y')}<r GROUP BY 1,2),
 su AS (SELECT hz.hazard_id, hz.run, round_even(r,1) AS hazard_radius_m,
 round_even(32*sin(2*pi()/64)*r*r/1e6,4) AS hazard_area_km2, coalesce(n,0) AS buildings_affected,
 CAST(round_even(coalesce(s,0)*fb,0) AS BIGINT) AS buildings_severe,
 round_even(coalesce(pop,0),1) AS population_exposed,
 round_even(coalesce(pop,0)*fp,1) AS population_at_risk, coalesce(f,0) AS facilities_affected,
 CAST(round_even(coalesce(f,0)*ff,0) AS BIGINT) AS facilities_offline,
 coalesce(rb,0) AS roads_blocked, coalesce(rs,0) AS roads_slowed
 FROM hz LEFT JOIN bs USING (hazard_id, run) LEFT JOIN zp USING (hazard_id, run)
 LEFT JOIN fh USING (hazard_id, run) LEFT JOIN rc USING (hazard_id, run))"""


@query(SUMMARY + " SELECT * FROM su")
def hazard_summary(spark, d):
    return summary(spark, d)


DELTAS = """, lo AS (UNPIVOT (SELECT hazard_id, run,
 CAST(population_at_risk AS DOUBLE) AS population_at_risk,
 CAST(buildings_severe AS DOUBLE) AS buildings_severe,
 CAST(facilities_offline AS DOUBLE) AS facilities_offline,
 CAST(roads_blocked AS DOUBLE) AS roads_blocked,
 CAST(hazard_radius_m AS DOUBLE) AS hazard_radius_m,
 CAST(hazard_area_km2 AS DOUBLE) AS hazard_area_km2 FROM su)
 ON population_at_risk, buildings_severe, facilities_offline, roads_blocked, hazard_radius_m,
 hazard_area_km2 INTO NAME metric VALUE v)
 SELECT b.hazard_id, b.metric, round_even(b.v,2) AS {before}, round_even(a.v,2) AS {after},
 round_even(a.v-b.v,2) AS delta, CASE WHEN b.v<>0 THEN round_even((a.v-b.v)/abs(b.v)*100.0,1) ELSE 0 END
 AS pct_change, a.v-b.v<0 AS improved FROM lo b JOIN lo a ON a.hazard_id=b.hazard_id
 AND a.metric=b.metric AND b.run='base' AND a.run='mitigated'"""


@query(SUMMARY + DELTAS.format(before="baseline", after="with_measures"))
def compare_measures(spark, d):
    s = cut(summary(spark, d))
    rows = exposure.metric_rows(s, KEY)
    out = comparison.run_deltas(rows, "base", "mitigated", by=["hazard_id"], digits=2,
                                pct_digits=1, zero_pct=0.0)
    return out.withColumnsRenamed({"before": "baseline", "after": "with_measures"})


@query(with_layers("hazard") + f", {HAZ}, {ROADS} SELECT * FROM rr")
def hazard_roads(spark, d):
    return exposure.hazard_roads(hazards(spark, d), street_lines(spark, d), KEY)


@query(with_layers("hazard") + f""", {HAZ}, {ROADS} SELECT hazard_id, road_id, effect FROM rr
 WHERE run='base' UNION ALL SELECT hazard_id, road_id, 'reopened' FROM rr b WHERE run='base'
 AND effect='blocked' AND NOT EXISTS (SELECT 1 FROM rr m WHERE m.run='mitigated'
 AND m.effect='blocked' AND m.hazard_id=b.hazard_id AND m.road_id=b.road_id)""")
def network_impact(spark, d):
    r = cut(exposure.hazard_roads(hazards(spark, d), street_lines(spark, d), KEY))
    return exposure.network_impact(r.where("run = 'base'").drop("run"),
                                   r.where("run = 'mitigated'").drop("run"), ["hazard_id"])


# ------------------------------------------------------------------ flood overlays
def flood_boxes(spark, d):
    return boxes(spark, d, "constraint").select(*[F.col(c).alias("h_" + c) for c in BOX])


FLOOD_UNION = f"""hz AS (SELECT minx, miny, maxx, maxy FROM cons),
 hit AS (SELECT z.id, greatest(z.minx,c.minx) AS x0, greatest(z.miny,c.miny) AS y0,
 least(z.maxx,c.maxx) AS x1, least(z.maxy,c.maxy) AS y1 FROM zone z JOIN hz c ON {meet('z','c')}),
 xs AS (SELECT DISTINCT id, unnest([x0,x1]) AS x FROM hit),
 sl AS (SELECT id, x AS a, lead(x) OVER (PARTITION BY id ORDER BY x) AS b FROM xs),
 ys AS (SELECT DISTINCT sl.id, a, b, unnest([y0,y1]) AS y FROM sl JOIN hit h ON h.id=sl.id
 AND h.x0<=a AND h.x1>=b WHERE b IS NOT NULL),
 cl AS (SELECT id, a, b, y AS c, lead(y) OVER (PARTITION BY id,a,b ORDER BY y) AS d2 FROM ys),
 cov AS (SELECT id, sum((b-a)*(d2-c)) AS ar FROM cl WHERE d2 IS NOT NULL AND EXISTS
 (SELECT 1 FROM hit h WHERE h.id=cl.id AND h.x0<=a AND h.x1>=b AND h.y0<=c AND h.y1>=d2)
 GROUP BY id), ux AS (SELECT DISTINCT unnest([minx,maxx]) AS x FROM hz),
 us AS (SELECT x AS a, lead(x) OVER (ORDER BY x) AS b FROM ux),
 uy AS (SELECT DISTINCT a, b, unnest([miny,maxy]) AS y FROM us JOIN hz ON minx<=a AND maxx>=b),
 uc AS (SELECT a, b, y AS c, lead(y) OVER (PARTITION BY a,b ORDER BY y) AS d2 FROM uy),
 ua AS (SELECT sum((b-a)*(d2-c)) AS area FROM uc WHERE d2 IS NOT NULL AND EXISTS (SELECT 1
 FROM hz WHERE minx<=a AND maxx>=b AND miny<=c AND maxy>=d2))"""


@query(with_layers("constraint", "zone", "building", "facility").replace("constraint AS", "cons AS")
       + f""", {FLOOD_UNION}, eb AS (SELECT * FROM building b WHERE EXISTS (SELECT 1 FROM hz
 WHERE {meet('b','hz')})) SELECT round_even(area,2) AS hazard_area,
 (SELECT count(*) FROM eb) AS buildings_exposed, (SELECT count(*) FROM building) AS buildings_total,
 round_even((SELECT count(*) FROM eb)/CAST((SELECT count(*) FROM building) AS DOUBLE),4)
 AS buildings_exposed_ratio, round_even((SELECT sum(population*ar/{area('zone')}) FROM zone
 JOIN cov USING (id)),1) AS population_exposed,
 (SELECT sum(population_estimate) FROM eb) AS population_exposed_from_buildings,
 (SELECT count(*) FROM facility f WHERE EXISTS (SELECT 1 FROM hz WHERE x>=minx AND x<=maxx
 AND y>=miny AND y<=maxy)) AS facilities_exposed FROM ua""")
def flood_exposure(spark, d):
    f = layer(spark, d, "facility").select(F.col("id").alias("f_id"), "x", "y")
    return exposure.flood_exposure(
        flood_boxes(spark, d), boxes(spark, d, "building", extra=["population_estimate"]),
        boxes(spark, d, "zone", "z_", ["population"]), f)


@query(with_layers("constraint").replace("constraint AS", "cons AS") + f""",
 zone AS (SELECT 0 AS id, 0e0 AS minx, 0e0 AS miny, 0e0 AS maxx, 0e0 AS maxy), {FLOOD_UNION}
 SELECT round(area,2) AS area FROM ua""")
def dissolved_area(spark, d):
    """Area of the dissolved constraints."""
    c = boxes(spark, d, "constraint").withColumn("mask", F.lit(1))
    return overlay.union_area(c, ["mask"], BOX).select(F.round("area", 2).alias("area"))


# -------------------------------------------------------------------- environment
def landcover(spark, d):
    kind = F.expr("CASE id%6 WHEN 0 THEN 'forest' WHEN 1 THEN 'grassland' WHEN 2 THEN 'built' "
                  "WHEN 3 THEN 'cropland' WHEN 4 THEN 'mystery' ELSE NULL END")
    z = layer(spark, d, "zone").select("id", *BOX).withColumn("land_use", kind)
    return prefixed(z, "l_")


CONV = f"""lc AS (SELECT id, minx, miny, maxx, maxy, coalesce(CASE id%6 WHEN 0 THEN 'forest'
 WHEN 1 THEN 'grassland' WHEN 2 THEN 'built' WHEN 3 THEN 'cropland' WHEN 4 THEN 'mystery'
 ELSE NULL END,'unknown') AS land_use FROM zone), cv AS (SELECT p.id, l.land_use,
 sum({shared('p','l')}) AS a, {area('p')} AS w FROM parcel p JOIN lc l ON {meet('p','l')}
 WHERE {shared('p','l')}>0 GROUP BY p.id, l.land_use, {area('p')}), cs AS (SELECT *,
 CASE land_use WHEN 'forest' THEN 1e0 WHEN 'grassland' THEN 0.6e0 WHEN 'built' THEN 0.05e0
 WHEN 'cropland' THEN 0.5e0 ELSE 0.3e0 END AS sens FROM cv)"""


@query(with_layers("parcel", "zone") + f""", {CONV} SELECT id, land_use, round_even(a,2)
 AS area_converted, round_even(a/w,4) AS share_of_footprint, sens AS sensitivity_weight FROM cs""")
def land_conversion(spark, d):
    return exposure.land_conversion(boxes(spark, d, "parcel"), landcover(spark, d)).drop(
        "_area", "_whole")


@query(with_layers("parcel", "zone", "water") + f""", poly AS (SELECT p.id AS k, 1 AS layer,
 {rounded_sql('w', WATER_BUFFER)} AS p FROM parcel p JOIN water w ON w.minx-{WATER_BUFFER}<=p.maxx AND w.maxx+{WATER_BUFFER}>=p.minx
 AND w.miny-{WATER_BUFFER}<=p.maxy AND w.maxy+{WATER_BUFFER}>=p.miny UNION ALL SELECT id, 0, [{{'x': minx, 'y': miny}},
 {{'x': maxx, 'y': miny}}, {{'x': maxx, 'y': maxy}}, {{'x': minx, 'y': maxy}}, {{'x': minx, 'y': miny}}] FROM parcel p
 WHERE EXISTS (SELECT 1 FROM water w WHERE w.minx-{WATER_BUFFER}<=p.maxx AND w.maxx+{WATER_BUFFER}>=p.minx
 AND w.miny-{WATER_BUFFER}<=p.maxy AND w.maxy+{WATER_BUFFER}>=p.miny)), {SWEEP}, {CONV}, s AS (SELECT id, sum(a) AS a,
 sum(CASE WHEN land_use IN ('forest','grassland') THEN a ELSE 0 END) AS gr, sum(a*sens) AS w2,
 count(*) AS n FROM cs GROUP BY id) SELECT p.id, round_even({area('p')},2) AS footprint_area,
 round_even(coalesce(a,0),2) AS area_converted, round_even(coalesce(gr,0),2) AS green_cover_lost,
 round_even(coalesce(sw.both,0),2) AS water_buffer_intrusion, round_even(coalesce(w2,0)/{area('p')},4) AS impact_index,
 coalesce(n,0) AS landcover_classes_affected FROM parcel p LEFT JOIN s USING (id) LEFT JOIN sw ON sw.k=p.id""")
def environmental_impact(spark, d):
    p = boxes(spark, d, "parcel")
    water = boxes(spark, d, "water").select(g.box_rings(*BOX).alias("w_rings"))
    intrusion = exposure.water_intrusion(p.withColumn("rings", g.box_rings(*BOX)), water, WATER_BUFFER)
    return exposure.environmental_summary(exposure.land_conversion(p, landcover(spark, d)), p, intrusion)
