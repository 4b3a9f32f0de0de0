"""Scans, mappings, region features, exports, stores and derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import REGION_CAP, REGION_CAPS
from ..functions import geometry as g
from ..functions import projection, scalars
from ..operators import aggregation, network
from ..operators.overlay import BOX
from ..plans import derive, lookup
from ..sources import city, export, regions, stores
from ..sources.layers import layer, table, with_layers
from . import query
from .spatial import area, gap

WINDOW = (2000.0, 2000.0, 6000.0, 7000.0)
IN = "{t}.maxx>=2000 AND {t}.maxy>=2000 AND {t}.minx<=6000 AND {t}.miny<=7000"


def stored_parcels(spark, d):
    return layer(spark, d, "parcel").withColumns({
        "area_m2": g.box_area(*BOX), "development_status": F.expr(
            "CASE WHEN id%6=0 THEN NULL ELSE status END"),
        "slope_deg": F.col("slope").cast("decimal(4,2)"), "elevation_m": F.lit(None).cast("double")})


@query(with_layers("parcel") + f""" SELECT CAST(id AS VARCHAR) AS id, {area('p')} AS area, land_use,
 CASE WHEN id%6=0 THEN 'candidate' ELSE status END AS status, slope FROM parcel p
 WHERE {IN.format(t='p')} AND land_use='economy' AND {area('p')}>=2000""")
def scan_parcels(spark, d):
    t = city.scan(stored_parcels(spark, d), WINDOW, equals={"land_use": "economy", "zoning": None},
                  min_area_m2=2000.0)
    return city.to_parcels(t).select("id", "area", "land_use", "status", "slope")


@query(with_layers("facility") + """ SELECT CAST(id AS VARCHAR) AS id, type, capacity FROM facility
 WHERE type='school' AND x>=2000 AND y>=2000 AND x<=6000 AND y<=7000""")
def scan_facilities(spark, d):
    f = layer(spark, d, "facility").withColumnRenamed("service_radius", "service_radius_m")
    t = city.scan(f, WINDOW, equals={"type": "school"}, box=("x", "y", "x", "y"))
    return city.to_facilities(t).select("id", "type", "capacity")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size%4=3 THEN 'residential' ELSE
 CASE p_size%4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'service' END END AS road_class,
 CASE WHEN p_size%5=0 THEN 2 ELSE p_size%5 END AS lanes,
 CASE WHEN p_size%3=0 THEN 40e0 ELSE CAST(p_size AS DOUBLE) END AS speed FROM part
 WHERE p_size%4 IN (0,3)""")
def scan_roads(spark, d):
    t = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "CASE p_size%4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 "
        "THEN 'service' END AS road_class", "CAST(7 AS DECIMAL(4,2)) AS width_m",
        "p_size%5 AS lanes", "CASE WHEN p_size%3=0 THEN NULL ELSE p_size END AS speed_limit",
        "CAST(NULL AS INT) AS capacity", "CAST(NULL AS BOOLEAN) AS oneway")
    t = t.where("road_class IN ('primary') OR road_class IS NULL")
    return city.to_roads(t).select("id", "road_class", "lanes", "speed")


@query(with_layers("zone") + f""" SELECT CAST(id AS VARCHAR) AS id, population FROM zone z
 WHERE {IN.format(t='z')}""")
def scan_zones(spark, d):
    z = layer(spark, d, "zone").withColumns({"density_per_sqkm": F.lit(None).cast("double"),
                                             "households": F.lit(0)})
    return city.to_zones(city.scan(z, WINDOW)).select("id", "population")


@query(with_layers("building") + f""" SELECT CAST(id AS VARCHAR) AS id, height, population_estimate
 FROM building b WHERE {IN.format(t='b')}""")
def scan_buildings(spark, d):
    b = layer(spark, d, "building").withColumns({
        "height_m": F.col("height"), "floors": F.lit(1), "land_use": F.lit("mixed"),
        "confidence": F.lit(0.5)})
    return city.to_buildings(city.scan(b, WINDOW)).select("id", "height", "population_estimate")


@query(with_layers("constraint", "water").replace("constraint AS", "craw AS") + """
 SELECT CAST(id AS VARCHAR) AS id, type, CASE upper(coalesce(severity,'HIGH')) WHEN 'HIGH' THEN
 'hard' ELSE 'soft' END AS severity, 0e0 AS buffer FROM craw UNION ALL
 SELECT 'water-'||id, 'water_buffer:'||type, 'hard', 30e0 FROM water""")
def constraints_with_water(spark, d):
    out = city.constraints_with_water(layer(spark, d, "constraint"), layer(spark, d, "water"), 30.0)
    return out.select("id", "type", "severity", "buffer")


@query(with_layers("parcel", "building", "zone") + """ SELECT min(minx) AS minx, min(miny) AS miny,
 max(maxx) AS maxx, max(maxy) AS maxy FROM (SELECT minx, miny, maxx, maxy FROM parcel UNION ALL
 SELECT minx, miny, maxx, maxy FROM building UNION ALL SELECT minx, miny, maxx, maxy FROM zone)""")
def city_extent(spark, d):
    return aggregation.extent(*[layer(spark, d, n) for n in ("parcel", "building", "zone")])


@query(with_layers("parcel", "building", "zone", "water") + """ SELECT 'parcels' AS layer,
 (SELECT count(*) FROM parcel) AS n UNION ALL SELECT 'buildings', (SELECT count(*) FROM building)
 UNION ALL SELECT 'water', (SELECT count(*) FROM water) UNION ALL SELECT 'flood', 0""")
def layer_catalogue(spark, d):
    counts = aggregation.layer_counts({"parcels": layer(spark, d, "parcel"),
                                       "buildings": layer(spark, d, "building"),
                                       "water": layer(spark, d, "water")})
    names = spark.createDataFrame([(n,) for n in ("parcels", "buildings", "water", "flood")],
                                  "layer string")
    return city.with_counts(names, counts)


@query(with_layers("parcel", "zone") + """, e AS (SELECT min(minx) AS a, min(miny) AS b, max(maxx)
 AS c, max(maxy) AS d FROM parcel), p AS (SELECT coalesce(sum(population),0) AS pop FROM zone)
 SELECT (a+c)/2 AS center_lon, (b+d)/2 AS center_lat, round_even((c-a)*111.0e0*(d-b)*105.0e0,2)
 AS area_km2, CAST(pop AS BIGINT) AS population, CAST(floor(pop/4.5e0) AS BIGINT) AS households
 FROM e, p""")
def city_headline(spark, d):
    pop = aggregation.total_population(layer(spark, d, "zone")).scalar()
    return aggregation.headline(aggregation.extent(layer(spark, d, "parcel")), pop)


# ---------------------------------------------------------------- region features
NAME = ("CASE {k}%4 WHEN 0 THEN 'adivali_devad' WHEN 1 THEN 'jnpt_port' WHEN 2 THEN 'chandigarh' "
        "ELSE 'rotterdam' END")
KIND = ("CASE id%9 WHEN 0 THEN 'yes' WHEN 1 THEN 'house' WHEN 2 THEN 'warehouse' WHEN 3 THEN '' "
        "WHEN 4 THEN 'Apartments' WHEN 5 THEN 'school' WHEN 6 THEN 'villa' WHEN 7 THEN NULL ELSE 'hut' END")


def features(spark, d):
    """Buildings, land use and water of four regions as one feature table."""
    def part(name, lay, kind, category):
        return layer(spark, d, name).select(
            F.expr(NAME.format(k="id")).alias("region"), F.lit(lay).alias("layer"), "id",
            F.expr(kind).alias("kind"), F.expr(category).alias("category"), *BOX,
            g.box_area(*BOX).alias("area"))
    return (part("building", "buildings", KIND, "''")
            .unionByName(part("parcel", "landuse", "land_use", "CASE id%3 WHEN 0 THEN '' WHEN 1 "
                              "THEN 'green' END"))
            .unionByName(part("water", "water", "'water'", "''")))


FEATURES = with_layers("building", "parcel", "water") + f""", ft AS (SELECT {NAME.format(k='id')} AS
 region, 'buildings' AS layer, id, {KIND} AS kind, '' AS category, minx, miny, maxx, maxy,
 {area('building')} AS area FROM building UNION ALL SELECT {NAME.format(k='id')}, 'landuse', id, land_use,
 CASE id%3 WHEN 0 THEN '' WHEN 1 THEN 'green' END, minx, miny, maxx, maxy, {area('parcel')} FROM parcel
 UNION ALL SELECT {NAME.format(k='id')}, 'water', id, 'water', '', minx, miny, maxx, maxy,
 {area('water')} FROM water)"""


@query(FEATURES + """ SELECT p.region||'_parcel_'||p.id AS id, CASE WHEN category<>'' THEN category
 ELSE kind END AS land_use, CASE WHEN EXISTS (SELECT 1 FROM ft w WHERE w.layer='water' AND
 w.region=p.region AND w.minx<=p.maxx+150 AND w.maxx>=p.minx-150 AND w.miny<=p.maxy+150 AND
 w.maxy>=p.miny-150) THEN 0.6e0 ELSE 0e0 END AS flood_risk FROM ft p WHERE layer='landuse'""")
def region_parcels(spark, d):
    return regions.parcels(features(spark, d)).select("id", "land_use", "flood_risk")


NOHOME = "lower(coalesce(kind,'')) IN ('warehouse','school')"
SHARE = "CASE WHEN lower(coalesce(kind,'')) IN ('house','apartments','hut') THEN 1e0 ELSE 0.75e0 END"


@query(FEATURES + f""", p AS (SELECT region, area, area*2*{SHARE}/30 AS pop FROM ft
 WHERE layer='buildings' AND NOT {NOHOME}) SELECT b.region, b.n AS buildings_total,
 count(pop) AS buildings_residential, round_even(sum(area),0) AS residential_footprint_m2,
 round_even(sum(pop),0) AS estimated_population FROM (SELECT region, count(*) AS n FROM ft
 WHERE layer='buildings' GROUP BY 1) b JOIN p ON p.region=b.region GROUP BY 1,2""")
def footprint_population(spark, d):
    return regions.population_evidence(features(spark, d))


@query(FEATURES + """, rg(region) AS (VALUES ('adivali_devad'),('jnpt_port'),('chandigarh'),('rotterdam'))
 SELECT rg.region, layer, n, ext_minx, ext_maxy FROM rg LEFT JOIN (SELECT region, layer, count(*) AS n,
 min(minx) AS ext_minx, max(maxy) AS ext_maxy FROM ft GROUP BY 1,2) f ON f.region=rg.region""")
def region_inventory(spark, d):
    out = regions.inventory(regions.region_table(spark), features(spark, d))
    return out.select("region", "layer", "n", "ext_minx", "ext_maxy")


@query(FEATURES + """, rk AS (SELECT *, row_number() OVER (PARTITION BY region, layer ORDER BY
 CASE WHEN region IN ('rotterdam','chandigarh') AND layer='buildings' THEN -area ELSE 0 END, id) AS rn
 FROM ft) SELECT region, layer, id FROM rk WHERE rn<=CASE WHEN region='rotterdam' AND
 layer='buildings' THEN 1200 WHEN region='chandigarh' AND layer='buildings' THEN 1500 ELSE 3000 END""")
def region_collection(spark, d):
    """Map features: the first 3000 of each layer, fewer in dense regions."""
    return regions.collection(features(spark, d), REGION_CAP, REGION_CAPS).select("region", "layer", "id")


# ------------------------------------------------------------------------ exports
@query(with_layers("zone") + """ SELECT '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[['
 ||minx||','||miny||'],['||maxx||','||miny||'],['||maxx||','||maxy||'],['||minx||','||maxy||'],['
 ||minx||','||miny||']]]},"properties":{"id":'||id||',"population":'||population||'}}' AS feature
 FROM zone""")
def features_geojson(spark, d):
    z = layer(spark, d, "zone").select("id", "population", g.box_rings(*BOX).alias("rings"), *BOX)
    return export.features_geojson(z, "population_zones", "Polygon", limit=None)


@query(with_layers("building", "parcel") + """ SELECT 'buildings' AS layer, id, CAST(NULL AS VARCHAR)
 AS land_use, height, CAST(o_orderdate AS VARCHAR) AS built FROM building JOIN orders ON o_orderkey=id
 UNION ALL SELECT 'parcels', id, land_use, NULL, NULL FROM parcel""")
def combined_map(spark, d):
    b = layer(spark, d, "building").join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("id"),
                                         F.col("o_orderdate").alias("built")), "id")
    return export.combined({"buildings": b.select("id", "height", "built"),
                            "parcels": layer(spark, d, "parcel").select("id", "land_use")})


@query(with_layers("building") + """ SELECT id, coalesce(height,9e0) AS extrude_height,
 CASE id%4 WHEN 0 THEN '#3498DB' WHEN 1 THEN '#E74C3C' WHEN 2 THEN '#2ECC71' ELSE '#4A90E2' END
 AS building_color FROM building""")
def buildings_3d(spark, d):
    b = layer(spark, d, "building").withColumns({
        "height_m": F.col("height"), "building_type": F.expr(
            "CASE id%4 WHEN 0 THEN 'school' WHEN 1 THEN 'clinic' WHEN 2 THEN 'residential' END")})
    return export.buildings_3d(b).select("id", "extrude_height", "building_color")


# ------------------------------------------------------------------------- stores
@query("""SELECT o_orderkey AS result_id, o_orderpriority AS analysis_type FROM orders
 WHERE o_custkey=7 AND upper(o_orderstatus)='O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def results_by_scenario(spark, d):
    r = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("scenario_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderdate").alias("created_at"))
    hit = stores.newest(r.withColumn("analysis_type", F.upper("status")).where("scenario_id = 7"),
                        "o", 50)
    return hit.select("result_id", F.col("kind").alias("analysis_type"))


@query("""WITH h AS (SELECT sha256('{"k":'||json_extract_string(props,'$.k')||'}') AS h, event_id, ts
 FROM events) SELECT h AS parameter_hash, max_by(event_id, (ts, event_id)) AS result_id FROM h GROUP BY 1""")
def parameter_hashes(spark, d):
    """Latest stored result per parameter hash."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy(scalars.parameter_hash(k.alias("k")).alias("parameter_hash")).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("result_id"))


@query("""SELECT user_id AS scenario_id, max(event_id) AS version, max_by(event_type, event_id) AS status,
 max_by(value, event_id) FILTER (event_id%3<>0) AS horizon FROM events GROUP BY 1""")
def scenario_versions(spark, d):
    v = table(spark, d, "events").selectExpr(
        "user_id AS scenario_id", "event_id AS version", "event_type AS status",
        "CASE WHEN event_id%3<>0 THEN value END AS horizon")
    return stores.latest_versions(v)


@query("""SELECT o_orderkey AS result_id, 'P'||o_custkey||' under '||coalesce(c_name,
 'Scenario '||o_custkey) AS recommendation, round_even(o_totalprice,1) AS overall_score,
 CAST(floor(o_totalprice/10) AS BIGINT) AS affected_population, 'benefit' AS population_role
 FROM orders LEFT JOIN customer ON c_custkey=o_custkey""")
def decision_records(spark, d):
    o = table(spark, d, "orders")
    res = o.select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("scenario_id"),
                   F.to_json(F.struct(F.array(F.struct(
                       F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("parcel_id"),
                       F.col("o_totalprice").alias("score"))).alias("records"))).alias("result_json"))
    met = o.select(F.col("o_orderkey").alias("result_id"), F.lit("population_served").alias("metric"),
                   F.floor(F.col("o_totalprice") / 10).cast("double").alias("value"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("scenario_id"),
                                               F.col("c_name").alias("name"))
    return stores.decision_records(res, met, names).drop("coverage_pct", "weighted_cost")


@query("""SELECT '{"id":'||event_id||',"type":"'||event_type||'"'||CASE WHEN event_id%4<>0 THEN
 ',"k":'||user_id ELSE '' END||'}' AS json FROM events""")
def drop_undetermined(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "event_type AS type",
                                             "CASE WHEN event_id%4<>0 THEN user_id END AS k")
    return stores.drop_undetermined(e)


# ------------------------------------------------------------------ labels, look-ups
@query("""SELECT o_orderkey AS id, CASE o_orderkey%4 WHEN 0 THEN 'Coverage' WHEN 1 THEN
 'Max Travel Time' WHEN 2 THEN 'Open Land Share' ELSE 'Graph Nodes' END AS label,
 CASE o_orderkey%4 WHEN 0 THEN 'ratio' WHEN 1 THEN 's' WHEN 3 THEN 'count' END AS unit,
 CASE o_orderkey%4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS better FROM orders""")
def metric_labels(spark, d):
    from ..operators.comparison import label_metrics
    m = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "CASE o_orderkey%4 WHEN 0 THEN 'coverage_ratio' WHEN 1 THEN "
        "'max_travel_time' WHEN 2 THEN 'open_land_share' ELSE 'nodes' END AS metric")
    return label_metrics(m).select("id", "label", "unit", "better")


@query(with_layers("parcel") + """, r AS (SELECT o_orderkey AS rid, CAST(o_orderkey%3000 AS VARCHAR)
 ||CASE WHEN o_orderkey%2=0 THEN '#1' ELSE '' END AS parcel_id FROM orders)
 SELECT rid, parcel_id, (minx+maxx)/2 AS lon, (miny+maxy)/2 AS lat FROM r LEFT JOIN parcel p
 ON p.id=CAST(split_part(parcel_id,'#',1) AS BIGINT)""")
def attach_positions(spark, d):
    r = table(spark, d, "orders").selectExpr(
        "o_orderkey AS rid", "concat(o_orderkey%3000, CASE WHEN o_orderkey%2=0 THEN '#1' ELSE '' END)"
        " AS parcel_id")
    p = layer(spark, d, "parcel").select("id", ((F.col("minx") + F.col("maxx")) / 2).alias("lon"),
                                         ((F.col("miny") + F.col("maxy")) / 2).alias("lat"))
    return lookup.attach_positions(r, p, "parcel_id")


@query("""SELECT e.event_id, CASE WHEN regexp_replace(t,'[^0-9]','','g')='' THEN NULL WHEN
 CAST(regexp_replace(t,'[^0-9]','','g') AS BIGINT)=0 THEN NULL ELSE
 CAST(regexp_replace(t,'[^0-9]','','g') AS BIGINT) END AS scenario_id FROM (SELECT event_id,
 CASE event_id%3 WHEN 0 THEN 'scn_baseline' WHEN 1 THEN ' '||user_id||' ' ELSE 'scn_'||user_id END AS t
 FROM events) e""")
def scenario_ids(spark, d):
    t = F.expr("CASE event_id%3 WHEN 0 THEN 'scn_baseline' WHEN 1 THEN concat(' ',user_id,' ') "
               "ELSE concat('scn_',user_id) END")
    return table(spark, d, "events").select("event_id", scalars.digits_only(t).alias("scenario_id"))


# --------------------------------------------------------------------- projections
@query("""SELECT p_partkey AS id, round(-179.5+p_partkey%3590/10e0,1) AS lon,
 round(-79.5+p_partkey%1590/10e0,1) AS lat, CASE WHEN -79.5+p_partkey%1590/10e0>=0 THEN 32600 ELSE 32700
 END+CAST(floor((-179.5+p_partkey%3590/10e0+180)/6) AS INTEGER)+1 AS srid FROM part""")
def utm_round_trip(spark, d):
    """To the UTM zone of each position and back."""
    p = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "-179.5D+p_partkey%3590/10D AS lon", "-79.5D+p_partkey%1590/10D AS lat")
    p = p.withColumn("srid", projection.utm_srid("lon", "lat"))
    p = p.withColumn("xy", projection.to_utm("lon", "lat", "srid"))
    back = projection.unproject_path(F.array("xy"), F.col("srid"), 6)
    return p.withColumn("b", F.element_at(back, 1)).select(
        "id", F.round("b.x", 1).alias("lon"), F.round("b.y", 1).alias("lat"), "srid")


@query("""WITH f AS (SELECT s_suppkey AS id, 73e0+(s_suppkey*7919%1000)/1000e0 AS lon,
 19e0+(s_suppkey*104729%1000)/1000e0 AS lat FROM supplier), m AS (SELECT id,
 sqrt(pow(6378137*radians(lon-73.5),2)+pow(6378137*(ln(tan(pi()/4+radians(lat)/2))
 -ln(tan(pi()/4+radians(19.5)/2))),2)) AS dd FROM f) SELECT id, round_even(dd,2) AS distance_m FROM m
 WHERE dd<=40000 ORDER BY dd, id LIMIT 10""")
def nearby_mercator(spark, d):
    f = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS id", "73D+(s_suppkey*7919%1000)/1000D AS x",
        "19D+(s_suppkey*104729%1000)/1000D AS y")
    return lookup.nearby(f, 73.5, 19.5, 40000.0, limit=10, mode="mercator").select(
        "id", "distance_m")


# --------------------------------------------------------------------- derivations
@query(with_layers("ward") + """ SELECT id, w AS ward, CASE WHEN w IN (1,3) THEN minx ELSE minx+500
 END AS minx, CASE WHEN w IN (3,4) THEN miny ELSE miny+500 END AS miny FROM ward,
 (SELECT unnest([1,2,3,4]) AS w)""")
def quadrant_wards(spark, d):
    return derive.quadrant_wards(layer(spark, d, "ward").select("id", *BOX)).select(
        "id", "ward", "minx", "miny")


@query(with_layers("zone") + """ SELECT id, CAST(floor(population/4.2e0) AS INTEGER) AS households,
 round_even(population/1.5e0,2) AS density_per_sqkm FROM zone""")
def ward_zones(spark, d):
    return derive.ward_zones(layer(spark, d, "zone")).select("id", "households", "density_per_sqkm")


@query(with_layers("facility", "ward", "parcel") + """ SELECT 'fac_'||id AS id, upper(type) AS
 entity_type, name FROM facility UNION ALL SELECT 'ward_'||id, 'WARD', name FROM ward UNION ALL
 SELECT 'parcel_'||id, 'PARCEL', 'Parcel #'||id||' ('||land_use||')' FROM parcel""")
def entity_registry(spark, d):
    return derive.entity_registry(layer(spark, d, "facility"), layer(spark, d, "ward"),
                                  layer(spark, d, "parcel")).select("id", "entity_type", "name")


@query(with_layers("facility", "ward", "parcel") + """ SELECT 'fac_'||f.id AS subject_entity,
 'located_in' AS predicate, 'ward_'||w.id AS object_entity FROM facility f JOIN ward w ON x>minx
 AND x<maxx AND y>miny AND y<maxy UNION ALL SELECT 'parcel_'||p.id, 'inside', 'ward_'||w.id
 FROM parcel p JOIN ward w ON (p.minx+p.maxx)/2>w.minx AND (p.minx+p.maxx)/2<w.maxx AND
 (p.miny+p.maxy)/2>w.miny AND (p.miny+p.maxy)/2<w.maxy""")
def entity_relationships(spark, d):
    return derive.relationships(layer(spark, d, "facility"), layer(spark, d, "ward"),
                                layer(spark, d, "parcel")).drop("distance_m")


def _proposals(spark, d):
    z = layer(spark, d, "zone")
    return z.select(F.col("id").alias("road_id"), F.expr(
        "CASE id%5 WHEN 0 THEN 'Arterial' WHEN 1 THEN 'collector' WHEN 2 THEN 'Local' ELSE 'lane' END")
        .alias("road_type"), (F.col("id") % 5 + 1).cast("int").alias("lanes"),
        F.lit(50.0).alias("speed"), F.col("minx").alias("ax"), F.col("miny").alias("ay"),
        (F.col("minx") + 500).alias("bx"), F.col("miny").alias("by"))


@query(with_layers("zone", "parcel", "building", "water") + f""", pp AS (SELECT id, minx, miny,
 minx+500 AS maxx, miny AS maxy, CAST(id%5+1 AS INTEGER) AS lanes, greatest((id%5+1)*3.5e0+5,10) AS cor,
 CASE id%5 WHEN 0 THEN 8e0 WHEN 1 THEN 4e0 WHEN 2 THEN 2.5e0 ELSE 5e0 END AS rate FROM zone)
 SELECT id AS road_id, (SELECT count(*) FROM parcel t WHERE {gap('pp','t')}<=cor) AS parcels_affected,
 (SELECT count(*) FROM building t WHERE {gap('pp','t')}<=cor) AS buildings_affected,
 CASE WHEN (SELECT count(*) FROM water t WHERE {gap('pp','t')}<=50)>2 THEN 'High' WHEN
 (SELECT count(*) FROM water t WHERE {gap('pp','t')}<=50)>0 THEN 'Medium' ELSE 'Low' END
 AS flood_exposure, round_even(least(0.5e0*4.2+lanes*0.8,25),1) AS connectivity,
 round_even(0.5e0*lanes*rate,2) AS cost_cr FROM pp""")
def road_proposals(spark, d):
    out = derive.road_proposals(_proposals(spark, d), layer(spark, d, "parcel"),
                                layer(spark, d, "building"), layer(spark, d, "water"))
    return out.select("road_id", "parcels_affected", "buildings_affected", "flood_exposure",
                      "connectivity", "cost_cr")


@query()
def road_bounded_blocks(spark, d):
    """Land between roads as blocks of 40 m cells, per tile of the city."""
    tiles = layer(spark, d, "parcel").groupBy(
        F.concat_ws("-", F.floor(F.col("minx") / 10000), F.floor(F.col("miny") / 10000))
        .alias("area_id")).agg((F.floor(F.min("minx") / 10000) * 10000.0).alias("minx"),
                               (F.floor(F.min("miny") / 10000) * 10000.0).alias("miny"))
    tiles = tiles.withColumns({"maxx": F.col("minx") + 10000.0, "maxy": F.col("miny") + 10000.0})
    z = layer(spark, d, "zone")
    roads = z.select(F.col("minx").alias("ax"), F.col("miny").alias("ay"),
                     (F.col("minx") + 900).alias("bx"), F.col("miny").alias("by"))
    return derive.block_parcels(derive.land_blocks(tiles, roads, 40.0, 24.0), 40.0)


@query("""SELECT p_partkey AS id, round_even(CASE WHEN p_size%6=0 THEN 100e0 ELSE p_size*10e0 END,2)
 AS length_m, round_even(CASE WHEN p_size%6=0 THEN 100e0 ELSE p_size*10e0 END/(CASE WHEN p_size%5=0 THEN
 40e0 ELSE 20e0+p_size END*1000e0/3600e0),2) AS travel_time_sec FROM part""")
def routing_tables(spark, d):
    t = table(spark, d, "part").selectExpr(
        "p_partkey AS source_node", "p_partkey+1 AS target_node",
        "CASE WHEN p_size%6=0 THEN NULL ELSE p_size*10D END AS length_m",
        "CASE WHEN p_size%5=0 THEN NULL ELSE 20D+p_size END AS maxspeed",
        "CAST(NULL AS STRING) AS road_class")
    return network.road_tables(t).select(F.col("source_node").alias("id"), "length_m",
                                         "travel_time_sec")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey%3=0 THEN round_even(0.01e0*111000,2) ELSE
 s_acctbal END AS distance_m, round_even(CASE WHEN s_suppkey%3=0 THEN round_even(0.01e0*111000,2) ELSE
 s_acctbal END/666.6e0,2) AS minutes FROM supplier""")
def network_distance_fallback(spark, d):
    """Network distance where there is one, straight degrees otherwise."""
    s = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS id", "CASE WHEN s_suppkey%3<>0 THEN s_acctbal END AS network_m")
    straight = F.bround(projection.degree_distance(F.lit(73.0), F.lit(19.0), F.lit(73.01),
                                                   F.lit(19.0)), 2)
    return s.select("id", F.coalesce("network_m", straight).alias("distance_m"),
                    network.minutes_at_40(F.coalesce("network_m", straight)).alias("minutes"))
