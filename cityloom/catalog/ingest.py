"""Map ingestion over elements derived from the tables, and road noding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import (FACILITY_CATEGORY, INGEST_CAPACITY, INGEST_RADIUS, INGEST_SPEEDS,
                            INGEST_ZONING, LANDUSE_CATEGORY, TYPICAL_FLOORS)
from ..functions import geometry as g
from ..operators import network
from ..operators.overlay import BOX
from ..sources import codec, overpass
from ..sources.layers import layer, table, with_layers
from . import query

AMENITY = ("CASE p_size%8 WHEN 0 THEN 'hospital' WHEN 1 THEN 'Clinic' WHEN 2 THEN 'school' "
           "WHEN 3 THEN 'bench' WHEN 4 THEN 'police' WHEN 5 THEN 'dentist' END")
LEISURE = "CASE p_size%5 WHEN 0 THEN 'park' WHEN 1 THEN 'Pitch' WHEN 2 THEN 'sauna' END"
HEALTH = "CASE p_partkey%11 WHEN 0 THEN 'laboratory' END"
LANDUSE = ("CASE p_size%7 WHEN 0 THEN 'residential' WHEN 1 THEN 'forest' WHEN 2 THEN 'farmland' "
           "WHEN 3 THEN 'landfill' WHEN 4 THEN 'retail' WHEN 5 THEN '' END")
HIGHWAY = ("CASE p_size%6 WHEN 0 THEN 'primary' WHEN 1 THEN 'footway' WHEN 2 THEN 'residential' "
           "WHEN 3 THEN 'busway' WHEN 4 THEN 'trunk' END")
BUILDING = ("CASE p_size%6 WHEN 0 THEN 'apartments' WHEN 1 THEN 'House' WHEN 2 THEN 'castle' "
            "WHEN 3 THEN 'shed' WHEN 4 THEN 'office' ELSE 'yes' END")
HEIGHT = ("CASE p_partkey%9 WHEN 0 THEN '12.5 m' WHEN 1 THEN '0' WHEN 2 THEN 'Suyash Society' "
          "WHEN 3 THEN '30meters' END")
LEVELS = "CASE p_partkey%7 WHEN 0 THEN '4' WHEN 1 THEN '3715' WHEN 2 THEN '2.9' END"
LANES = "CASE p_partkey%5 WHEN 0 THEN '4' WHEN 1 THEN '2;3' WHEN 2 THEN '1' END"


def elements(spark, d, more=()):
    """Every part twice (a copy arrives later): nodes, and ways with a square outline. ``more``: columns of a part."""
    tags = ["amenity", AMENITY, "leisure", LEISURE, "healthcare", HEALTH, "landuse", LANDUSE,
            "highway", HIGHWAY, "building", BUILDING, "height", HEIGHT, "building:levels", LEVELS,
            "lanes", LANES, "name", "CASE WHEN p_partkey%4<>0 THEN p_name END"]
    pairs = ", ".join(f"'{t}'" if i % 2 == 0 else t for i, t in enumerate(tags))
    p = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey%2=0 THEN 'node' ELSE 'way' END AS type",
        "CAST(p_partkey%1000 AS DOUBLE) AS px", "CAST(p_partkey%777 AS DOUBLE) AS py",
        "CAST(1+p_size AS DOUBLE) AS side", "p_partkey%13=1 AS open_way", *more,
        f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS tags")

    def at(x, y):
        return F.struct((F.col("py") + y).alias("lat"), (F.col("px") + x).alias("lon"))
    s, z = F.col("side"), F.lit(0.0)
    ring = F.array(at(z, z), at(s, z), at(s, s), at(z, s))
    ring = F.when(F.col("open_way"), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    way = F.col("type") == "way"
    return p.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), "id", "type",
        F.when(~way, F.col("py")).alias("lat"), F.when(~way, F.col("px")).alias("lon"),
        F.lit(None).cast(overpass.POSITION).alias("center"),
        F.when(way, ring).alias("geometry"), "tags", *[m.split(" AS ")[-1] for m in more])


def cases(value, mapping, default="NULL"):
    whens = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else repr(v))
                     for k, v in mapping.items())
    return f"CASE {value} {whens} ELSE {default} END"


FAC = f"""t AS (SELECT p_partkey AS id, lower({AMENITY}) AS a, lower({HEALTH}) AS h, lower({LEISURE})
 AS l, p_partkey%2=0 AS node, p_partkey%1000 AS px, p_partkey%777 AS py, 1+p_size AS side,
 CASE WHEN p_partkey%4<>0 THEN p_name ELSE '' END AS name, p_partkey%13=1 AS open_way FROM part),
 c AS (SELECT *, {cases('a', FACILITY_CATEGORY)} AS ca, coalesce({cases('h', FACILITY_CATEGORY)},
 CASE WHEN h IS NOT NULL THEN 'health' END) AS ch, {cases('l', FACILITY_CATEGORY)} AS cl FROM t)"""


@query(f"""WITH {FAC} SELECT id AS osm_id, name, CASE WHEN ca IS NOT NULL THEN a WHEN ch IS NOT NULL
 THEN h ELSE l END AS kind, coalesce(ca,ch,cl) AS category, round(CASE WHEN node THEN px WHEN open_way
 THEN px+side*(0.5+1+0.5)/3 ELSE px+side/2e0 END,3) AS x FROM c
 WHERE coalesce(ca,ch,cl) IS NOT NULL""")
def extract_facilities(spark, d):
    return overpass.extract_layer(elements(spark, d), "facilities").select(
        "osm_id", "name", "kind", "category", F.round("x", 3).alias("x"))


@query(f"""WITH t AS (SELECT p_partkey AS id, nullif(lower({LANDUSE}),'') AS u, lower({LEISURE}) AS l,
 1+p_size AS side FROM part WHERE p_partkey%2=1 AND p_partkey%13<>1), c AS (SELECT *,
 {cases('u', LANDUSE_CATEGORY)} AS cu, {cases('l', LANDUSE_CATEGORY)} AS cl FROM t)
 SELECT id AS osm_id, CASE WHEN cu IS NOT NULL THEN u ELSE l END AS kind, coalesce(cu,cl) AS category,
 CAST(side*side AS DOUBLE) AS area FROM c WHERE coalesce(cu,cl) IS NOT NULL""")
def extract_landuse(spark, d):
    return overpass.extract_layer(elements(spark, d), "landuse").select(
        "osm_id", "kind", "category", g.area("rings").alias("area"))


@query(f"""SELECT p_partkey AS osm_id, coalesce({HIGHWAY},{BUILDING}) AS kind,
 CAST((1+p_size)*CASE WHEN p_partkey%13=1 THEN 3 ELSE 4 END AS DOUBLE) AS length FROM part
 WHERE p_partkey%2=1""")
def extract_roads(spark, d):
    return overpass.extract_layer(elements(spark, d), "roads").select(
        "osm_id", "kind", g.length("rings").alias("length"))


@query(f"""SELECT p_partkey AS id, coalesce({HIGHWAY},'residential') AS road_class,
 CASE p_partkey%5 WHEN 0 THEN 4 WHEN 2 THEN 1 ELSE 2 END AS lanes,
 {cases(f"coalesce({HIGHWAY},'residential')", INGEST_SPEEDS, '30')} AS speed_limit,
 CASE p_partkey%5 WHEN 0 THEN 4 WHEN 2 THEN 1 ELSE 2 END*600 AS capacity FROM part""")
def ingest_roads(spark, d):
    return overpass.ingest_roads(elements(spark, d)).select(
        "id", "road_class", "lanes", "speed_limit", "capacity")


@query(f"""WITH t AS (SELECT p_partkey AS id, {AMENITY} AS type, p_name, p_partkey FROM part)
 SELECT id, type, CASE WHEN p_partkey%4<>0 THEN p_name ELSE 'Unnamed '||type END AS name,
 {cases('type', INGEST_CAPACITY, '50')} AS capacity, {cases('type', INGEST_RADIUS, '2000e0')}
 AS service_radius_m FROM t WHERE type IN ('hospital','school','police')""")
def ingest_facilities(spark, d):
    return overpass.ingest_facilities(elements(spark, d)).select(
        "id", "type", "name", "capacity", "service_radius_m")


H = f"""CASE p_partkey%9 WHEN 0 THEN 12.5e0 WHEN 1 THEN 0e0 WHEN 3 THEN 30e0 END"""
LV = "CASE p_partkey%7 WHEN 0 THEN 4e0 WHEN 1 THEN 3715e0 WHEN 2 THEN 2.9e0 END"


@query(f"""WITH t AS (SELECT p_partkey AS id, {H} AS h, {LV} AS lv, CAST((1+p_size)*(1+p_size) AS
 DOUBLE) AS a, {cases(f'lower({BUILDING})', TYPICAL_FLOORS, '3')} AS b0,
 0.75e0+(('0x'||md5(CAST(p_partkey AS VARCHAR))[1:8])::UBIGINT%1000)/1000e0*0.6e0 AS j FROM part),
 u AS (SELECT *, CASE WHEN a<30 THEN least(b0,1) WHEN a<60 THEN least(b0,2) WHEN a<120 THEN least(b0,3)
 WHEN a>2000 THEN greatest(b0,4) ELSE b0 END AS b FROM t), v AS (SELECT *,
 CASE WHEN h BETWEEN 1.5 AND 999 THEN 1 WHEN lv BETWEEN 1 AND 163 THEN 2 ELSE 3 END AS how,
 least(40,greatest(1,CAST(round_even(b*j,0) AS INTEGER))) AS guess FROM u), w AS (SELECT id, a, how,
 CASE how WHEN 1 THEN greatest(1,CAST(round_even(h/3.2e0,0) AS INTEGER)) WHEN 2 THEN
 CAST(floor(lv) AS INTEGER) ELSE guess END AS floors, h, guess, lv FROM v)
 SELECT id, floors, round(CASE how WHEN 1 THEN h ELSE floors*3.2e0 END,2) AS height_m,
 CASE how WHEN 1 THEN 0.95e0 WHEN 2 THEN 0.85e0 ELSE 0.35e0 END AS confidence,
 CAST(round_even(least(5000,a*floors/20e0),0) AS INTEGER) AS population_estimate FROM w""")
def ingest_buildings(spark, d):
    e = elements(spark, d, ["double((p_size+1)*(p_size+1)) AS m2"])
    return overpass.ingest_buildings(e, F.col("m2")).select(
        "id", "floors", F.round("height_m", 2).alias("height_m"), "confidence",
        "population_estimate")


@query(f"""WITH t AS (SELECT p_partkey AS id, {LANDUSE} AS land_use FROM part WHERE p_partkey%2=1
 AND p_partkey%13<>1) SELECT id, land_use, {cases('land_use', INGEST_ZONING, "'R1'")} AS zoning,
 'vacant' AS development_status FROM t WHERE land_use IS NOT NULL""")
def ingest_parcels(spark, d):
    return overpass.ingest_parcels(elements(spark, d)).select(
        "id", "land_use", "zoning", "development_status")


@query(with_layers("building") + """, c AS (SELECT unnest(range(CASE WHEN minx/500e0=floor(minx/500)
 THEN CAST(floor(minx/500) AS BIGINT)-1 ELSE CAST(floor(minx/500) AS BIGINT) END,
 CAST(floor(maxx/500) AS BIGINT)+1)) AS cx, miny, maxy, population_estimate AS p FROM building),
 cc AS (SELECT cx, unnest(range(CASE WHEN miny/500e0=floor(miny/500) THEN
 CAST(floor(miny/500) AS BIGINT)-1 ELSE CAST(floor(miny/500) AS BIGINT) END,
 CAST(floor(maxy/500) AS BIGINT)+1)) AS cy, p FROM c)
 SELECT cx, cy, CAST(round(sum(p),0) AS BIGINT) AS population,
 CAST(round(sum(p)/4.5e0,0) AS BIGINT) AS households, round(sum(p)/0.25e0,2) AS density_per_sqkm
 FROM cc GROUP BY 1,2 HAVING sum(p)>0""")
def population_zones(spark, d):
    return overpass.population_zones(layer(spark, d, "building"), 500.0).select(
        "cx", "cy", "population", "households", "density_per_sqkm")


@query(f"""SELECT 'facilities' AS layer, count(*)*2 AS fetched,
 count(*) FILTER ({AMENITY} IN ('hospital','school','police')) AS written, 'ok' AS status FROM part
 UNION ALL SELECT 'water', count(*)*2, 0, 'empty' FROM part UNION ALL SELECT 'bridges', 0, 0, 'failed'""")
def layer_report(spark, d):
    e = elements(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("n"))
    fetched = n.withColumn("layer", F.explode(F.array(F.lit("facilities"), F.lit("water"))))
    one = e
    written = (overpass.ingest_facilities(one).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "layer", F.lit("facilities")).unionByName(overpass.ingest_water(one).agg(
            F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit("water"))))
    return overpass.layer_report(fetched, written, ["facilities", "water", "bridges"])


@query(with_layers("zone") + """, s AS (SELECT DISTINCT minx, miny, maxx, maxy FROM zone)
 SELECT count(*) AS shapes, sum((maxx-minx)*(maxy-miny)) AS area FROM s""")
def clean_geometries(spark, d):
    """Copies, empty and missing shapes go; the nested column goes too."""
    z = layer(spark, d, "zone").select(
        "id", F.array("id").alias("tags"), F.explode(F.array(
            g.box_rings(*BOX), g.box_rings(*BOX), F.lit(None).cast(g.RINGS),
            F.array().cast(g.RINGS))).alias("rings"))
    return overpass.clean(z).agg(F.count(F.lit(1)).alias("shapes"),
                                 F.sum(g.area("rings")).alias("area"))


# ------------------------------------------------------------------------- noding
LINES = """ln AS (SELECT p_partkey AS id, p_partkey%2=0 AS hor,
 CAST((p_partkey*3571)%9900+10000*(CAST(floor(p_partkey/2000) AS BIGINT)%100) AS DOUBLE) AS x,
 CAST((p_partkey*28657)%9900+10000*CAST(floor(CAST(floor(p_partkey/2000) AS BIGINT)/100) AS BIGINT)
 AS DOUBLE)+0.5 AS y, CAST(100+p_size*8 AS DOUBLE) AS len FROM part)"""


@query(f"""WITH {LINES}, h AS (SELECT id, x, y, len FROM ln WHERE hor), v AS (SELECT id, x, y, len
 FROM ln WHERE NOT hor), xx AS (SELECT h.id AS hid, v.id AS vid, v.x-h.x AS dh, h.y-v.y AS dv,
 h.len AS lh, v.len AS lv FROM h JOIN v ON v.x BETWEEN h.x AND h.x+h.len AND h.y BETWEEN v.y AND
 v.y+v.len), hh AS (SELECT a.id AS hid, b.id AS oid, unnest([b.x-a.x, b.x+b.len-a.x]) AS dh, a.len AS lh
 FROM h a JOIN h b ON a.y=b.y AND a.id<>b.id AND b.x<=a.x+a.len AND b.x+b.len>=a.x),
 vv AS (SELECT a.id AS hid, unnest([b.y-a.y, b.y+b.len-a.y]) AS dh, a.len AS lh FROM v a JOIN v b
 ON a.x=b.x AND a.id<>b.id AND b.y<=a.y+a.len AND b.y+b.len>=a.y),
 cu AS (SELECT hid AS id, dh AS d, lh AS len FROM xx UNION SELECT vid, dv, lv FROM xx
 UNION SELECT hid, dh, lh FROM hh UNION SELECT hid, dh, lh FROM vv),
 n AS (SELECT id, count(*) AS cuts FROM cu WHERE d>0.01 AND d<len-0.01 GROUP BY 1)
 SELECT ln.id AS road, coalesce(cuts,0)+1 AS pieces, round(len,3) AS length FROM ln LEFT JOIN n
 USING (id)""")
def node_roads(spark, d):
    """Streets cut wherever they cross."""
    p = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "p_partkey%2=0 AS hor",
        "CAST((p_partkey*3571)%9900+10000*(CAST(floor(p_partkey/2000) AS BIGINT)%100) AS DOUBLE) AS x",
        "CAST((p_partkey*28657)%9900+10000*CAST(floor(CAST(floor(p_partkey/2000) AS BIGINT)/100) "
        "AS BIGINT) AS DOUBLE)+0.5D AS y", "CAST(100+p_size*8 AS DOUBLE) AS len")
    end = F.when(F.col("hor"), g.vertex(F.col("x") + F.col("len"), "y")).otherwise(
        g.vertex("x", F.col("y") + F.col("len")))
    roads = p.select("id", F.array(g.vertex("x", "y"), end).alias("line"))
    out = network.node_roads(roads)
    parent = F.substring_index("id", "#", 1).cast("long")
    return out.groupBy(parent.alias("road")).agg(
        F.count(F.lit(1)).alias("pieces"),
        F.round(F.sum(g.length(F.array("line"))), 3).alias("length"))


@query("""SELECT p_partkey AS id, 20e0+CASE WHEN p_size%10=7 THEN 100 ELSE p_size END AS speed FROM part
 WHERE p_size%10<>3 UNION ALL SELECT -1-p_partkey, 5e0 FROM part WHERE p_size%10=9""")
def road_deltas(spark, d):
    p = table(spark, d, "part")
    base = p.select(F.col("p_partkey").alias("id"), (20.0 + F.col("p_size")).alias("speed"))
    added = p.where("p_size%10=9").select((-1 - F.col("p_partkey")).alias("id"),
                                          F.lit(5.0).alias("speed"))
    removed = p.where("p_size%10=3").select(F.col("p_partkey").alias("id"))
    changed = p.where("p_size%10=7").select(F.col("p_partkey").alias("id"),
                                            F.lit(120.0).alias("speed"))
    return network.apply_road_deltas(base, added, removed, changed)


PARTS = """, s AS (SELECT id, maxx-minx AS w, maxy-miny AS h FROM parcel)"""


@query(with_layers("parcel") + PARTS + """ SELECT id, round(2*w*h-w*h/4,2) AS area, 2 AS n_parts,
 1 AS holes, true AS valid FROM s""")
def two_part_polygons(spark, d):
    """Every parcel as text of two parts, the first with a hole and all rings turned the wrong way."""
    def ring(x0, y0, x1, y1, flip=False):
        at = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
        return "concat('(', " + ", ', ', ".join(f"{x}, ' ', {y}" for x, y in (at[::-1] if flip else at)) + ", ')')"
    w, h = "(maxx-minx)", "(maxy-miny)"
    hole = ring(f"minx+{w}/4", f"miny+{h}/4", f"maxx-{w}/4", f"maxy-{h}/4", True)
    text = (f"concat('MULTIPOLYGON((', {ring('minx', 'miny', 'maxx', 'maxy')}, ', ', {hole}, '), (', "
            f"{ring(f'minx+2*{w}', 'miny', f'maxx+2*{w}', 'maxy')}, '))')")
    shapes = codec.decoded(layer(spark, d, "parcel").select("id", F.expr(text).alias("text")), "text")
    done = overpass.repair_polygons(shapes)
    return done.select("id", F.round(g.area("rings"), 2).alias("area"), F.size(g.parts("rings")).alias("n_parts"),
                       F.size(F.filter("outer", lambda o: ~o)).alias("holes"), "valid")
