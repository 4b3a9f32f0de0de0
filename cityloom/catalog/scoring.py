"""Area scorecards and development packages for four study areas, strips of every tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import ACCESS_THRESHOLD_SECONDS, DIMENSIONS
from ..functions import geometry as g
from ..operators import aggregation, network, scorecard, traversal
from ..operators.overlay import BOX
from ..session import cut
from ..sources.layers import STREETS_SQL, junction_xy, layer, streets, with_layers
from . import query
from .network import REACH, edges, roads as street_lines
from .spatial import area

BY = ["region"]
NAMES = ("CASE {k}%4 WHEN 0 THEN 'adivali_devad' WHEN 1 THEN 'jnpt_port' "
         "WHEN 2 THEN 'chandigarh' ELSE 'rotterdam' END")


def strip(x):
    """Region of a place by its easting within the tile."""
    return NAMES.format(k=f"CAST(floor(({x}%10000)/2500) AS BIGINT)")


def region(x):
    return F.expr(strip(x))


USES = ("CASE id%7 WHEN 0 THEN 'park' WHEN 1 THEN 'forest' WHEN 2 THEN '' WHEN 3 THEN "
        "'residential' ELSE land_use END")


def parcels(spark, d):
    return layer(spark, d, "parcel").withColumns({
        "region": region("minx"), "area": g.box_area(*BOX), "land_use": F.expr(USES)})


def roads(spark, d):
    s = streets(spark, d)
    return s.select(region("x0").alias("region"), "id", F.col("x0").alias("minx"),
                    F.col("y0").alias("miny"), F.col("x1").alias("maxx"),
                    F.col("y1").alias("maxy"), F.lit(200.0).alias("length_m"))


def facilities(spark, d):
    return layer(spark, d, "facility").withColumn("region", region("x"))


def population(spark, d):
    return layer(spark, d, "zone").groupBy(region("minx").alias("region")).agg(
        F.sum("population").alias("population"))


def region_network(spark, d):
    """Streets that begin in a region, as its own network."""
    lines = street_lines(spark, d)
    lines = lines.withColumn("region", F.expr(strip("line[0].x")))
    return cut(network.build_edges(lines, "car", by=BY))


def access_share(spark, d, net):
    """Percent of people within 900 s of a facility on their region's network."""
    nodes = cut(network.nodes_of(net, BY))
    zones = layer(spark, d, "zone").select(
        region("minx").alias("region"), F.col("id").alias("zone_id"), "population",
        ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    # One search for both: the counts of the nodes cost more than the places that look for one.
    doors = facilities(spark, d).select("region", F.lit(True).alias("door"), F.col("id").alias("zone_id"), "x", "y")
    places = zones.select("region", F.lit(False).alias("door"), "zone_id", "x", "y").unionByName(doors)
    at = cut(network.snap(places.withColumn("place", F.struct("door", "zone_id")), nodes, "place", by=BY).select(
        "region", "place.*", "node"))
    homes, doors = at.where("NOT door").drop("door"), at.where("door").drop("door")
    times = traversal.nearest_time(net, homes, doors, origin_key="zone_id", by=BY,
                                   cutoff=ACCESS_THRESHOLD_SECONDS)
    acc = aggregation.zone_access(zones, times, by=BY)
    return aggregation.access_summary(acc, ACCESS_THRESHOLD_SECONDS, BY).select(
        "region", (F.col("coverage_ratio") * 100.0).alias("facility_access"))


def at_region(of):
    """Nearest node of the region's network in SQL."""
    return (f"(SELECT node FROM gp WHERE gp.region={of}.region ORDER BY (x-px)*(x-px)+(y-py)*(y-py),"
            " CAST(x AS BIGINT), CAST(y AS BIGINT) LIMIT 1)")


RAW = with_layers("parcel", "zone", "facility").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 st AS ({STREETS_SQL}), pa AS (SELECT * EXCLUDE (land_use), {strip('minx')} AS region,
 {USES} AS land_use, {area('parcel')} AS area FROM parcel),
 ro AS (SELECT {strip('x0')} AS region, x0, y0, x1, y1, src, dst, oneway, road_class,
 200e0/(greatest(speed,1)*1000e0/3600e0) AS t FROM st),
 po AS (SELECT {strip('minx')} AS region, sum(population) AS pop FROM zone GROUP BY 1),
 ex AS (SELECT region, (max(x1)-min(x0))*(max(y1)-min(y0))/1e6 AS km2 FROM (SELECT region, x0,
 y0, x1, y1 FROM ro UNION ALL SELECT region, minx, miny, maxx, maxy FROM pa) GROUP BY 1),
 mo AS (SELECT region, 'mobility' AS key, count(*)*0.2e0/any_value(km2) AS raw FROM ro
 JOIN ex USING (region) GROUP BY 1),
 fa AS (SELECT {strip('x')} AS region, type, x AS px, y AS py FROM facility),
 fc AS (SELECT region, count(*) FILTER (type IN ('hospital','clinic')) AS h,
 count(*) FILTER (type='school') AS e FROM fa GROUP BY 1),
 fp AS (SELECT region, 'healthcare' AS key, 1000e0*h/pop AS raw FROM fc JOIN po USING (region)
 UNION ALL SELECT region, 'education', 1000e0*e/pop FROM fc JOIN po USING (region)
 UNION ALL SELECT region, 'recreation', 0e0 FROM fc),
 gr AS (SELECT region, 'green_space' AS key, sum(CASE WHEN land_use IN ('park','forest') THEN area
 ELSE 0 END)/any_value(pop) AS raw FROM pa JOIN po USING (region) GROUP BY 1),
 ua AS (SELECT region, land_use, sum(area) AS a FROM pa WHERE land_use<>'' GROUP BY 1,2),
 ut AS (SELECT region, sum(a) AS t, count(*) AS k FROM ua GROUP BY 1),
 mi AS (SELECT region, 'landuse' AS key, -sum(a/t*ln(a/t))/ln(any_value(k)) AS raw FROM ua
 JOIN ut USING (region) GROUP BY 1),
 fr AS (SELECT region, 'infrastructure' AS key, 100e0*count(*) FILTER (EXISTS (SELECT 1 FROM ro
 WHERE ro.region=pa.region AND ro.x0<=pa.maxx+30 AND ro.x1>=pa.minx-30 AND ro.y0<=pa.maxy+30
 AND ro.y1>=pa.miny-30))/count(*) AS raw FROM pa GROUP BY 1),
 un AS (SELECT region, 'constraints' AS key, 100e0*count(*) FILTER (flood_risk<0.3)
 /count(flood_risk) AS raw FROM pa GROUP BY 1),
 ge AS (SELECT region, src, dst, t FROM ro WHERE road_class<>'footway' UNION ALL SELECT region, dst, src, t
 FROM ro WHERE road_class<>'footway' AND NOT oneway),
 gn AS (SELECT region, src AS node FROM ge UNION SELECT region, dst FROM ge),
 gp AS (SELECT *, {junction_xy('node')[0]} AS x, {junction_xy('node')[1]} AS y FROM gn),
 zc AS (SELECT {strip('minx')} AS region, population, (minx+maxx)/2 AS px, (miny+maxy)/2 AS py FROM zone),
 zn AS (SELECT region, population, {at_region('zc')} AS node FROM zc),
 fn AS (SELECT region, {at_region('fa')} AS node FROM fa),
 sp(region, node, c) USING KEY (region, node) AS (SELECT DISTINCT region, node, 0e0 FROM fn UNION
 SELECT sp.region, ge.src, min(sp.c+ge.t) FROM sp JOIN ge ON ge.region=sp.region AND ge.dst=sp.node LEFT JOIN
 recurring.sp r ON r.region=ge.region AND r.node=ge.src WHERE r.node IS NULL OR sp.c+ge.t<r.c
 GROUP BY sp.region, ge.src),
 ac AS (SELECT region, 'facility_access' AS key, 100e0*round_even(sum(CASE WHEN c<=900
 THEN population ELSE 0 END)/sum(population),4) AS raw FROM zn LEFT JOIN sp USING (region, node) GROUP BY 1),
 gu AS (SELECT region, src, dst FROM ge UNION SELECT region, dst, src FROM ge),
 lb(region, node, l) USING KEY (region, node) AS (SELECT region, src, src FROM gu GROUP BY region, src UNION
 SELECT gu.region, gu.dst, min(lb.l) FROM lb JOIN gu ON gu.region=lb.region AND gu.src=lb.node JOIN
 recurring.lb r ON r.region=gu.region AND r.node=gu.dst WHERE lb.l<r.l GROUP BY gu.region, gu.dst),
 lc AS (SELECT region, l, count(*) AS n FROM lb GROUP BY 1,2),
 em AS (SELECT region, least(1,count(*) FILTER (type='fire_station')/3e0)*100 AS cover FROM fa GROUP BY 1),
 re AS (SELECT region, 'resilience' AS key, 0.7e0*(100e0*max(n)/sum(n))+0.3e0*any_value(coalesce(cover,0)) AS raw
 FROM lc LEFT JOIN em USING (region) GROUP BY 1),
 raw AS (SELECT * FROM mo UNION ALL SELECT * FROM fp UNION ALL SELECT * FROM gr
 UNION ALL SELECT * FROM mi UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM un
 UNION ALL SELECT * FROM ac UNION ALL SELECT * FROM re)"""


def raw(spark, d):
    p, r, f, pop = parcels(spark, d), roads(spark, d), facilities(spark, d), population(spark, d)
    net = region_network(spark, d)
    provision = scorecard.facility_provision(f, pop, BY)
    parts = [scorecard.road_density(r, p, BY), provision.drop("emergency"),
             scorecard.green_space(p, pop, BY), scorecard.land_use_mix(p, BY),
             scorecard.frontage_share(p, r, BY), scorecard.unconstrained_share(p, BY),
             access_share(spark, d, net), scorecard.resilience_index(
                 traversal.component_sizes(net, BY), provision, BY)]
    return scorecard.raw_measures(pop, parts, BY)


def scored(spark, d):
    return cut(scorecard.score_dimensions(raw(spark, d), scorecard.dimensions(spark),
                                          scorecard.benchmark_values(spark)))


def values(rows):
    return ", ".join("(" + ", ".join(
        f"'{v}'" if isinstance(v, str) else f"{float(v)!r}e0" if isinstance(v, float) else str(v)
        for v in r) + ")" for r in rows)


def _cards():
    from ..fixed_values import BENCHMARKS, BENCHMARK_PAIRING
    dims = values([(k, i, lo, hi, w) for i, (k, _, _, lo, hi, w) in enumerate(DIMENSIONS)])
    ben = values([(r, k, v) for r, c in BENCHMARK_PAIRING.items()
                  for k, v in BENCHMARKS[c].items()])
    norm = "least(100,greatest(0,({v}-lo)/(hi-lo)*100.0))"
    return (RAW + f""", dm(key, pos, lo, hi, weight) AS (VALUES {dims}),
 be(region, key, b) AS (VALUES {ben}), sc AS (SELECT region, key, pos, weight,
 round_even(raw,3) AS raw, round_even(CASE WHEN raw IS NOT NULL THEN {norm.format(v='raw')} END,1)
 AS score, round_even({norm.format(v='b')},1) AS bscore FROM raw JOIN dm USING (key)
 LEFT JOIN be USING (region, key))""")


CARD = _cards()


@query(RAW + " SELECT region, key, round(raw,4) AS raw FROM raw")
def dimension_measures(spark, d):
    return raw(spark, d).select("region", "key", F.round("raw", 4).alias("raw"))


@query(CARD + """ SELECT region, key, raw, score, score IS NOT NULL AS measurable, bscore
 AS benchmark_score, round_even(bscore-score,1) AS gap FROM sc""")
def city_scorecard(spark, d):
    return scored(spark, d).select("region", "key", "raw", "score", "measurable",
                                   "benchmark_score", "gap")


@query(CARD + """ SELECT region, round_even(sum(score*weight)/sum(CASE WHEN score IS NOT NULL THEN
 weight END),1) AS overall_score, count(score) AS dimensions_measured, count(*) AS
 dimensions_total, round_even(sum(CASE WHEN score IS NOT NULL THEN bscore*weight END)
 /sum(CASE WHEN score IS NOT NULL AND bscore IS NOT NULL THEN weight END),1) AS benchmark_score
 FROM sc GROUP BY 1""")
def city_overall_score(spark, d):
    return scorecard.overall(scored(spark, d)).drop("benchmark_gap")


@query(CARD + """, w AS (SELECT region, sum(weight) AS w FROM sc WHERE score IS NOT NULL GROUP BY 1)
 SELECT region, key, coalesce(round_even(score*weight/w,2),0) AS contribution FROM sc
 JOIN w USING (region)""")
def score_contributions(spark, d):
    return scorecard.contributions(scored(spark, d)).select("region", "key", "contribution")


@query(REACH + """, em AS (SELECT count(*) AS n FROM supplier WHERE s_nationkey%4=2)
 SELECT 'all' AS region, round(0.7*100e0*max(n)/sum(n)+0.3*least(1,(SELECT n FROM em)/3e0)*100,4)
 AS resilience FROM (SELECT l, count(*) AS n FROM lab GROUP BY l)""")
def resilience_index(spark, d):
    comp = traversal.components(edges(spark, d)).groupBy(
        F.lit("all").alias("region"), "component").agg(F.count(F.lit(1)).alias("n"))
    f = layer(spark, d, "facility").withColumn("region", F.lit("all"))
    pop = layer(spark, d, "zone").agg(F.sum("population").alias("population")).withColumn(
        "region", F.lit("all"))
    emergency = scorecard.facility_provision(f, pop, BY)
    return scorecard.resilience_index(comp, emergency, BY).withColumn(
        "resilience", F.round("resilience", 4))


VARIANTS = [("A - Balanced", []), ("B - Health first", ["healthcare", "education",
                                                        "facility_access"]),
            ("C - Mobility", ["mobility", "resilience", "infrastructure"])]


def chosen(spark, d, budget=None):
    v = F.explode(F.array(*[F.struct(
        F.lit(n).alias("variant"), F.array(*[F.lit(x) for x in p]).cast("array<string>")
        .alias("priorities")) for n, p in VARIANTS]))
    s = scored(spark, d).withColumn("v", v).select("*", "v.*").drop("v")
    by = ["region", "variant"]
    return scorecard.packages(scorecard.gaps(s, by), scorecard.remedies(spark), by,
                              budget=budget)


def _remedies():
    from ..fixed_values import (ACCESS_ROAD_M, DEPENDENCIES, FACILITY_COST, REMEDIES,
                                UNIT_RATES)
    rows = []
    for key, kinds in REMEDIES.items():
        for i, k in enumerate(kinds):
            rate, qty = FACILITY_COST[k]
            deps = DEPENDENCIES.get(k, ())
            dep = sum(UNIT_RATES[r] * ACCESS_ROAD_M for *_, r in deps)
            rows.append((key, i, k, UNIT_RATES[rate] * qty + dep, 15.0, 1 + len(deps)))
    for key in ("mobility", "infrastructure"):
        rows.append((key, 0, "corridor", UNIT_RATES["road_per_m_collector"] * 1200.0, 12.0, 1))
    return values(rows)


# Without a budget the ordered rule is a prefix: an action is in while the uplift before it
# is short of the target and the action count before it is under the limit.
PACK = CARD + f""", va(variant, pr) AS (VALUES ('A - Balanced', []), ('B - Health first',
 ['healthcare','education','facility_access']), ('C - Mobility',
 ['mobility','resilience','infrastructure'])), tw AS (SELECT region, sum(weight) AS tw FROM sc
 WHERE score IS NOT NULL GROUP BY 1), ga AS (SELECT region, variant, key, pos, weight,
 greatest(0,coalesce(bscore,100)-score) AS gap, tw FROM sc JOIN tw USING (region), va
 WHERE score IS NOT NULL AND greatest(0,coalesce(bscore,100)-score)>0.5
 AND (len(pr)=0 OR list_contains(pr,key))), rm(key, p, remedy, cost, step, n) AS (VALUES {_remedies()}),
 it AS (SELECT *, least(gap,step)*weight/tw AS up, row_number() OVER (PARTITION BY region, variant
 ORDER BY gap*weight DESC, pos, p) AS i FROM ga JOIN rm USING (key)),
 cu AS (SELECT *, coalesce(sum(up) OVER w,0) AS ub, coalesce(sum(n) OVER w,0) AS nb FROM it
 WINDOW w AS (PARTITION BY region, variant ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING)), pk AS (SELECT * FROM cu WHERE ub<10 AND nb<12)"""


@query(PACK + """ SELECT region, variant, CAST(sum(n) AS BIGINT) AS actions, count(*) AS primary_actions,
 round_even(sum(cost)*1.15e0,0) AS total_cost, round_even(sum(up),2) AS expected_uplift FROM pk
 GROUP BY 1,2""")
def development_packages(spark, d):
    out = scorecard.package_summary(chosen(spark, d), ["region", "variant"])
    return out.select("region", "variant", F.col("actions").cast("bigint").alias("actions"),
                      F.col("primary_actions").cast("bigint").alias("primary_actions"),
                      "total_cost", "expected_uplift")


@query(PACK + """, s AS (SELECT region, variant, round_even(round_even(sum(cost)*1.15e0,0)
 /round_even(sum(up),2),0) AS cpp FROM pk GROUP BY 1,2 HAVING sum(up)>0)
 SELECT region, min_by(variant, (cpp, variant)) AS recommended FROM s GROUP BY 1""")
def compare_packages(spark, d):
    s = scorecard.package_summary(chosen(spark, d), ["region", "variant"])
    return scorecard.compare_packages(s, BY)[1]


def _itemised():
    from ..fixed_values import (ACCESS_ROAD_M, CORRIDOR_M, CORRIDOR_STEP, DEPENDENCIES, FACILITY_COST,
                                FACILITY_LABEL, FACILITY_STEP, REMEDIES, ROAD_REMEDIES, UNIT_RATES)
    rows, deps = [], []
    for key, kinds in REMEDIES.items():
        for i, k in enumerate(kinds):
            rate, qty = FACILITY_COST[k]
            rows.append((key, i, "facility", k, FACILITY_LABEL[k], UNIT_RATES[rate] * qty, FACILITY_STEP,
                         len(DEPENDENCIES.get(k, ()))))
    for key in ROAD_REMEDIES:
        rows.append((key, 0, "road", "corridor", f"New collector road corridor ({CORRIDOR_M:.0f} m)",
                     UNIT_RATES["road_per_m_collector"] * CORRIDOR_M, CORRIDOR_STEP, 0))
    for k, needs in DEPENDENCIES.items():
        for i, (kind, label, rate) in enumerate(needs):
            deps.append((k, i, kind, label.replace("{label}", FACILITY_LABEL[k]), UNIT_RATES[rate] * ACCESS_ROAD_M))
    return values(rows), values(deps)


ITEMS, NEEDS = _itemised()
ACTIONS = PACK + f""", rm2(key, p, kind, remedy, label, own, step, nd) AS
 (VALUES {ITEMS}), dp(remedy, di, dkind, dlabel, dcost) AS (VALUES {NEEDS}),
 it2 AS (SELECT region, variant, key, kind, remedy, label, own, nd, own+coalesce((SELECT sum(dcost) FROM dp
 WHERE dp.remedy=rm2.remedy),0) AS cost, least(gap,step)*weight/tw AS up, row_number() OVER (PARTITION BY
 region, variant ORDER BY gap*weight DESC, pos, p) AS i FROM ga JOIN rm2 USING (key)),
 acn(region, variant, i, cost, up, n, seq, own_seq) AS (SELECT DISTINCT region, variant, 0::BIGINT, 0e0, 0e0,
 0::BIGINT, 0::BIGINT, 0::BIGINT FROM it2 UNION ALL SELECT acn.region, acn.variant, it2.i,
 CASE WHEN st='take' THEN acn.cost+it2.cost ELSE acn.cost END, CASE WHEN st='take' THEN acn.up+it2.up ELSE acn.up END,
 CASE WHEN st='take' THEN acn.n+1+nd ELSE acn.n END, CASE st WHEN 'take' THEN acn.seq+1+nd WHEN 'skip' THEN acn.seq+1
 ELSE acn.seq END, CASE WHEN st='take' THEN acn.seq+1 END FROM acn JOIN it2 ON it2.region=acn.region AND
 it2.variant=acn.variant AND it2.i=acn.i+1, LATERAL (SELECT CASE WHEN acn.up>=10 OR acn.n>=12 THEN 'done' WHEN
 acn.cost+it2.cost>500e6 THEN 'skip' ELSE 'take' END AS st)),
 tk AS (SELECT it2.*, own_seq FROM acn JOIN it2 USING (region, variant, i) WHERE own_seq>0)"""


@query(ACTIONS + """ SELECT region, variant, 'act-'||lpad(CAST(own_seq AS VARCHAR),2,'0') AS action_id, kind, label,
 key AS dimension, remedy, round_even(own,0) AS cost, round_even(up,2) AS expected_uplift,
 CAST(NULL AS VARCHAR) AS parent_id FROM tk UNION ALL SELECT region, variant, 'act-'||lpad(CAST(own_seq+di+1 AS
 VARCHAR),2,'0'), dkind, dlabel, key, remedy, round_even(dcost,0), 0e0, 'act-'||lpad(CAST(own_seq AS VARCHAR),2,'0')
 FROM tk JOIN dp USING (remedy)""")
def package_actions(spark, d):
    """Itemised actions under a budget (skips what does not fit)."""
    return scorecard.package_actions(chosen(spark, d, 500e6), ["region", "variant"])
