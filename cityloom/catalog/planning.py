"""Constraint rules, scoring, ranking and the site search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import candidates, constraints, mcda
from ..operators.overlay import BOX, prefixed
from ..plans import suitability
from ..session import cut
from ..sources.layers import layer, table, with_layers
from . import query
from .network import AT, edge_sql, edges
from .spatial import area, meet, shared


def parcels(spark, d):
    return layer(spark, d, "parcel").withColumn("area", g.box_area(*BOX))


def constraint_layer(spark, d):
    c = layer(spark, d, "constraint").withColumns({
        "weight": constraints.weight_of("severity"),
        "severity": constraints.severity_of("severity"), "buffer": F.lit(0.0)})
    return prefixed(c, "c_")


RULES = {"min_area": 1500.0, "max_slope": 15.0, "max_flood_risk": 0.7,
         "allowed_status": ("vacant", "under_development")}

FAILED = f"""list_filter([CASE WHEN NOT {area('p')}>=1500 THEN 'min_area' END,
 CASE WHEN NOT slope<=15 THEN 'max_slope' END,
 CASE WHEN NOT flood_risk<=0.7 THEN 'max_flood_risk' END,
 CASE WHEN status NOT IN ('vacant','under_development')
 THEN 'allowed_development_status' END], lambda v: v IS NOT NULL)"""
SEVERITY_CASES = ("CASE upper(coalesce(severity,'HIGH')) WHEN 'HIGH' THEN 'hard' WHEN 'CRITICAL'"
                  " THEN 'hard' WHEN 'SEVERE' THEN 'hard' WHEN 'MEDIUM' THEN 'soft' WHEN 'LOW'"
                  " THEN 'soft' WHEN 'MODERATE' THEN 'soft' ELSE 'hard' END")
WEIGHT_CASES = ("CASE upper(coalesce(severity,'HIGH')) WHEN 'MEDIUM' THEN 0.6e0 WHEN 'MODERATE'"
                " THEN 0.6e0 WHEN 'LOW' THEN 0.3e0 ELSE 1e0 END")
CONS = with_layers("parcel", "constraint", "zone", "facility").replace(
    "constraint AS", "craw AS") + (
    f", cons AS (SELECT * EXCLUDE (severity), {SEVERITY_CASES} AS severity,"
    f" {WEIGHT_CASES} AS weight FROM craw)")


@query(with_layers("parcel") + f"""
 SELECT id AS parcel_id, array_to_string({FAILED}, ',') AS failed_rules,
 len({FAILED})=0 AS passed FROM parcel p""")
def attribute_rules(spark, d):
    out = constraints.evaluate(parcels(spark, d), **RULES)
    return out.select(F.col("id").alias("parcel_id"), F.array_join(
        F.transform("failed", lambda v: v["rule"]), ",").alias("failed_rules"), "passed")


@query(CONS + "SELECT id, severity, weight FROM cons")
def severity_mapping(spark, d):
    return constraint_layer(spark, d).select(
        F.col("c_id").alias("id"), F.col("c_severity").alias("severity"),
        F.col("c_weight").alias("weight"))


HITS = f""", hit AS (SELECT p.id, c.severity, c.weight, c.type,
 {shared('p','c')}/{area('p')} AS o FROM parcel p JOIN cons c ON {meet('p','c')})"""


@query(CONS + HITS + f""", agg AS (SELECT id, count(*) FILTER (severity='hard') AS hard_hits,
 count(*) FILTER (severity<>'hard') AS soft_hits,
 sum(CASE WHEN severity<>'hard' THEN weight*o END) AS s FROM hit GROUP BY id)
 SELECT p.id AS parcel_id, len({FAILED})=0 AND coalesce(hard_hits,0)=0 AS passed,
 coalesce(hard_hits,0) AS hard_hits, coalesce(soft_hits,0) AS soft_hits,
 round_even(coalesce(s,0),6) AS soft_penalty FROM parcel p LEFT JOIN agg ON agg.id=p.id""")
def constraint_report(spark, d):
    out = constraints.evaluate(parcels(spark, d), constraint_layer(spark, d), **RULES)
    return out.select(F.col("id").alias("parcel_id"), "passed", "hard_hits", "soft_hits",
                      "soft_penalty")


@query(CONS + HITS + """
 SELECT id AS parcel_id, 'constraint:'||type AS rule, severity, round_even(o,4) AS observed FROM hit""")
def constraint_reasons(spark, d):
    hits = constraints.constraint_hits(parcels(spark, d), constraint_layer(spark, d), key=["id"])
    return hits.select(F.col("id").alias("parcel_id"),
                       F.concat(F.lit("constraint:"), "c_type").alias("rule"),
                       F.col("c_severity").alias("severity"),
                       F.bround("overlap", 4).alias("observed"))


@query(CONS + HITS + f"""
 SELECT id AS parcel_id, zoning FROM parcel p WHERE len({FAILED})=0
 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.id=p.id AND h.severity='hard')""")
def hard_filter(spark, d):
    p = parcels(spark, d)
    out = constraints.survivors(p, constraints.evaluate(p, constraint_layer(spark, d), **RULES))
    return out.select(F.col("id").alias("parcel_id"), "zoning")


# --------------------------------------------------------------------- scoring
def part_metrics(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey AS candidate_id", "p_brand AS run", "p_retailprice AS population_served",
        "CASE WHEN p_partkey%11=0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS slope",
        "CAST(p_partkey%100 AS DOUBLE)/100 AS flood_risk",
        "CAST(p_partkey%7 AS DOUBLE)/100 AS penalty0")


METRICS = """m AS (SELECT p_partkey AS candidate_id, p_brand AS run,
 p_retailprice AS population_served,
 CASE WHEN p_partkey%11=0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS slope,
 CAST(p_partkey%100 AS DOUBLE)/100 AS flood_risk,
 CAST(p_partkey%7 AS DOUBLE)/100 AS penalty0 FROM part)"""
CRITERIA = (("population_served", 0.5), ("slope", 0.3, "cost"),
            ("flood_risk", 0.2, "cost", "", 0.1, 0.8))


def minmax_sql(col, cost=False, lo=None, hi=None, part=""):
    lo = lo or f"min({col}) OVER ({part})"
    hi = hi or f"max({col}) OVER ({part})"
    s = f"(least(greatest({col},{lo}),{hi})-{lo})/({hi}-{lo})"
    s = f"1-{s}" if cost else s
    return f"CASE WHEN {col} IS NULL THEN 0 WHEN {hi}={lo} THEN 0.5 ELSE {s} END"


def zscore_sql(col, cost=False, part=""):
    mu, sd = f"avg({col}) OVER ({part})", f"stddev_pop({col}) OVER ({part})"
    s = f"(least(greatest(({col}-{mu})/{sd},-3),3)+3)/6"
    s = f"1-{s}" if cost else s
    return f"CASE WHEN {col} IS NULL THEN 0 WHEN {sd}=0 THEN 0.5 ELSE {s} END"


NORMED = f"""WITH {METRICS}, n AS (SELECT *, {minmax_sql('population_served')} AS n1, {minmax_sql('travel_time_mean', True)} AS n2,
 {minmax_sql('slope', True)} AS n2, {minmax_sql('flood_risk', True, '0.1e0', '0.8e0')} AS n3 FROM m)"""
SUM_SCORE = "round_even(n1*0.5,6)+round_even(n2*0.3,6)+round_even(n3*0.2,6)-penalty0"


@query(f"""{NORMED} SELECT candidate_id, round_even(least(1,greatest(0,{SUM_SCORE})),6) AS score,
 round_even({SUM_SCORE},6) AS raw_score, round_even(penalty0,6) AS penalty FROM n""")
def score_weighted_sum(spark, d):
    out = mcda.score(part_metrics(spark, d), mcda.profile(spark, *CRITERIA), "penalty0")
    return out.select("candidate_id", "score", "raw_score", "penalty")


@query(f"""WITH {METRICS}, n AS (SELECT *, {minmax_sql('population_served', part='PARTITION BY run')}
 AS n1, {minmax_sql('slope', True, part='PARTITION BY run')} AS n2,
 {minmax_sql('flood_risk', True, '0.1e0', '0.8e0')} AS n3 FROM m)
 SELECT run, candidate_id, round_even(least(1,greatest(0,pow(greatest(n1,1e-6),0.5)
 *pow(greatest(n2,1e-6),0.3)*pow(greatest(n3,1e-6),0.2)-penalty0)),6) AS score FROM n""")
def score_weighted_product(spark, d):
    """Many runs at once: every brand is scored against itself."""
    prof = mcda.profile(spark, *CRITERIA)
    out = mcda.score(part_metrics(spark, d), prof, "penalty0", by=["run"],
                     aggregation="weighted_product")
    return out.select("run", "candidate_id", "score")


@query(f"""WITH {METRICS}, n AS (SELECT *, {zscore_sql('population_served')} AS n1,
 {zscore_sql('slope', True)} AS n2, {zscore_sql('flood_risk', True)} AS n3 FROM m)
 SELECT candidate_id, round_even(n1*0.5,6) AS population, round_even(n2*0.3,6) AS slope,
 round_even(n3*0.2,6) AS flood FROM n""")
def normalize_zscore(spark, d):
    prof = mcda.profile(spark, *CRITERIA)
    out = mcda.score(part_metrics(spark, d), prof, normalization="zscore_clipped")
    c = F.col("criteria")
    return out.select("candidate_id", *[
        c[n]["contribution"].alias(a) for n, a in (
            ("population_served", "population"), ("slope", "slope"), ("flood_risk", "flood"))])


@query(f"""{NORMED}, s AS (SELECT candidate_id, round_even(least(1,greatest(0,{SUM_SCORE})),6)
 AS score FROM n) SELECT candidate_id, row_number() OVER (ORDER BY score DESC, candidate_id)
 AS rank FROM s""")
def rank_candidates(spark, d):
    out = mcda.score(part_metrics(spark, d), mcda.profile(spark, *CRITERIA), "penalty0")
    return mcda.rank(out).select("candidate_id", "rank")


@query(f"""{NORMED}, s AS (SELECT candidate_id, round_even(least(1,greatest(0,{SUM_SCORE})),6)
 AS score FROM n), r AS (SELECT score, row_number() OVER (ORDER BY score DESC, candidate_id)
 AS rank FROM s) SELECT score AS median_score FROM r
 WHERE rank=(SELECT count(*) FROM s)//2+1""")
def median_score(spark, d):
    out = mcda.score(part_metrics(spark, d), mcda.profile(spark, *CRITERIA), "penalty0")
    return mcda.middle_score(mcda.rank(out))


@query(f"""{NORMED} SELECT candidate_id, round_even(n1*0.5,6) AS population_served,
 round_even(n2*0.3,6) AS slope, round_even(population_served,3) AS raw FROM n""")
def flatten_breakdown(spark, d):
    out = mcda.score(part_metrics(spark, d), mcda.profile(spark, *CRITERIA))
    m = out.withColumn("b", mcda.flatten_breakdown())
    return m.select("candidate_id", F.col("b")["population_served"].alias("population_served"),
                    F.col("b")["slope"].alias("slope"),
                    F.col("b")["population_served__raw"].alias("raw"))


SOLUTIONS = """s AS (SELECT o_orderkey AS id, o_totalprice AS cost,
 CAST(o_custkey%97 AS DOUBLE) AS reach,
 CASE WHEN o_orderkey%10=0 THEN NULL ELSE CAST(o_orderkey%89 AS DOUBLE) END AS risk
 FROM orders)"""


def solutions(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_totalprice AS cost", "CAST(o_custkey%97 AS DOUBLE) AS reach",
        "CASE WHEN o_orderkey%10=0 THEN NULL ELSE CAST(o_orderkey%89 AS DOUBLE) END AS risk")


@query(f"""WITH {SOLUTIONS}, n AS (SELECT id,
 (1-(cost-min(cost) OVER ())/(max(cost) OVER ()-min(cost) OVER ()))*0.5 AS a,
 (reach-min(reach) OVER ())/(max(reach) OVER ()-min(reach) OVER ())*0.3 AS b,
 (1-(risk-min(risk) OVER ())/(max(risk) OVER ()-min(risk) OVER ()))*0.2 AS c FROM s)
 SELECT id, round_even(a+b+coalesce(c,0),6) AS score FROM n""")
def weighted_scalarization(spark, d):
    out = mcda.scalarize(solutions(spark, d), {"cost": 0.5, "reach": 0.3, "risk": 0.2},
                         {"cost": "min", "reach": "max", "risk": "min"})
    return out.select("id", "score")


@query(f"""WITH {SOLUTIONS} SELECT id, cost, reach, risk, true AS pareto_optimal FROM s b
 WHERE NOT EXISTS (SELECT 1 FROM s a WHERE NOT coalesce(a.cost>b.cost,false)
 AND NOT coalesce(a.reach<b.reach,false) AND NOT coalesce(a.risk>b.risk,false)
 AND (coalesce(a.cost<b.cost,false) OR coalesce(a.reach>b.reach,false)
 OR coalesce(a.risk<b.risk,false)))""")
def pareto_front(spark, d):
    return mcda.pareto_front(solutions(spark, d), "id",
                             {"cost": "min", "reach": "max", "risk": "min"})


@query("""WITH l AS (SELECT o_custkey AS planner, CASE o_orderpriority WHEN '1-URGENT' THEN
 'population_served' WHEN '2-HIGH' THEN 'flood_risk' WHEN '3-MEDIUM' THEN
 'distance_to_same_type' WHEN '5-LOW' THEN 'flood_risk' END AS metric,
 greatest(0,floor(o_totalprice/1000)-100) AS w FROM orders), s AS (SELECT planner, metric,
 sum(w) AS w FROM l WHERE metric IS NOT NULL GROUP BY 1,2 HAVING sum(w)>0)
 SELECT planner, metric, CASE metric WHEN 'flood_risk' THEN 'cost' ELSE 'benefit' END AS direction,
 round(w/sum(w) OVER (PARTITION BY planner),6) AS weight FROM s""")
def weights_to_profile(spark, d):
    labels = table(spark, d, "orders").selectExpr(
        "o_custkey AS planner", "CASE o_orderpriority WHEN '1-URGENT' THEN ' Population' "
        "WHEN '2-HIGH' THEN 'Flood risk' WHEN '3-MEDIUM' THEN 'Coverage' WHEN '5-LOW' THEN "
        "'FLOOD' ELSE 'noise' END AS label", "floor(o_totalprice/1000)-100D AS weight")
    out = mcda.label_weights(labels, mcda.known_labels(spark), ["planner"])
    return out.select("planner", "metric", "direction", F.round("weight", 6).alias("weight"))


LABELS = """WITH l AS (SELECT o_custkey AS planner, CASE o_orderkey%5 WHEN 0 THEN 'Slope ' WHEN 1
 THEN 'colour' ELSE 'area' END AS label, CASE o_orderkey%3 WHEN 0 THEN 'much' WHEN 1 THEN '-2'
 ELSE '4' END AS weight FROM orders)"""


@query(LABELS + """ SELECT planner, label, CASE WHEN label='colour' THEN 'unknown label' WHEN weight='much'
 THEN 'no number' ELSE 'negative, counted as 0' END AS note FROM l
 WHERE label='colour' OR weight<>'4'""")
def profile_notes(spark, d):
    labels = table(spark, d, "orders").selectExpr(
        "o_custkey AS planner", "CASE o_orderkey%5 WHEN 0 THEN 'Slope ' WHEN 1 THEN 'colour' "
        "ELSE 'area' END AS label", "CASE o_orderkey%3 WHEN 0 THEN 'much' WHEN 1 THEN '-2' "
        "ELSE '4' END AS weight")
    return mcda.label_notes(labels, mcda.known_labels(spark), ["planner"])


@query(with_layers("parcel", "zone", "facility") + """, t AS (SELECT p.id AS parcel_id,
 greatest(0,100-coalesce(slope,2e0)*5) AS land, greatest(0,(1-coalesce(flood_risk,0.05e0))*100) AS dry,
 CASE status WHEN 'vacant' THEN 100e0 WHEN 'under_development' THEN 60e0 ELSE 0e0 END AS free
 FROM parcel p), u AS (SELECT *, 0.5e0*land+0.3e0*dry+0.2e0*free AS total FROM t)
 SELECT parcel_id, round_even(total,1) AS score, CASE WHEN total>=80 THEN 'Highly Suitable'
 WHEN total>=65 THEN 'Suitable' ELSE 'Conditional' END AS recommendation FROM u""")
def older_site_score(spark, d):
    p = layer(spark, d, "parcel").selectExpr(
        "id AS parcel_id", "greatest(0D, 100D - coalesce(slope, 2D) * 5D) AS land",
        "greatest(0D, (1D - coalesce(flood_risk, 0.05D)) * 100D) AS dry",
        "CASE status WHEN 'vacant' THEN 100D WHEN 'under_development' THEN 60D ELSE 0D END AS free")
    out = mcda.banded_score(p, {"land": 0.5, "dry": 0.3, "free": 0.2},
                            ((80.0, "Highly Suitable"), (65.0, "Suitable")), "Conditional")
    return out.select("parcel_id", "score", "recommendation")


# ------------------------------------------------------------------ site search
REQ = suitability.Requirements(
    facility_type="hospital", required_area=1500.0, max_slope=15.0, max_flood_risk=0.7,
    allowed_status=("vacant", "under_development"), service_radius=500.0, travel_time_cutoff=60.0,
    top_n=20)


def search(spark, d, req=REQ):
    return suitability.site_suitability(
        parcels(spark, d), req, constraint_layer=constraint_layer(spark, d),
        zones=layer(spark, d, "zone"), facilities=layer(spark, d, "facility"),
        edges=cut(edges(spark, d)))


# Edge-by-edge area of the 64-corner disc of radius {r} inside a box.
def disc_sql(x, y, r, z):
    def px(i):
        return f"({x}+{r}*cos((({i})%64)*(2*pi()/64)))"

    def py(i):
        return f"({y}+{r}*sin((({i})%64)*(2*pi()/64))-{z}.miny)"

    h = f"({z}.maxy-{z}.miny)"
    p = f"least(greatest({px('i')},{z}.minx),{z}.maxx)"
    q = f"least(greatest({px('i+1')},{z}.minx),{z}.maxx)"
    m = f"(({py('i+1')}-{py('i')})/({px('i+1')}-{px('i')}))"
    u = f"({py('i')}+({p}-{px('i')})*{m})"
    v = f"({py('i')}+({q}-{px('i')})*{m})"

    def ramp(t):
        return f"(pow(greatest({t},0),2)-pow(greatest({t}-{h},0),2))/2"
    body = (f"CASE WHEN {px('i+1')}={px('i')} OR {p}={q} THEN 0 WHEN {u}={v} THEN ({q}-{p})*"
            f"least(greatest({u},0),{h}) ELSE ({q}-{p})*({ramp(v)}-{ramp(u)})/({v}-{u}) END")
    return f"greatest(0,-list_sum(list_transform(range(64), lambda i: {body})))"


REACH = f"""pt AS (SELECT id, (minx+maxx)/2 AS x, (miny+maxy)/2 AS y FROM {{src}}),
 near AS (SELECT pt.id, pt.x, pt.y, z.* EXCLUDE (id) FROM pt JOIN zone z
 ON z.minx<pt.x+500 AND z.maxx>pt.x-500 AND z.miny<pt.y+500 AND z.maxy>pt.y-500),
 reach AS (SELECT id, sum(population*{disc_sql('near.x','near.y','500e0','near')}
 /((maxx-minx)*(maxy-miny))) AS pop FROM near GROUP BY id)"""


@query(with_layers("parcel", "zone") + ", " + REACH.format(src="parcel") + """
 SELECT p.id AS parcel_id, round(coalesce(pop,0),1) AS population FROM parcel p
 LEFT JOIN reach USING (id)""")
def population_in_reach(spark, d):
    p = layer(spark, d, "parcel").select(
        F.col("id").alias("parcel_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    got = candidates.population_in_reach(p, layer(spark, d, "zone"), 500.0, key="parcel_id")
    return p.join(got, "parcel_id", "left").select("parcel_id", F.round(
        F.coalesce("population", F.lit(0.0)), 1).alias("population"))


def at_node(x, y):
    """Nearest node of a place in SQL."""
    d = f"(x-{x})*(x-{x})+(y-{y})*(y-{y})"
    return f"(SELECT node FROM pos ORDER BY {d}, CAST(x AS BIGINT), CAST(y AS BIGINT) LIMIT 1)"


# Mean time of the zones within a minute, one search a node where a surviving parcel stands.
TIMES = f"""{edge_sql()}, {AT}, zc AS (SELECT population, (minx+maxx)/2 AS px, (miny+maxy)/2 AS py
 FROM zone), zp AS (SELECT {at_node('px', 'py')} AS node, sum(population) AS w, count(*) AS n FROM zc GROUP BY 1),
 pp AS (SELECT id, {at_node('pt.x', 'pt.y')} AS node FROM pt),
 tm(target, node, c) USING KEY (target, node) AS (SELECT DISTINCT node, node, 0e0 FROM pp
 UNION SELECT tm.target, e.src, min(tm.c+e.t) FROM tm JOIN e ON e.dst=tm.node LEFT JOIN recurring.tm r
 ON r.target=tm.target AND r.node=e.src WHERE tm.c+e.t<=60 AND (r.node IS NULL OR tm.c+e.t<r.c)
 GROUP BY tm.target, e.src), tt AS (SELECT target AS node, CASE WHEN sum(w)>0 THEN sum(c*w)/sum(w)
 ELSE sum(c*n)/sum(n) END AS mean FROM tm JOIN zp USING (node) GROUP BY 1)"""

SEARCH = CONS.replace("WITH ", "WITH RECURSIVE ", 1) + HITS + f""", pen AS (SELECT id, round_even(sum(CASE WHEN severity<>'hard'
 THEN weight*o END),6) AS s, count(*) FILTER (severity='hard') AS hard FROM hit GROUP BY id),
 alive AS (SELECT p.*, coalesce(pen.s,0) AS pen FROM parcel p LEFT JOIN pen ON pen.id=p.id
 WHERE len({FAILED})=0 AND coalesce(hard,0)=0), """ + REACH.format(src="alive") + ", " + TIMES + f""",
 same AS (SELECT pt.id, min(sqrt((pt.x-f.x)*(pt.x-f.x)+(pt.y-f.y)*(pt.y-f.y))) AS dist
 FROM pt JOIN facility f ON f.type='hospital' GROUP BY pt.id),
 m AS (SELECT 'cand-'||a.id AS candidate_id, a.id AS parcel_id, a.pen,
 round_even(coalesce(pop,0),2) AS population_served, round_even(mean,2) AS travel_time_mean,
 round_even(dist,2) AS distance_to_same_type, flood_risk, slope
 FROM alive a LEFT JOIN reach USING (id) LEFT JOIN same USING (id) LEFT JOIN pp USING (id)
 LEFT JOIN tt ON tt.node=pp.node),
 n AS (SELECT *, {minmax_sql('population_served')} AS n1, {minmax_sql('travel_time_mean', True)} AS n2,
 {minmax_sql('distance_to_same_type')} AS n3, {minmax_sql('flood_risk', True)} AS n4,
 {minmax_sql('slope', True)} AS n5 FROM m),
 s AS (SELECT *, round_even(least(1,greatest(0,round_even(n1*0.35,6)+round_even(n2*0.25,6)+round_even(n3*0.15,6)
 +round_even(n4*0.15,6)+round_even(n5*0.10,6)-pen)),6) AS score FROM n)"""


@query(SEARCH + """ SELECT CAST(row_number() OVER (ORDER BY score DESC, candidate_id) AS BIGINT)
 AS rank, parcel_id, score, population_served, travel_time_mean
 FROM s ORDER BY score DESC, candidate_id LIMIT 20""")
def site_suitability(spark, d):
    return search(spark, d).records.select(
        "rank", "parcel_id", "score", "population_served", "travel_time_mean")


@query(SEARCH + """ SELECT (SELECT count(*) FROM parcel) AS parcels_evaluated,
 (SELECT count(*) FROM parcel)-count(*) AS parcels_rejected,
 count(*) AS candidates_generated, least(count(*),20) AS candidates_returned,
 max(score) AS best_score FROM s""")
def site_suitability_summary(spark, d):
    return search(spark, d).summary


@query(SEARCH + """ SELECT parcel_id, CASE WHEN travel_time_mean > 35 THEN 'max_travel_time'
 ELSE 'min_distance_same_type' END AS rule FROM s WHERE travel_time_mean > 35 OR distance_to_same_type < 800""")
def post_score_rules(spark, d):
    req = suitability.Requirements(
        facility_type="hospital", required_area=1500.0, max_slope=15.0, max_flood_risk=0.7,
        allowed_status=("vacant", "under_development"), service_radius=500.0,
        travel_time_cutoff=60.0, max_travel_time=35.0, min_distance_same_type=800.0)
    return search(spark, d, req).rejected.select(
        "parcel_id", F.col("reject")["rule"].alias("rule"))


@query("""SELECT p_partkey AS id, CASE WHEN NOT (p_retailprice-850 BETWEEN 0 AND 100)
 THEN 'REJECTED' WHEN p_size-3<0 THEN 'REJECTED' ELSE 'APPROVED' END AS status,
 CAST(NOT (p_retailprice-850 BETWEEN 0 AND 100) AS INTEGER)+CAST(p_size-3<0 AS INTEGER) AS n
 FROM part""")
def sanity_checks(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey AS id", "p_retailprice-850 AS site_score",
        "CAST(p_size-3 AS DOUBLE) AS estimated_cost",
        "CAST(p_size AS DOUBLE) AS travel_time_minutes")
    return constraints.sanity_checks(df).select("id", "status", F.size("errors").alias("n"))


@query("""SELECT p_partkey AS road_id, CAST((1+p_size%6) AS DOUBLE)*3.5e0 AS width,
 CASE WHEN p_size%4=0 THEN CASE p_size%3 WHEN 0 THEN 50e0 WHEN 1 THEN 25e0 ELSE 30e0 END
 ELSE CAST(p_size AS DOUBLE) END AS speed, (1+p_size%6)*CASE p_size%3 WHEN 0 THEN 1500e0
 WHEN 1 THEN 600e0 ELSE 600e0 END AS capacity FROM part""")
def road_from_alignment(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey AS road_id", "1+p_size%6 AS lanes",
        "CASE p_size%3 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' ELSE 'lane' END "
        "AS road_class", "CASE WHEN p_size%4=0 THEN 0D ELSE CAST(p_size AS DOUBLE) END AS speed")
    cols = constraints.road_attributes()
    return df.select("road_id", *[c.alias(n) for n, c in cols.items()])


ALIGN = """al AS (SELECT p_partkey AS alignment_id, CAST((p_partkey*3571)%9900
 +10000*(CAST(floor(p_partkey/2000) AS BIGINT)%100) AS DOUBLE) AS ax,
 CAST((p_partkey*28657)%9900+10000*CAST(floor(CAST(floor(p_partkey/2000) AS BIGINT)/100)
 AS BIGINT) AS DOUBLE) AS ay, CAST(p_size*4 AS DOUBLE) AS len FROM part)"""


def alignments(spark, d):
    lines = table(spark, d, "part").selectExpr(
        "p_partkey AS alignment_id",
        "CAST((p_partkey*3571)%9900+10000*(CAST(floor(p_partkey/2000) AS BIGINT)%100) "
        "AS DOUBLE) AS ax",
        "CAST((p_partkey*28657)%9900+10000*CAST(floor(CAST(floor(p_partkey/2000) AS BIGINT)"
        "/100) AS BIGINT) AS DOUBLE) AS ay", "CAST(p_size*4 AS DOUBLE) AS len")
    return lines.select("alignment_id", F.array(F.array(
        g.vertex("ax", "ay"), g.vertex(F.col("ax") + F.col("len"), "ay"))).alias("rings"))


def footprints(spark, d):
    return layer(spark, d, "building").select(
        F.col("id").alias("b_id"), g.box_rings(*BOX).alias("b_rings"))


@query(with_layers("constraint", "building").replace("constraint AS", "craw AS") +
       f""", cons AS (SELECT * EXCLUDE (severity), {SEVERITY_CASES} AS severity,
 {WEIGHT_CASES} AS weight FROM craw), {ALIGN},
 ch AS (SELECT alignment_id, count(*) FILTER (severity='hard') AS hc,
 sum(CASE WHEN severity='hard' THEN greatest(0,least(ax+len,maxx)-greatest(ax,minx)) END) AS hm,
 sum(CASE WHEN severity<>'hard' THEN weight END) AS sp FROM al JOIN cons ON ay>=miny
 AND ay<=maxy AND ax<=maxx AND ax+len>=minx GROUP BY 1),
 bh AS (SELECT alignment_id, count(*) AS n FROM al JOIN building ON ay>=miny AND ay<=maxy
 AND ax<=maxx AND ax+len>=minx GROUP BY 1)
 SELECT alignment_id, len>=10 AND coalesce(hc,0)=0 AS passed, coalesce(hc,0) AS hard_crossings,
 round(coalesce(hm,0),2) AS hard_crossing_m, round_even(coalesce(sp,0),6) AS soft_penalty,
 coalesce(n,0) AS buildings_displaced FROM al LEFT JOIN ch USING (alignment_id)
 LEFT JOIN bh USING (alignment_id)""")
def alignment_validation(spark, d):
    lines = alignments(spark, d)
    cons = constraint_layer(spark, d).select(
        "c_severity", "c_weight", g.box_rings("c_minx", "c_miny", "c_maxx", "c_maxy")
        .alias("c_rings"))
    out = constraints.validate_alignments(lines, cons, footprints(spark, d))
    return out.select("alignment_id", "passed", "hard_crossings", "hard_crossing_m",
                      "soft_penalty", "buildings_displaced")


@query(with_layers("building") + f""", {ALIGN} SELECT alignment_id, building.id AS b_id FROM al JOIN building
 ON ay>=miny AND ay<=maxy AND ax<=maxx AND ax+len>=minx""")
def displaced_buildings(spark, d):
    return constraints.displaced_buildings(alignments(spark, d), footprints(spark, d))
