"""Scenario logs, plan comparison, cost, demand and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregation, comparison, scenario
from ..plans import analysis
from ..sources.layers import layer, table, with_layers
from . import query


def log(spark, d):
    """Events as a scenario change log; every third creation lacks its geometry."""
    return layer(spark, d, "change").withColumn("parameters", F.when(
        (F.col("operation") == "INSERT") & (F.col("change_id") % 3 != 0),
        F.concat(F.expr("substring(parameters, 1, length(parameters)-1)"),
                 F.lit(', "geometry": {"type":"Point"}}'))).otherwise(F.col("parameters")))


def base(spark, d):
    return table(spark, d, "part").select(F.lit("parcel").alias("entity_type"),
                                          F.col("p_partkey").alias("id"))


def changes(spark, d):
    return scenario.engine_changes(log(spark, d))


CH = """ch AS (SELECT event_id AS change_id, user_id%5 AS scenario_id, user_id AS id,
 CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'modify' END AS op,
 event_type='signup' AND event_id%3<>0 AS geom,
 CAST(json_extract_string(props,'$.k') AS VARCHAR) AS k FROM events),
 st AS (SELECT *, CASE WHEN op='delete' THEN false WHEN op='add' AND geom THEN true END AS eff
 FROM ch), ex AS (SELECT *, coalesce(last_value(eff IGNORE NULLS) OVER (PARTITION BY
 scenario_id, id ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 id IN (SELECT p_partkey FROM part)) AS there FROM st),
 ju AS (SELECT *, CASE WHEN op='delete' AND NOT there THEN 'delete target not found'
 WHEN op='modify' AND NOT there THEN 'modify target not found'
 WHEN op='add' AND there THEN 'add id already exists'
 WHEN op='add' AND NOT geom THEN 'cannot construct record; geometry missing' END AS reason FROM ex)"""


@query("""SELECT event_id AS change_id, user_id%5 AS scenario_id, 'parcel' AS entity_type,
 CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'modify' END AS operation,
 CAST(user_id AS VARCHAR) AS entity_id, json_extract_string(props,'$.k') AS k FROM events""")
def scenario_vocabulary(spark, d):
    return changes(spark, d).select("change_id", "scenario_id", "entity_type", "operation",
                                    "entity_id", F.col("attributes")["k"].alias("k"))


@query(f"WITH {CH} SELECT change_id, coalesce(reason,'applied') AS verdict FROM ju")
def resolve_scenario_verdicts(spark, d):
    return scenario.judge(changes(spark, d), base(spark, d)).select(
        "change_id", F.coalesce("reason", F.lit("applied")).alias("verdict"))


@query(f"""WITH {CH}, ap AS (SELECT * FROM ju WHERE reason IS NULL), la AS (SELECT scenario_id, id,
 max(change_id) FILTER (op<>'modify') AS turn, max_by(op, change_id) FILTER (op<>'modify') AS lop
 FROM ap GROUP BY 1,2), va AS (SELECT a.scenario_id, a.id, max_by(k, change_id) AS k FROM ap a
 JOIN la ON la.scenario_id=a.scenario_id AND la.id=a.id WHERE op<>'delete'
 AND change_id>=coalesce(turn,-1) GROUP BY 1,2)
 SELECT la.scenario_id, CAST(la.id AS VARCHAR) AS entity_id, CASE WHEN lop='add' THEN 'added'
 WHEN lop IS NULL THEN 'modified' WHEN la.id IN (SELECT p_partkey FROM part) THEN 'deleted' END
 AS state, k FROM la LEFT JOIN va ON va.scenario_id=la.scenario_id AND va.id=la.id
 WHERE lop='add' OR lop IS NULL OR la.id IN (SELECT p_partkey FROM part)""")
def resolve_scenario(spark, d):
    b = base(spark, d)
    out = scenario.resolve(scenario.judge(changes(spark, d), b), b)
    return out.select("scenario_id", "entity_id", "state",
                      F.try_element_at("attributes", F.lit("k")).alias("k"))


@query(f"""WITH {CH}, ap AS (SELECT * FROM ju WHERE reason IS NULL), la AS (SELECT scenario_id, id,
 max(change_id) FILTER (op<>'modify') AS turn, max_by(op, change_id) FILTER (op<>'modify') AS lop
 FROM ap GROUP BY 1,2), va AS (SELECT a.scenario_id, a.id, max_by(CAST(k AS DOUBLE), change_id)
 AS k FROM ap a JOIN la ON la.scenario_id=a.scenario_id AND la.id=a.id WHERE op<>'delete'
 AND change_id>=coalesce(turn,-1) GROUP BY 1,2), sc AS (SELECT unnest([0,1,2,3,4]) AS scenario_id),
 st2 AS (SELECT sc.scenario_id, p_partkey AS id, CASE WHEN lop IS NULL THEN k END AS k, p_size
 FROM sc CROSS JOIN part LEFT JOIN la ON la.scenario_id=sc.scenario_id AND la.id=p_partkey
 LEFT JOIN va ON va.scenario_id=sc.scenario_id AND va.id=p_partkey WHERE lop IS NULL
 UNION ALL SELECT la.scenario_id, la.id, k, NULL FROM la LEFT JOIN va
 ON va.scenario_id=la.scenario_id AND va.id=la.id WHERE lop='add')
 SELECT CAST(scenario_id AS BIGINT) AS scenario_id, count(*) AS parcels,
 sum(coalesce(k,p_size)) AS k_total FROM st2 GROUP BY 1""")
def scenario_states(spark, d):
    """All five proposed cities in one job."""
    b = base(spark, d)
    res = scenario.resolve(scenario.judge(changes(spark, d), b), b)
    parcels = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("k"))
    out = scenario.apply_to_base(parcels, res, "parcel", [0, 1, 2, 3, 4], {"k": "double"})
    return out.groupBy(F.col("scenario_id").cast("bigint").alias("scenario_id")).agg(
        F.count(F.lit(1)).alias("parcels"), F.sum("k").alias("k_total"))


@query(f"""WITH {CH} SELECT scenario_id, 'total' AS part, 'total' AS value, count(*) AS n FROM ch
 GROUP BY 1 UNION ALL SELECT scenario_id, 'operation', op, count(*) FROM ch GROUP BY 1,3
 UNION ALL SELECT scenario_id, 'entity_type', 'parcel', count(*) FROM ch GROUP BY 1""")
def change_summary(spark, d):
    return scenario.change_summary(changes(spark, d), ["scenario_id"])


@query(f"""WITH {CH}, a AS (SELECT DISTINCT id, op FROM ch WHERE scenario_id=0), b AS
 (SELECT DISTINCT id-1 AS id, op FROM ch WHERE scenario_id=1) SELECT 'parcel' AS entity_type,
 CAST(coalesce(a.id,b.id) AS VARCHAR) AS entity_id, coalesce(a.op,b.op) AS operation,
 CASE WHEN b.id IS NULL THEN 'only_in_a' WHEN a.id IS NULL THEN 'only_in_b' ELSE 'in_both' END
 AS side FROM a FULL JOIN b ON a.id=b.id AND a.op=b.op""")
def diff_scenarios(spark, d):
    c = changes(spark, d)
    other = c.where("scenario_id = 1").withColumn(
        "entity_id", (F.col("entity_id").cast("long") - 1).cast("string"))
    return scenario.diff(c.where("scenario_id = 0"), other)


@query("""SELECT s.scenario_id, n_name AS name, 'draft' AS status, 2035 AS horizon,
 event_id AS change_id, CASE WHEN event_id IS NOT NULL THEN 'zoning' END AS type,
 CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE
 CASE WHEN event_id IS NOT NULL THEN 'UPDATE' END END||' LAND_PARCELS' AS label
 FROM (SELECT CAST(n_nationkey AS BIGINT) AS scenario_id, n_name FROM nation) s
 LEFT JOIN events e ON e.user_id%5=s.scenario_id""")
def scenario_listing(spark, d):
    heads = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("scenario_id"), F.col("n_name").alias("name"),
        F.lit("Draft").alias("status"), F.lit(None).cast("int").alias("horizon"),
        F.lit(None).cast("double").alias("population_growth_pct"))
    return scenario.with_changes(heads, log(spark, d)).select(
        "scenario_id", "name", "status", "horizon", "change_id", "type", "label")


# ------------------------------------------------------------------- comparison
PROFILE = {"F": (0.5, "max"), "O": (0.3, "min"), "P": (0.2, "min")}


def plan_metrics(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.max("o_totalprice").alias("value"))
    return o.select(F.col("o_custkey").alias("scenario_id"), F.col("o_orderstatus").alias("metric"),
                    "value", F.lit(1).alias("seq"), F.lit(1).alias("dataset_version"))


PLANS = """v AS (SELECT o_custkey AS id, o_orderstatus AS m, max(o_totalprice) AS v FROM orders
 GROUP BY 1,2), r AS (SELECT m, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1), s AS (SELECT id, m,
 CASE WHEN m='F' THEN (v-lo)/(hi-lo) ELSE 1-(v-lo)/(hi-lo) END AS n,
 CASE m WHEN 'F' THEN 0.5e0 WHEN 'O' THEN 0.3e0 ELSE 0.2e0 END AS w FROM v JOIN r USING (m)),
 g AS (SELECT id AS scenario_id, round_even(sum(n*w)/sum(w),6) AS overall_score,
 round_even(sum(w),4) AS weight_coverage, 3-count(*) AS gaps FROM s GROUP BY 1)"""


@query(f"WITH {PLANS} SELECT * FROM g")
def compare_scenarios(spark, d):
    out = comparison.compare_plans(plan_metrics(spark, d), PROFILE)
    return out.select("scenario_id", "overall_score", "weight_coverage",
                      F.size("missing_metrics").cast("bigint").alias("gaps"))


@query(f"""WITH {PLANS} SELECT scenario_id, row_number() OVER (ORDER BY
 coalesce(overall_score,-1) DESC, scenario_id) AS rank, c_name AS scenario_name FROM g
 LEFT JOIN customer ON c_custkey=scenario_id""")
def scenario_ranking(spark, d):
    out = comparison.rank_plans(comparison.compare_plans(plan_metrics(spark, d), PROFILE))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("id"),
                                               F.col("c_name").alias("name"))
    return comparison.with_names(out, names).select("scenario_id", "rank", "scenario_name")


@query("""WITH m AS (SELECT o_custkey AS k, o_orderstatus AS metric, o_orderpriority AS run,
 max(o_totalprice) AS v FROM orders GROUP BY 1,2,3), p AS (SELECT b.k, b.metric, b.v AS b, a.v AS a
 FROM m b JOIN m a ON a.k=b.k AND a.metric=b.metric WHERE b.run='1-URGENT' AND a.run='5-LOW')
 SELECT k AS custkey, metric, round_even(b,4) AS before, round_even(a,4) AS after,
 round_even(a-b,4) AS delta, round_even((a-b)/abs(b)*100,2) AS pct_change, a-b<0 AS improved FROM p""")
def run_deltas(spark, d):
    m = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("metric"),
        F.col("o_orderpriority").alias("run")).agg(F.max("o_totalprice").alias("value"))
    return comparison.run_deltas(m, "1-URGENT", "5-LOW", by=["custkey"])


@query("""SELECT o_custkey AS run, o_orderstatus AS metric, max_by(o_totalprice, o_orderkey) AS value
 FROM orders WHERE o_orderkey%4<>0 GROUP BY 1,2""")
def latest_metrics(spark, d):
    m = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("metric"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("value"),
        F.col("o_orderkey").alias("seq"))
    return comparison.latest_metrics(m, ["run"])


# ------------------------------------------------------------------------- cost
def quantities(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("item")).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)"))
                                            .cast("double").alias("quantity"))


def rates(spark, d):
    return table(spark, d, "part").where("p_brand rlike '[02468]$'").groupBy(
        F.col("p_brand").alias("item")).agg(F.max("p_retailprice").alias("rate"))


COST = """q AS (SELECT p_brand AS item, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS q
 FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1), r AS (SELECT p_brand AS item,
 max(p_retailprice) AS rate FROM part WHERE regexp_matches(p_brand,'[02468]$') GROUP BY 1)"""


@query(f"""WITH {COST} SELECT item, round_even(q,3) AS quantity, rate AS unit_rate,
 round(q*rate,2) AS amount, rate IS NOT NULL AS priced FROM q LEFT JOIN r USING (item)""")
def cost_items(spark, d):
    return comparison.price(quantities(spark, d), rates(spark, d)).drop("_amount")


@query(f"""WITH {COST}, s AS (SELECT sum(q*rate) AS s, count(rate) AS n FROM q LEFT JOIN r
 USING (item)) SELECT round(s,1) AS subtotal, round(s*0.15,1) AS contingency,
 round((s+s*0.15)*0.1,1) AS escalation, round(s+s*0.15+(s+s*0.15)*0.1,1) AS total_cost,
 n AS line_items_priced FROM s""")
def cost_totals(spark, d):
    out = comparison.cost_totals(comparison.price(quantities(spark, d), rates(spark, d)),
                                 escalation=0.1)
    return out.select(*[F.round(c, 1).alias(c) if c != "line_items_priced" else F.col(c)
                        for c in out.columns])


# ------------------------------------------------------------ demand, projection
@query(with_layers("zone") + """ SELECT id AS zone_id, population AS population,
 round_even(population/1000*150,2) AS required_capacity FROM zone""")
def zone_demand(spark, d):
    z = layer(spark, d, "zone").select(F.col("id").alias("zone_id"), "population")
    return aggregation.zone_demand(z, "school")


@query(with_layers("zone", "facility") + """, p AS (SELECT sum(population) AS pop FROM zone),
 k(type, per, unit) AS (VALUES ('hospital',1.0e0,'beds'),('school',150e0,'seats'),
 ('fire_station',0.02e0,'stations'),('clinic',0.5e0,'clinics')),
 h AS (SELECT type, sum(capacity) AS have, count(*) AS n FROM facility GROUP BY 1)
 SELECT k.type AS facility_type, unit, pop AS population_served_basis,
 round_even(pop/1000*per,2) AS required_capacity, coalesce(have,0e0) AS installed_capacity,
 round_even(greatest(0,pop/1000*per-coalesce(have,0)),2) AS capacity_deficit,
 round_even(greatest(0,coalesce(have,0)-pop/1000*per),2) AS capacity_surplus,
 CASE WHEN have>0 THEN round_even(pop/1000*per/have,4) END AS utilization_ratio,
 coalesce(n,0) AS facilities_counted FROM p CROSS JOIN k LEFT JOIN h ON h.type=k.type""")
def demand_vs_capacity(spark, d):
    return aggregation.demand_vs_capacity(layer(spark, d, "zone"), layer(spark, d, "facility"),
                                          ["hospital", "school", "fire_station", "clinic"])


GROW = """g AS (SELECT id, population AS p0, CASE WHEN region%5=0 THEN 0.02e0 ELSE 0.01e0*(region%5)
 END AS r, CASE WHEN id%2=0 THEN 1.2e0*population END AS cap,
 (maxx-minx)*(maxy-miny)/1e6 AS km2 FROM zone), j AS (SELECT *, p0*pow(1+r,10) AS x FROM g),
 k AS (SELECT *, CASE WHEN x>cap THEN cap ELSE x END AS p1, coalesce(x>cap,false) AS capped FROM j)"""


def projected(spark, d):
    z = layer(spark, d, "zone").withColumns({
        "rate": F.expr("CASE WHEN region%5=0 THEN NULL ELSE 0.01D*(region%5) END"),
        "ceiling": F.expr("CASE WHEN id%2=0 THEN 1.2D*population END")})
    return aggregation.project_population(
        z, 10, 0.02, rate="rate", ceiling="ceiling",
        area_m2=(F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))


@query(with_layers("zone") + f""", {GROW} SELECT id AS zone_id, round_even(p1,1) AS
 population_projected, round_even(CASE WHEN p0>0 THEN p1/p0 END,4) AS growth_ratio,
 capped AS capacity_capped, round_even(p1/km2,1) AS density_projected FROM k""")
def project_population(spark, d):
    return projected(spark, d).select(
        F.col("id").alias("zone_id"), "population_projected", "growth_ratio",
        "capacity_capped", "density_projected")


@query(with_layers("zone") + f""", {GROW} SELECT sum(p0) AS population_base,
 round_even(sum(p1),1) AS population_projected, round_even(sum(p1)-sum(p0),1) AS absolute_growth,
 round_even(sum(p1)/sum(p0),4) AS growth_ratio FROM k""")
def projection_totals(spark, d):
    return aggregation.projection_totals(projected(spark, d))


@query(with_layers("zone", "facility") + f""", {GROW}, t AS (SELECT sum(round_even(p1,1)) AS pop
 FROM k) SELECT round_even(pop,1) AS population_served_basis,
 round_even(pop/1000*0.5,2) AS required_capacity, (SELECT sum(capacity) FROM facility
 WHERE type='clinic') AS installed_capacity FROM t""")
def demand_at_horizon(spark, d):
    """Projected population overrides the current one where there is a projection."""
    z = layer(spark, d, "zone").select("id", "population")
    over = aggregation.with_projection(z, projected(spark, d), ["id"])
    return aggregation.demand_vs_capacity(over, layer(spark, d, "facility"), ["clinic"]).select(
        "population_served_basis", "required_capacity", "installed_capacity")


@query(with_layers("zone", "facility") + """, y(years) AS (VALUES (0),(5),(10)), p AS (SELECT years,
 sum(population*pow(1.025e0,years)) AS pop FROM zone, y GROUP BY 1), k(type, per) AS (VALUES
 ('hospital',1.0e0),('school',150e0)), h AS (SELECT type, sum(capacity) AS have FROM facility GROUP BY 1)
 SELECT years, k.type AS facility_type, round_even(round_even(pop/1000*per,2),1) AS required_capacity,
 coalesce(have,0e0) AS installed_capacity FROM p CROSS JOIN k LEFT JOIN h ON h.type=k.type""")
def demand_by_horizon(spark, d):
    """Demand now, in five and in ten years, in one job."""
    out = analysis.demand_by_horizon(layer(spark, d, "zone"), layer(spark, d, "facility"),
                                     ["hospital", "school"], [0, 5, 10], 0.025)
    return out.select("years", "facility_type", F.bround("required_capacity", 1).alias("required_capacity"),
                      "installed_capacity")
