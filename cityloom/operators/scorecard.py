"""The ten-dimension area scorecard, benchmark gaps and development packages. Regions (and
package variants) are key columns, so any number of them share one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import (ACCESS_ROAD_M, BENCHMARKS, BENCHMARK_PAIRING, CONTINGENCY_RATE,
                            CORRIDOR_M, CORRIDOR_STEP, DEPENDENCIES,
                            DIMENSIONS, EDUCATION_WORDS, EMERGENCY_WORDS, FACILITY_COST,
                            FACILITY_LABEL, FACILITY_STEP, FLOOD_LIMIT, FRONTAGE_M,
                            GREEN_WORDS, HEALTH_WORDS, MIN_GAP, RECREATION_WORDS, REMEDIES,
                            ROAD_REMEDIES, UNIT_RATES)
from ..functions.scalars import clamp, contains_any, half_even, ratio
from .gridjoin import box_semi
from .overlay import BOX, pbox, prefixed

DIM_SCHEMA = ("key string, position int, label string, unit string, floor double, "
              "target double, weight double")


def dimensions(spark: SparkSession, weights: dict | None = None) -> DataFrame:
    """Fixed dimension table; given weights replace the default ones, unknown keys do
    nothing."""
    w = weights or {}
    rows = [(k, i, label, unit, lo, hi, float(w.get(k, wt)))
            for i, (k, label, unit, lo, hi, wt) in enumerate(DIMENSIONS)]
    return spark.createDataFrame(rows, DIM_SCHEMA)


def benchmark_values(spark: SparkSession) -> DataFrame:
    """region, key, benchmark, benchmark_raw for every paired region."""
    rows = [(region, k, city, v) for region, city in BENCHMARK_PAIRING.items()
            for k, v in BENCHMARKS[city].items()]
    return spark.createDataFrame(
        rows, "region string, key string, benchmark string, benchmark_raw double")


def normalise(raw: Column, floor: Column, target: Column) -> Column:
    """0..100 between floor and target; NULL stays NULL."""
    pct = (raw - floor) / (target - floor) * 100.0
    return F.when(raw.isNull(), F.lit(None)).when(target == floor, F.lit(100.0)).otherwise(
        clamp(pct, 0.0, 100.0))


# ------------------------------------------------------------------ raw measures
def road_density(roads: DataFrame, parcels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Road km per km2 of the bounds of all parcels and roads."""
    finite = F.when(~F.isnan("length_m"), F.col("length_m"))
    km = roads.groupBy(*by).agg((F.coalesce(F.sum(finite), F.lit(0.0)) / 1000.0).alias("_km"))
    both = roads.select(*by, *BOX).unionByName(parcels.select(*by, *BOX))
    ext = both.groupBy(*by).agg(
        ((F.max("maxx") - F.min("minx")) * (F.max("maxy") - F.min("miny")) / 1e6).alias("_km2"))
    return km.join(ext, list(by)).select(
        *by, F.when(F.col("_km2") > 0, F.col("_km") / F.col("_km2")).alias("mobility"))


def facility_provision(facilities: DataFrame, population: DataFrame, by: Sequence[str]) -> DataFrame:
    """Health and education per 1,000, recreation per 10,000 people, emergency count.
    NULL without population; regions without facilities are absent."""
    n = facilities.groupBy(*by).agg(
        F.count_if(contains_any("type", HEALTH_WORDS)).alias("_h"),
        F.count_if(contains_any("type", EDUCATION_WORDS)).alias("_e"),
        F.count_if(contains_any("type", RECREATION_WORDS)).alias("_r"),
        F.count_if(contains_any("type", EMERGENCY_WORDS)).alias("emergency"))
    df = n.join(population, list(by), "left")
    p = F.when(F.col("population") > 0, F.col("population"))
    return df.select(*by, (1000.0 * F.col("_h") / p).alias("healthcare"),
                     (1000.0 * F.col("_e") / p).alias("education"),
                     (10000.0 * F.col("_r") / p).alias("recreation"), "emergency")


def green_space(parcels: DataFrame, population: DataFrame, by: Sequence[str]) -> DataFrame:
    """Open space in m2 per person; parcels without any give a measured 0."""
    green = contains_any("land_use", GREEN_WORDS)
    a = parcels.groupBy(*by).agg(F.sum(F.when(green, F.col("area")).otherwise(0.0)).alias("_a"))
    return a.join(population, list(by), "left").select(*by, F.when(
        F.col("population") > 0, F.col("_a") / F.col("population")).alias("green_space"))


def land_use_mix(parcels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area-weighted Shannon entropy over known uses, 0..1; NULL below two uses."""
    use = F.lower(F.when(F.col("land_use") == "", None).otherwise(F.col("land_use")))
    known = parcels.withColumn("_u", F.coalesce(use, F.lit("unknown"))).where("_u <> 'unknown'")
    a = known.groupBy(*by, "_u").agg(F.sum(F.greatest(F.col("area"), F.lit(0.0))).alias("_a"))
    # H = ln(T) - sum(a ln a) / T, so one aggregation per region is enough.
    h = a.groupBy(*by).agg(
        F.sum("_a").alias("_t"), F.count(F.lit(1)).alias("_k"),
        F.sum(F.when(F.col("_a") > 0, F.col("_a") * F.ln("_a")).otherwise(0.0)).alias("_s"))
    mix = (F.ln("_t") - F.col("_s") / F.col("_t")) / F.ln("_k")
    return h.select(*by, F.when((F.col("_k") >= 2) & (F.col("_t") > 0), mix).alias("landuse"))


def frontage_share(parcels: DataFrame, roads: DataFrame, by: Sequence[str],
                   key: str = "id") -> DataFrame:
    """Percent of parcels whose bounds, grown by 30 m, meet the bounds of a road."""
    lines = prefixed(roads.select(*by, *BOX), "r_", keep=by)
    served = box_semi(parcels, lines, BOX, pbox("r_"), [*by, key], margin=FRONTAGE_M, on=by)
    total = parcels.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    got = served.groupBy(*by).agg(F.count(F.lit(1)).alias("_s"))
    have = roads.select(*by).distinct()
    return total.join(have, list(by), "left_semi").join(got, list(by), "left").select(
        *by, (100.0 * F.coalesce("_s", F.lit(0)) / F.col("_n")).alias("infrastructure"))


def unconstrained_share(parcels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percent of assessed parcels with a flood risk below the limit."""
    seen = F.col("flood_risk").isNotNull()
    a = parcels.groupBy(*by).agg(F.count_if(seen).alias("_n"),
                                 F.count_if(F.col("flood_risk") < FLOOD_LIMIT).alias("_ok"))
    return a.select(*by, (100.0 * ratio("_ok", "_n")).alias("constraints"))


def resilience_index(components: DataFrame, emergency: DataFrame, by: Sequence[str]) -> DataFrame:
    """70 % share of the largest network component, 30 % emergency cover (full from three
    facilities). ``components``: by..., component, n."""
    c = components.groupBy(*by).agg((100.0 * F.max("n") / F.sum("n")).alias("_r"))
    cover = F.least(F.lit(1.0), F.coalesce(F.col("emergency"), F.lit(0)) / 3.0) * 100.0
    return c.join(emergency.select(*by, "emergency"), list(by), "left").select(
        *by, (0.7 * F.col("_r") + 0.3 * cover).alias("resilience"))


def raw_measures(regions: DataFrame, parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Collect the measures of all regions as long rows ``by..., key, raw``; a measure a
    region lacks is NULL, not 0."""
    wide = regions.select(*by).distinct()
    for p in parts:
        wide = wide.join(p, list(by), "left")
    keys = [k for k, *_ in DIMENSIONS]
    cols = [F.col(k).cast("double").alias(k) if k in wide.columns
            else F.lit(None).cast("double").alias(k) for k in keys]
    return wide.select(*by, *cols).unpivot(list(by), keys, "key", "raw")


# --------------------------------------------------------------------- scorecard
def score_dimensions(raw: DataFrame, dims: DataFrame, benchmarks: DataFrame | None = None,
                     by: Sequence[str] = ("region",)) -> DataFrame:
    """Scored rows per region and dimension with benchmark score and gap."""
    df = raw.join(F.broadcast(dims), "key")  # ten rows
    if benchmarks is not None:
        df = df.join(F.broadcast(benchmarks), [*by, "key"], "left")
    else:
        df = df.withColumn("benchmark_raw", F.lit(None).cast("double"))
    score = half_even(normalise(F.col("raw"), F.col("floor"), F.col("target")), 1)
    bench = half_even(normalise(F.col("benchmark_raw"), F.col("floor"), F.col("target")), 1)
    return df.withColumns({"score": score, "benchmark_score": bench}).select(
        *by, "key", "position", "label", "unit", "weight",
        half_even("raw", 3).alias("raw"), "score", F.col("score").isNotNull().alias("measurable"),
        "benchmark_raw", "benchmark_score",
        half_even(F.col("benchmark_score") - F.col("score"), 1).alias("gap"))


def overall(scored: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    """Weighted score over the measurable dimensions, and the benchmark over those that
    both sides have."""
    w, s, b = F.col("weight"), F.col("score"), F.col("benchmark_score")
    both = s.isNotNull() & b.isNotNull()
    a = scored.groupBy(*by).agg(
        F.sum(F.when(s.isNotNull(), s * w)).alias("_s"),
        F.sum(F.when(s.isNotNull(), w)).alias("_w"),
        F.sum(F.when(both, b * w)).alias("_b"), F.sum(F.when(both, w)).alias("_bw"),
        F.count("score").alias("dimensions_measured"),
        F.count(F.lit(1)).alias("dimensions_total"))
    own, bench = ratio("_s", "_w"), ratio("_b", "_bw")
    return a.select(*by, half_even(own, 1).alias("overall_score"), "dimensions_measured",
                    "dimensions_total", half_even(bench, 1).alias("benchmark_score"),
                    half_even(bench - F.coalesce(own, F.lit(0.0)), 1).alias("benchmark_gap"))


def contributions(scored: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    """Points each measurable dimension adds to the overall score (0 when unmeasured)."""
    total = scored.groupBy(*by).agg(
        F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))).alias("_w"))
    return scored.join(total, list(by)).withColumn("contribution", F.coalesce(
        half_even(F.col("score") * F.col("weight") / F.col("_w"), 2), F.lit(0.0))).drop("_w")


# ---------------------------------------------------------------------- packages
def remedies(spark: SparkSession) -> DataFrame:
    """What can raise a dimension: facilities with their dependencies, or a road corridor.
    A fixed table of ten rows."""
    rows = []
    for key, kinds in REMEDIES.items():
        for pos, kind in enumerate(kinds):
            rate, qty = FACILITY_COST[kind]
            deps = DEPENDENCIES.get(kind, ())
            dep_costs = [UNIT_RATES[r] * ACCESS_ROAD_M for _, _, r in deps]
            rows.append((key, pos, "facility", kind, FACILITY_LABEL[kind],
                         UNIT_RATES[rate] * qty, FACILITY_STEP,
                         [d[0] for d in deps],
                         [d[1].replace("{label}", FACILITY_LABEL[kind]) for d in deps],
                         dep_costs))
    for key in ROAD_REMEDIES:
        rows.append((key, 0, "road", "corridor",
                     f"New collector road corridor ({CORRIDOR_M:.0f} m)",
                     UNIT_RATES["road_per_m_collector"] * CORRIDOR_M, CORRIDOR_STEP, [], [], []))
    return spark.createDataFrame(rows, (
        "key string, pos int, kind string, remedy string, label string, cost double, "
        "step double, dep_kinds array<string>, dep_labels array<string>, "
        "dep_costs array<double>"))


def gaps(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dimensions more than half a point short of the benchmark (or of 100), with the
    total weight of what is measurable. ``by`` may hold a variant with ``priorities``."""
    base = F.coalesce("benchmark_score", F.lit(100.0))
    gap = F.greatest(F.lit(0.0), base - F.col("score"))
    total = scored.where(F.col("score").isNotNull()).groupBy(*by).agg(
        F.sum("weight").alias("weight_total"))
    out = scored.where(F.col("score").isNotNull()).withColumn("gap_points", gap).where(
        F.col("gap_points") > MIN_GAP)
    if "priorities" in scored.columns:
        out = out.where((F.size("priorities") == 0)
                        | F.array_contains("priorities", F.col("key")))
    return out.drop("label", "unit").join(total, list(by)).withColumn(
        "urgency", F.col("gap_points") * F.col("weight"))


def packages(gap_rows: DataFrame, remedy_table: DataFrame, by: Sequence[str], *,
             target_uplift: Column | float = 10.0, budget: Column | float | None = None,
             max_actions: int = 12) -> DataFrame:
    """Chosen primary actions per region (and variant), most urgent gap first.

    Items over the remaining budget are skipped and the search goes on; it ends at the
    target uplift or the action limit. That ordered rule runs over at most a dozen
    remedies per region inside one row.
    """
    item = F.struct(
        (-F.col("urgency")).alias("o1"), F.col("position").alias("o2"), F.col("pos").alias("o3"),
        "key", "kind", "remedy", "label", "cost",
        (F.least(F.col("gap_points"), F.col("step")) * F.col("weight")
         / F.col("weight_total")).alias("uplift"), "dep_kinds", "dep_labels", "dep_costs")
    t = target_uplift if isinstance(target_uplift, Column) else F.lit(float(target_uplift))
    b = budget if isinstance(budget, Column) else F.lit(
        None if budget is None else float(budget)).cast("double")
    rows = gap_rows.join(F.broadcast(remedy_table), "key").groupBy(*by).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first(t).alias("_target"),
        F.first(b).alias("_budget"))
    picked = F.array().cast(
        "array<struct<seq:int,key:string,kind:string,remedy:string,label:string,cost:double,"
        "uplift:double,dep_kinds:array<string>,dep_labels:array<string>,dep_costs:array<double>>>")
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("uplift"),
                     F.lit(0).alias("n"), F.lit(0).alias("seq"), picked.alias("picked"))

    def step(acc, it):
        deps = F.aggregate(it["dep_costs"], F.lit(0.0), lambda a, v: a + v)
        full = acc["cost"] + it["cost"] + deps
        over = F.coalesce(full > F.col("_budget"), F.lit(False))
        done = (acc["uplift"] >= F.col("_target")) | (acc["n"] >= max_actions)
        seq = acc["seq"] + 1
        one = F.struct(seq.alias("seq"), it["key"].alias("key"), it["kind"].alias("kind"),
                       it["remedy"].alias("remedy"), it["label"].alias("label"),
                       it["cost"].alias("cost"), it["uplift"].alias("uplift"),
                       it["dep_kinds"].alias("dep_kinds"), it["dep_labels"].alias("dep_labels"),
                       it["dep_costs"].alias("dep_costs"))
        skip = F.struct(acc["cost"].alias("cost"), acc["uplift"].alias("uplift"),
                        acc["n"].alias("n"), seq.alias("seq"), acc["picked"].alias("picked"))
        take = F.struct(full.alias("cost"), (acc["uplift"] + it["uplift"]).alias("uplift"),
                        (acc["n"] + 1 + F.size(it["dep_costs"])).alias("n"),
                        (seq + F.size(it["dep_costs"])).alias("seq"),
                        F.concat(acc["picked"], F.array(one)).alias("picked"))
        return F.when(done, acc).when(over, skip).otherwise(take)
    return rows.withColumn("acc", F.aggregate("items", start, step)).select(*by, "acc")


def package_actions(chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every action as a row: primaries, then what each depends on, with priorities."""
    p = chosen.select(*by, F.posexplode("acc.picked").alias("pos", "p"))
    main = F.struct(F.col("p.seq").alias("seq"), F.col("p.kind").alias("kind"),
                    F.col("p.label").alias("label"), F.col("p.cost").alias("cost"),
                    F.col("p.uplift").alias("uplift"), F.lit(None).cast("int").alias("parent"))
    deps = F.transform(F.arrays_zip("p.dep_kinds", "p.dep_labels", "p.dep_costs"),
                       lambda z, i: F.struct(
                           (F.col("p.seq") + i + 1).alias("seq"),
                           z["dep_kinds"].alias("kind"), z["dep_labels"].alias("label"),
                           z["dep_costs"].alias("cost"), F.lit(0.0).alias("uplift"),
                           F.col("p.seq").alias("parent")))
    rows = p.select(*by, F.col("p.key").alias("dimension"), F.col("p.remedy").alias("remedy"),
                    F.explode(F.concat(F.array(main), deps)).alias("a"))

    def name(c):
        return F.when(c.isNotNull(), F.concat(F.lit("act-"), F.lpad(c.cast("string"), 2, "0")))
    return rows.select(*by, name(F.col("a.seq")).alias("action_id"), F.col("a.kind").alias("kind"),
                       F.col("a.label").alias("label"), "dimension", "remedy",
                       F.bround("a.cost").alias("cost"),
                       half_even("a.uplift", 2).alias("expected_uplift"),
                       name(F.col("a.parent")).alias("parent_id"))


def package_summary(chosen: DataFrame, by: Sequence[str],
                    overall_score: Column | None = None) -> DataFrame:
    cost, up = F.col("acc.cost"), F.col("acc.uplift")
    extra = [] if overall_score is None else [
        half_even(F.coalesce(overall_score, F.lit(0.0)) + up, 1).alias("projected_score")]
    return chosen.select(
        *by, F.col("acc.n").alias("actions"), F.size("acc.picked").alias("primary_actions"),
        F.bround(cost * (1 + CONTINGENCY_RATE)).alias("total_cost"),
        F.bround(cost).alias("base_cost"), F.bround(cost * CONTINGENCY_RATE).alias("contingency"),
        half_even(up, 2).alias("expected_uplift"), *extra)


def compare_packages(summary: DataFrame, by: Sequence[str], variant: str = "variant",
                     served: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants with cost per point of uplift, and the cheapest one per region."""
    per = F.when(F.col("expected_uplift") > 0,
                 F.bround(F.col("total_cost") / F.col("expected_uplift")))
    rows = summary.withColumn("cost_per_point", per)
    if served is not None:
        rows = rows.join(served, [*by, variant], "left")
    best = rows.groupBy(*by).agg(F.coalesce(
        F.min_by(variant, F.when(per.isNotNull(), F.struct(per, F.col(variant)))),
        F.min(variant)).alias("recommended"))
    return rows, best


def best_site(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parcel with the most people in reach per region and facility type."""
    best = candidates.groupBy(*by).agg(F.max(F.struct(
        F.col("population_served").alias("p"), (-F.col("parcel_id")).alias("o"),
        "parcel_id", "x", "y", "area", "flood_risk")).alias("b"))
    return best.select(
        *by, "b.parcel_id", F.col("b.p").alias("population_served"), "b.x", "b.y",
        F.bround("b.area").alias("area_m2"),
        F.when(F.coalesce(F.col("b.flood_risk"), F.lit(0.0)) < 0.2, "high").otherwise("medium")
        .alias("feasibility"))
