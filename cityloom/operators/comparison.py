"""Comparing runs and plans over long metric tables (run, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (COMPARISON, CONTINGENCY_RATE, ESCALATION_RATE, METRIC_LABELS,
                            UNIT_RATES)
from ..functions.scalars import half_even, lookup, title_label
from .scan import global_rank, top_rank


def latest_metrics(metrics: DataFrame, by: Sequence[str], order: str = "seq") -> DataFrame:
    """One value per run and metric: the last non-NULL one."""
    return metrics.where(F.col("value").isNotNull()).groupBy(*by, "metric").agg(
        F.max_by("value", order).alias("value"))


def compare_plans(metrics: DataFrame, profile: dict[str, tuple[float, str]] | None = None, *,
                  plan: str = "scenario_id", version: str | None = "dataset_version",
                  strict: bool = True) -> DataFrame:
    """Weighted, min-max normalised score per plan.

    A metric a plan lacks is a gap: it is listed, never counted as zero, and the score is
    rescaled by the weight that is there. Plans of different dataset versions are not
    comparable (no rows when ``strict``), nor is a single plan.
    """
    profile = profile or COMPARISON
    values = latest_metrics(metrics, [plan]).where(F.col("metric").isin(list(profile)))
    ranges = values.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    weights = {m: abs(w) for m, (w, _) in profile.items()}
    senses = {m: s for m, (_, s) in profile.items()}
    # At most one row per profile metric.
    ranges = ranges.withColumn("w", lookup(weights, F.col("metric")))
    total = ranges.agg(F.sum("w")).scalar()
    present = ranges.agg(F.sort_array(F.collect_set("metric"))).scalar()
    scored = values.join(F.broadcast(ranges), "metric")
    n = F.when(F.col("hi") == F.col("lo"), F.lit(0.5)).otherwise(
        (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    n = F.when(lookup(senses, F.col("metric")) == "min", 1.0 - n).otherwise(n)
    scored = scored.withColumns({"n": n, "w": F.col("w") / total})
    rows = scored.groupBy(plan).agg(
        F.sum(F.col("n") * F.col("w")).alias("_s"), F.sum("w").alias("_w"),
        F.collect_set("metric").alias("_have"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct(
            half_even("value", 4).alias("raw"), half_even("n", 6).alias("normalized"),
            half_even("w", 6).alias("weight"),
            half_even(F.col("n") * F.col("w"), 6).alias("contribution")))))).alias("metrics"))
    plans = metrics.select(plan).distinct().join(rows, plan, "left")
    out = plans.select(
        plan, half_even(F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")), 6)
        .alias("overall_score"),
        half_even(F.coalesce("_w", F.lit(0.0)), 4).alias("weight_coverage"), "metrics",
        F.array_except(present, F.coalesce("_have", F.array().cast("array<string>")))
        .alias("missing_metrics"))
    gate = metrics.agg(F.countDistinct(plan) >= 2).scalar()
    out = out.where(gate)
    if strict and version:
        out = out.where(metrics.agg(F.countDistinct(version) <= 1).scalar())
    return out


def rank_plans(compared: DataFrame, plan: str = "scenario_id",
               top_n: int | None = None) -> DataFrame:
    """Best first; plans without a score come last, ties by id."""
    order = [F.coalesce("overall_score", F.lit(-1.0)).desc(), F.col(plan)]
    return top_rank(compared, order, top_n) if top_n else global_rank(compared, order)


def with_names(ranked: DataFrame, headers: DataFrame, plan: str = "scenario_id") -> DataFrame:
    return ranked.join(headers.select(F.col("id").alias(plan), F.col("name").alias(
        "scenario_name")), plan, "left")


def run_deltas(metrics: DataFrame, before: str, after: str, *, by: Sequence[str] = (),
               run: str = "run", digits: int = 4, pct_digits: int = 2,
               zero_pct: float | None = None) -> DataFrame:
    """before, after, delta and percent change per metric that both runs have.

    With a zero base the percentage is ``zero_pct`` (NULL leaves it out).
    """
    wide = metrics.where(F.col(run).isin(before, after)).groupBy(*by, "metric").agg(
        F.max(F.when(F.col(run) == before, F.col("value"))).alias("b"),
        F.max(F.when(F.col(run) == after, F.col("value"))).alias("a"))
    both = wide.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = F.col("a") - F.col("b")
    pct = F.when(F.col("b") != 0, half_even(d / F.abs("b") * 100.0, pct_digits)).otherwise(
        F.lit(zero_pct).cast("double"))
    return both.select(*by, "metric", half_even("b", digits).alias("before"),
                       half_even("a", digits).alias("after"), half_even(d, digits).alias("delta"),
                       pct.alias("pct_change"), (d < 0).alias("improved"))


# -------------------------------------------------------------------------- cost
def price(quantities: DataFrame, rates: DataFrame | None = None,
          by: Sequence[str] = ()) -> DataFrame:
    """Quantity rows with unit rate and amount; items without a rate stay, unpriced."""
    if rates is None:
        rate: Column = lookup(UNIT_RATES, F.col("item"))
        out = quantities.withColumn("unit_rate", rate)
    else:
        out = quantities.join(rates.select("item", F.col("rate").alias("unit_rate")), "item",
                              "left")
    amount = F.col("quantity") * F.col("unit_rate")
    return out.withColumn("_amount", amount).select(
        *by, "item", F.when(F.col("unit_rate").isNotNull(), half_even("quantity", 3))
        .otherwise(F.col("quantity")).alias("quantity"), "unit_rate",
        half_even("_amount", 2).alias("amount"),
        F.col("unit_rate").isNotNull().alias("priced"), "_amount")


def cost_totals(priced: DataFrame, by: Sequence[str] = (),
                contingency: float = CONTINGENCY_RATE,
                escalation: float = ESCALATION_RATE) -> DataFrame:
    sums = priced.groupBy(*by).agg(F.coalesce(F.sum("_amount"), F.lit(0.0)).alias("s"),
                                   F.count_if("priced").alias("line_items_priced"))
    c = F.col("s") * contingency
    e = (F.col("s") + c) * escalation
    return sums.select(*by, half_even("s", 2).alias("subtotal"),
                       half_even(c, 2).alias("contingency"), half_even(e, 2).alias("escalation"),
                       half_even(F.col("s") + c + e, 2).alias("total_cost"), "line_items_priced")


# ------------------------------------------------------------------------ labels
def label_metrics(metrics: DataFrame) -> DataFrame:
    """Display label, unit and better direction of each metric row."""
    labels = {k: v[0] for k, v in METRIC_LABELS.items()}
    units = {k: v[1] for k, v in METRIC_LABELS.items() if v[1]}
    better = {k: v[2] for k, v in METRIC_LABELS.items() if v[2]}
    m = F.col("metric")
    return metrics.withColumns({
        "label": title_label(m, labels),
        "unit": F.coalesce(F.col("unit"), lookup(units, m)) if "unit" in metrics.columns
        else lookup(units, m),
        "better": lookup(better, m)})
