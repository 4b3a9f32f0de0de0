"""Greedy selection and assignment as rounds of DataFrame jobs over a long cost table
(demand, candidate, cost; a missing row is unreachable)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, ratio
from ..session import cut, is_empty, written
from .nearest import distance_pairs
from .scan import running_total

#: Pairs of zones and facilities that one task walks through.
BLOCK_PAIRS = 200_000
#: Side of the first blocks, as a multiple of the reach.
BLOCK_REACHES = 8


def check_costs(pairs: DataFrame, demand: DataFrame, candidates: DataFrame, p: int) -> None:
    """Reject empty or inconsistent problems before any work starts."""
    n = candidates.count()
    if n == 0:
        raise ValueError("no candidates supplied")
    if is_empty(demand):
        raise ValueError("no demand points supplied")
    if not 1 <= p <= n:
        raise ValueError(f"p must be between 1 and {n}")
    stray = pairs.join(demand.select("demand"), "demand", "left_anti")
    if not is_empty(stray):
        raise ValueError("costs name demand points that do not exist")


def first_p(candidates: DataFrame, p: int) -> DataFrame:
    """The plain fallback: the first p candidates in order."""
    return candidates.orderBy("candidate").limit(p).select("candidate")


def _top_up(chosen: list, candidates: DataFrame, p: int) -> list:
    missing = p - len(chosen)
    if missing > 0:
        rest = candidates.where(~F.col("candidate").isin(chosen)).orderBy("candidate")
        chosen += [r[0] for r in rest.limit(missing).collect()]
    return chosen


def greedy_p_median(pairs: DataFrame, demand: DataFrame, candidates: DataFrame, p: int, *,
                    max_cost: float | None = None, must_open: Sequence = (),
                    must_close: Sequence = ()) -> DataFrame:
    """Open p sites, each time the one that lowers the weighted cost most (lowest id among
    equals). Demand nobody serves yet costs more than any known pair."""
    usable = pairs if max_cost is None else pairs.where(F.col("cost") <= max_cost)
    if must_close:
        usable = usable.where(~F.col("candidate").isin(list(must_close)))
        candidates = candidates.where(~F.col("candidate").isin(list(must_close)))
    usable = cut(usable.join(demand, "demand"))
    # Unserved demand weighs as a trip twice the longest one, so coverage comes first.
    unserved = float(usable.agg(F.coalesce(F.max("cost"), F.lit(0.0))).head()[0]) * 2 + 1.0
    best = cut(demand.select("demand").withColumn("best", F.lit(unserved)))
    chosen: list = []
    queue = [c for c in must_open if c not in set(must_close)]
    while len(chosen) < p:
        if queue:
            pick = queue.pop(0)
        else:
            gain = F.col("weight") * F.greatest(F.lit(0.0), F.col("best") - F.col("cost"))
            open_ = usable.where(~F.col("candidate").isin(chosen)) if chosen else usable
            top = open_.join(best, "demand").groupBy("candidate").agg(F.sum(gain).alias("g"))
            row = top.where("g > 0").orderBy(F.col("g").desc(), "candidate").head()
            if row is None:
                break
            pick = row[0]
        chosen.append(pick)
        mine = usable.where(F.col("candidate") == F.lit(pick)).select("demand", "cost")
        best = cut(best.join(mine, "demand", "left").select(
            "demand", F.least("best", "cost").alias("best")))
    chosen = _top_up(chosen, candidates, p)
    return candidates.where(F.col("candidate").isin(chosen)).select("candidate")


def greedy_max_coverage(pairs: DataFrame, demand: DataFrame, candidates: DataFrame, p: int,
                        max_cost: float) -> DataFrame:
    """Open p sites, each time the one that reaches most uncovered demand."""
    left = cut(pairs.where(F.col("cost") <= max_cost).select("demand", "candidate")
               .join(demand, "demand"))
    chosen: list = []
    while len(chosen) < p:
        row = left.groupBy("candidate").agg(F.sum("weight").alias("g")).where("g > 0").orderBy(
            F.col("g").desc(), "candidate").head()
        if row is None:
            break
        chosen.append(row[0])
        done = left.where(F.col("candidate") == F.lit(row[0])).select("demand")
        left = cut(left.join(done, "demand", "left_anti"))
    chosen = _top_up(chosen, candidates, p)
    return candidates.where(F.col("candidate").isin(chosen)).select("candidate")


def assign_nearest(pairs: DataFrame, demand: DataFrame, opened: DataFrame) -> DataFrame:
    """Each demand point at its cheapest open site (lowest id among equals)."""
    best = pairs.join(opened, "candidate", "left_semi").groupBy("demand").agg(
        F.min(F.struct("cost", "candidate")).alias("b"))
    return demand.join(best, "demand").select(
        "demand", F.col("b.candidate").alias("facility"), F.col("b.cost").alias("cost"), "weight")


def assignment_metrics(assigned: DataFrame, demand: DataFrame) -> DataFrame:
    total = demand.agg(F.sum("weight")).scalar()
    a = assigned.agg(F.sum(F.col("cost") * F.col("weight")).alias("_c"),
                     F.sum("weight").alias("_w"))
    return a.select(
        half_even(F.coalesce("_c", F.lit(0.0)), 2).alias("objective_weighted_cost"),
        half_even(ratio("_c", "_w"), 2).alias("mean_cost_per_demand_unit"),
        half_even(F.coalesce("_w", F.lit(0.0)), 2).alias("demand_served"),
        half_even(total, 2).alias("demand_total"),
        half_even(F.coalesce(ratio("_w", total), F.lit(0.0)), 4).alias("demand_coverage"))


def coverage_metrics(pairs: DataFrame, demand: DataFrame, opened: DataFrame,
                     max_cost: float) -> DataFrame:
    hit = pairs.where(F.col("cost") <= max_cost).join(opened, "candidate", "left_semi").select(
        "demand").distinct()
    total = demand.agg(F.sum("weight")).scalar()
    got = demand.join(hit, "demand", "left_semi").agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_c"))
    return got.select(half_even("_c", 2).alias("demand_covered"),
                      half_even(total, 2).alias("demand_total"),
                      half_even(F.coalesce(ratio("_c", total), F.lit(0.0)), 4)
                      .alias("coverage_ratio"))


# ------------------------------------------------------------------------ budget
def allocate_budget(items: DataFrame, budget: float, order: Sequence[Column], *,
                    key: str = "id", cost: str = "cost") -> DataFrame:
    """Take items in order while they fit; one that does not fit is skipped and later,
    cheaper ones may still be taken.

    The budget only shrinks, so an item above what is left can be dropped for good. Each
    round takes the longest fitting prefix of what remains, by running totals.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    left, taken = items, None
    rest = float(budget)
    while True:
        left = cut(left.where(F.col(cost) <= rest))
        if is_empty(left):
            break
        summed = cut(running_total(left.withColumn("_all", F.lit(0)), ["_all"], order,
                                   F.col(cost), "_sum").drop("_all"))
        fits = F.col("_sum") <= rest
        # Costs are positive, so the fitting rows are a prefix.
        part = summed.where(fits)
        taken = part.select(key) if taken is None else taken.unionByName(part.select(key))
        rest -= float(part.agg(F.max("_sum")).head()[0])
        left = summed.where(~fits).drop("_sum")
    flag = F.lit(1).alias("units_allocated")
    got = items.limit(0).select(key, flag) if taken is None else taken.select(key, flag)
    return items.join(got, key, "left").withColumn(
        "units_allocated", F.coalesce("units_allocated", F.lit(0)))


def allocation_metrics(allocated: DataFrame, budget: float, cost: str = "cost",
                       benefit: str = "benefit") -> DataFrame:
    u = F.col("units_allocated")
    a = allocated.agg(F.sum(u * F.col(cost)).alias("s"), F.sum(u * F.col(benefit)).alias("b"),
                      F.sum(u).alias("n"))
    return a.select(F.lit(float(budget)).alias("budget"), half_even("s", 2).alias("budget_spent"),
                    half_even(budget - F.col("s"), 2).alias("budget_remaining"),
                    half_even("b", 2).alias("total_benefit"),
                    F.col("n").cast("long").alias("units_allocated"))


# ---------------------------------------------------------- capacity-aware assignment
def assign_with_capacity(pairs: DataFrame, zones: DataFrame, facilities: DataFrame,
                         respect_capacity: bool = True) -> DataFrame:
    """Greedy over all (cost, zone, facility) ascending: a zone goes whole to the first
    facility that still has room for it.

    ``pairs``: zone, facility, cost; ``zones``: zone, population; ``facilities``: facility,
    capacity (NULL or 0 = unlimited). Room only shrinks, so a pair that does not fit now
    never will. A round walks through blocks of facilities, each in the order of costs, and
    settles what no pair of another block can change. The globally cheapest pair is always
    settled, so each round makes progress. Facilities may have a place (rx, ry): those that lie together
    are then walked through together, which saves rounds and changes no result.
    """
    todo = cut(pairs.join(zones.select("zone", F.coalesce("population", F.lit(0.0)).alias("pop")), "zone"))
    placed = ("rx", "ry") if {"rx", "ry"} <= set(facilities.columns) else ()
    fac = cut(_rooms(facilities, respect_capacity, *placed))
    return _renamed(_settle(todo, fac, _side(todo, fac) if placed else 0.0)[0])


def _side(todo: DataFrame, fac: DataFrame) -> float:
    """Side of squares that hold an eighth of ``BLOCK_PAIRS`` at an even density."""
    wide, high = (float(v or 0.0) for v in fac.agg(F.max("rx") - F.min("rx"), F.max("ry") - F.min("ry")).head())
    share = BLOCK_PAIRS / 8 / max(todo.count(), 1)
    return max(math.sqrt(wide * high * share), max(wide, high) * share, 1.0)


def _rooms(facilities: DataFrame, respect_capacity: bool, *keep: str) -> DataFrame:
    room = F.when(F.lit(respect_capacity) & (F.coalesce("capacity", F.lit(0.0)) > 0),
                  F.col("capacity")).otherwise(F.lit(float("inf")))
    return facilities.select("facility", *keep, room.cast("double").alias("room"))


def _renamed(done: DataFrame) -> DataFrame:
    return done.select("zone", "facility", F.col("cost").alias("travel_time_seconds"),
                       F.col("pop").alias("population"))


def _settle(todo: DataFrame, fac: DataFrame, side: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Assigned zones (zone, facility, cost, pop), and the facilities with the room left. Facilities with a place
    (rx, ry) meet in squares, at first of ``side``."""
    extra = [c for c in fac.columns if c not in ("facility", "room")]
    todo = cut(todo.select("zone", "facility", "cost", "pop"))
    done: DataFrame | None = None
    rounds = 0
    while True:
        valid = cut(todo.join(fac, "facility").where(F.col("pop") <= F.col("room")))
        if is_empty(valid):
            break
        blocks = _blocks(valid, side, rounds) if "rx" in extra else fac.select("facility", F.col("facility").alias("block"))
        valid = valid.select("zone", "facility", "cost", "pop", "room")
        dealt = cut(valid.join(blocks, "facility"))
        # The cheapest pair of a zone in any other block.
        low = dealt.groupBy("zone", "block").agg(F.min(F.struct("cost", "facility")).alias("low"))
        every = Window.partitionBy("zone").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low = low.withColumn("least", F.first("low").over(every)).withColumn("second", F.nth_value("low", 2).over(every))
        out = low.select("zone", "block", F.when(F.col("low") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("out"))
        dealt = dealt.join(out, ["zone", "block"]).select(
            "block", "zone", "facility", "cost", "pop", "room", F.col("out.cost").alias("out_cost"), F.col("out.facility").alias("out_facility"))
        accepted = cut(dealt.groupBy("block").applyInArrow(_walk, dealt.select("zone", "facility", "cost", "pop").schema))
        done = accepted if done is None else done.unionByName(accepted)
        used = accepted.groupBy("facility").agg(F.sum("pop").alias("_u"))
        # Written: the layout that checkpoints of joined tables remember doubles with every round.
        fac = written(fac.join(used, "facility", "left").select(
            "facility", *extra, (F.col("room") - F.coalesce("_u", F.lit(0.0))).alias("room")))
        todo = written(valid.select("zone", "facility", "cost", "pop").join(
            accepted.select("zone"), "zone", "left_anti"))
        rounds += 1
    return (done if done is not None else todo.limit(0)), fac


def _blocks(valid: DataFrame, side: float, rounds: int) -> DataFrame:
    """``facility, block``: squares that double every round and are moved by half every other one. A square of more than
    ``BLOCK_PAIRS`` pairs falls back to those of the first round, and these to single facilities."""
    move = 0.5 * (rounds % 2)

    def square(size: float):
        return F.concat_ws(" ", *[F.floor(F.col(c) / size + move).cast("string") for c in ("rx", "ry")])
    per = valid.groupBy("facility").agg(F.count(F.lit(1)).alias("n"), F.first("rx").alias("rx"), F.first("ry").alias("ry"))
    per = per.select("facility", "n", square(side).alias("fine"), square(side * 2 ** rounds).alias("wide"))
    for name in ("fine", "wide"):
        per = per.join(per.groupBy(name).agg(F.sum("n").alias("n_" + name)), name)
    return per.select("facility", F.when(F.col("n_wide") <= BLOCK_PAIRS, F.concat(F.lit("w "), "wide")).when(
        F.col("n_fine") <= BLOCK_PAIRS, F.concat(F.lit("f "), "fine")).otherwise(
        F.concat(F.lit("s "), F.col("facility").cast("string"))).alias("block"))


def _walk(pairs: pa.Table) -> pa.Table:
    """The pairs of a block that are surely taken. A zone is unsure from its first cheaper pair elsewhere, and after a pair
    that may or may not be taken; a facility has at most ``room``, and at least ``sure`` of it."""
    rows = pairs.sort_by([(c, "ascending") for c in ("cost", "zone", "facility")])
    taken, unsure, room, sure, keep = set(), set(), {}, {}, []
    columns = ("zone", "facility", "cost", "pop", "room", "out_cost", "out_facility")
    for i, (z, f, cost, pop, start, out, other) in enumerate(zip(*[rows.column(c).to_pylist() for c in columns], strict=True)):
        if z in taken or pop > room.setdefault(f, start):
            continue
        sure.setdefault(f, start)
        if z not in unsure and (out is None or (cost, f) < (out, other)) and pop <= sure[f]:
            taken.add(z)
            keep.append(i)
            room[f] -= pop
        else:
            unsure.add(z)
        sure[f] -= pop
    return rows.select(["zone", "facility", "cost", "pop"]).take(pa.array(keep, pa.int64()))


def assign_widening(zones: DataFrame, facilities: DataFrame, first_reach: float,
                    respect_capacity: bool = True) -> DataFrame:
    """:func:`assign_with_capacity` by straight distance, without a reach.

    ``zones``: zone, x, y, population; ``facilities``: facility, rx, ry, capacity. The greedy
    order takes cheaper pairs first, so pairs are made band by band: up to ``first_reach``, then
    each time up to twice as far (eight times after an empty band), only between zones still open and facilities with room for
    them. The result is that of all pairs at once. It ends when no open zone fits anywhere, or
    the last band has spanned both layers; a zone without a position is never assigned.
    """
    open_ = cut(zones.where("x IS NOT NULL AND y IS NOT NULL").select(
        "zone", "x", "y", F.coalesce("population", F.lit(0.0)).alias("pop")))
    fac = cut(_rooms(facilities, respect_capacity, "rx", "ry"))
    ends = open_.select("x", "y").union(fac.select("rx", "ry")).agg(
        F.max("x") - F.min("x"), F.max("y") - F.min("y")).head()
    span = 0.0 if ends[0] is None else math.hypot(*ends) * (1 + 1e-9)
    done, low, high = None, -1.0, float(first_reach)
    while True:
        least, most = open_.agg(F.min("pop")).head()[0], fac.agg(F.max("room")).head()[0]
        # Zones that fit nowhere and facilities without room for any zone would meet all the others in wide bands.
        pairs = distance_pairs(open_.where(F.col("pop") <= F.lit(most)), fac.where(F.col("room") >= F.lit(least)), high).where(
            (F.col("cost") > low) & (F.col("pop") <= F.col("room")))
        got, fac = _settle(pairs, fac, BLOCK_REACHES * high)
        done = got if done is None else done.unionByName(got)
        open_ = cut(open_.join(got.select("zone"), "zone", "left_anti"))
        most = fac.agg(F.max("room")).head()[0]
        if high >= span or most is None or is_empty(open_.where(F.col("pop") <= most)):
            return _renamed(done)
        low, high = high, high * (8 if is_empty(got) else 2)


def facility_loads(assigned: DataFrame, facilities: DataFrame) -> DataFrame:
    load = assigned.groupBy("facility").agg(F.sum("population").alias("_l"))
    cap = F.when(F.col("capacity") != 0, F.col("capacity"))
    return facilities.join(load, "facility", "left").select(
        "facility", half_even(F.coalesce("_l", F.lit(0.0)), 1).alias("assigned_population"),
        cap.alias("capacity"),
        half_even(F.coalesce("_l", F.lit(0.0)) / cap, 4).alias("utilization"))
