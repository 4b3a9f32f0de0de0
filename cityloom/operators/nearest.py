"""Nearest neighbours over a pyramid of counts.

Places are counted on grids whose cells double in size from level to level. A seeker starts at
the finest level where its own cell holds k places, so all k lie within ``sqrt(2)`` cells; counts
of neighbours would be nine times the rows. It then takes the counted cells that this circle
touches, and the k-th smallest upper distance of their counts narrows the circle. Only where more
than ``CROWD`` places would still be compared, as between a far seeker and a dense centre, the
cells are replaced by the counted ones two levels below. What is left is compared place by place.
At an even density nothing goes down, however large the extent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point_distance
from ..session import cut
from .gridjoin import box_pairs
from .scan import top_per_group

# Places, beyond 16 for each wanted neighbour, that a seeker may be compared with before its cells are split.
CROWD = 256
# Levels that crowded cells go down at once.
STEP = 2
# The coarsest levels have few cells, which many seekers share: their joins are salted.
COARSE, SALTS = 6, 16
_CELL = ["_lv", "_cx", "_cy"]
# Keeps ties and rounded bounds inside a circle.
_SLACK = 1.0 + 1e-9


def _thin(right: DataFrame, xy: Sequence[str], id_col: str, on: Sequence[str],
          k: int) -> DataFrame:
    """Of the right rows on one spot only the k lowest ids can ever be chosen."""
    if k == 1:
        return right.groupBy(*on, *xy).agg(F.min(id_col).alias(id_col))
    return top_per_group(right.select(*on, *xy, id_col), [*on, *xy], [F.col(id_col)], k,
                         "_same").drop("_same")


def k_nearest(left: DataFrame, right: DataFrame, k: int, *, left_id: str, right_id: str,
              left_xy: Sequence[str] = ("x", "y"), right_xy: Sequence[str] = ("rx", "ry"),
              on: Sequence[str] = (), max_distance: float | None = None) -> DataFrame:
    """Up to ``k`` nearest right points per left point: ``left_id, right_id, distance,
    rank`` (ties by right id). Lefts with a NULL coordinate, or without a right point in
    reach, have no row."""
    seekers = left.select(*on, left_id, *left_xy)
    probe = seekers.dropDuplicates([*on, *left_xy]).drop(left_id)
    places = cut(_thin(right, right_xy, right_id, on, k))
    box_l, box_r = _spans(probe, left_xy, places, right_xy)
    if box_l is None or box_r is None:
        return seekers.limit(0).select(*on, left_id, F.lit(None).cast(
            dict(right.dtypes)[right_id]).alias(right_id), F.lit(0.0).alias("distance"),
            F.lit(0).alias("rank"))
    base, top = _levels(places, right_xy, on, k, box_l, box_r)
    spot = [*on, *left_xy]
    limit = float("inf") if max_distance is None else float(max_distance)
    places = places.withColumns(_base_cell(right_xy, base))
    leaves, levels = search_cells(probe, places, left_xy, on, k, base, top, limit)
    distance = point_distance(left_xy[0], left_xy[1], right_xy[0], right_xy[1])
    near = (leaves.select(*spot, "_r", *_CELL)
            .join(_at_levels(places, levels), [*on, *_CELL])
            .withColumn("distance", distance)
            .where((F.col("distance") <= F.col("_r") * _SLACK) & (F.col("distance") <= limit))
            .select(*spot, right_id, "distance"))
    if k == 1:
        best = near.groupBy(*spot).agg(F.min(F.struct("distance", right_id)).alias("_b"))
        near = best.select(*spot, f"_b.{right_id}", "_b.distance", F.lit(1).alias("rank"))
    else:
        near = top_per_group(near, spot, [F.col("distance"), F.col(right_id)], k)
    return seekers.join(near, spot).select(*on, left_id, right_id, "distance", "rank")


def search_cells(probe: DataFrame, places: DataFrame, left_xy: Sequence[str], on: Sequence[str],
                 k: int, base: float, top: int, limit: float) -> tuple[DataFrame, list[int]]:
    """The cells whose places are compared with each seeker (with their count ``_n`` and the
    circle ``_r``), and the levels they lie on."""
    spot = [*on, *left_xy]
    counts = cut(_at_levels(places.select(*on, "_bx", "_by"), range(top + STEP + 1))
                 .groupBy(*on, *_CELL).agg(F.count(F.lit(1)).alias("_n")))
    front = cut(_narrow(_start(probe, counts, left_xy, on, spot, k, base, top, limit),
                        left_xy, spot, k, base))
    leaves, levels = front.where("NOT _crowded"), set()
    while True:
        seen = front.groupBy("_crowded", "_lv").count().collect()  # at most two rows a level
        levels |= {r["_lv"] for r in seen if not r["_crowded"]}
        if not any(r["_crowded"] for r in seen):
            return leaves, sorted(levels)
        front = cut(_narrow(_below(front.where("_crowded"), counts, on, spot, top),
                            left_xy, spot, k, base))
        leaves = leaves.unionByName(front.where("NOT _crowded"))


def _levels(places: DataFrame, xy, on: Sequence[str], k: int, box_l, box_r) -> tuple[float, int]:
    """Size of the finest cells, and the level whose cells are as wide as everything. The
    finest cells are fitted to the densest spot: a job for each guess, as a rule one or two."""
    extent = max(max(box_l[2], box_r[2]) - min(box_l[0], box_r[0]),
                 max(box_l[3], box_r[3]) - min(box_l[1], box_r[1]))
    top = _exponent(max(extent, 1e-3))
    wide, high, n = box_r[2] - box_r[0], box_r[3] - box_r[1], max(box_r[4], 1)
    spacing = max((wide * high * k / n) ** 0.5, max(wide, high) * k / n, 1e-6)
    finest = min(top, _exponent(spacing) - 2)
    while finest > top - 40:
        full = places.groupBy(*on, *[F.floor(F.col(c) / 2.0 ** finest) for c in xy]).count().agg(
            F.max("count")).head()[0]
        if full <= 4 * k + 4:
            break
        finest = max(finest - math.ceil(math.log(full / (2.0 * k), 4)), top - 40)
    return 2.0 ** finest, top - finest


def _exponent(value: float) -> int:
    return math.ceil(math.log2(value))


def _base_cell(xy, base: float) -> dict[str, Column]:
    return {n: F.floor(F.col(c) / base).cast("long") for n, c in zip(("_bx", "_by"), xy)}


def _at_levels(df: DataFrame, levels) -> DataFrame:
    """A row for each of the levels, with the cell there."""
    lv = F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))
    return df.withColumn("_lv", lv).withColumns({
        "_cx": F.expr("shiftright(_bx, _lv)"), "_cy": F.expr("shiftright(_by, _lv)")}).drop("_bx", "_by")


def _meet(rows: DataFrame, cells: DataFrame, on: Sequence[str], spot: Sequence[str], top: int,
          how: str = "inner") -> DataFrame:
    """Join rows of seekers with cells; the few coarse cells are copied for each salt."""
    coarse = F.col("_lv") > top - COARSE
    draw = F.pmod(F.xxhash64(*spot), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("_salt", F.when(coarse, draw).otherwise(0))
    cells = cells.withColumn("_salt", F.explode(F.when(
        coarse, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(cells, [*on, *_CELL, "_salt"], how).drop("_salt")


def _start(probe: DataFrame, counts: DataFrame, xy, on, spot, k: int, base: float, top: int,
           limit: float) -> DataFrame:
    """The counted cells that the first circle of a seeker touches. A cell that holds k places has a
    parent that does too, so the finest one is a minimum over the levels. At the last level the circle
    spans everything, or the limit."""
    last = top
    if limit < 2.0 ** top * base:
        last = min(top, max(0, _exponent(max(limit, 1e-9) / (math.sqrt(2.0) * base))))
    good = counts.where((F.col("_lv") < last) & (F.col("_n") >= k))
    chain = _at_levels(probe.withColumns(_base_cell(xy, base)), range(last + 1))
    level = F.min(F.when(F.col("_n").isNotNull() | (F.col("_lv") == last), F.col("_lv")))
    first = _meet(chain, good, on, spot, top, "left").groupBy(*spot).agg(level.alias("_lv"))
    radius = F.least(F.pow(F.lit(2.0), F.col("_lv")) * (math.sqrt(2.0) * base * _SLACK),
                     F.lit(limit))
    first = first.withColumns({"_r": radius, "_lv": F.col("_lv") + STEP})
    size = F.pow(F.lit(2.0), F.col("_lv")) * base
    for name, c in zip(("_cx", "_cy"), xy):
        first = first.withColumn(name, F.explode(F.sequence(
            F.floor((F.col(c) - F.col("_r")) / size), F.floor((F.col(c) + F.col("_r")) / size))))
    return _meet(first, counts, on, spot, top)


def _below(front: DataFrame, counts: DataFrame, on, spot, top: int) -> DataFrame:
    """The counted cells up to ``STEP`` levels below."""
    parts = front.select(*spot, "_r", *_CELL).withColumn("_down", F.least("_lv", F.lit(STEP)))
    for name in ("_cx", "_cy"):
        parts = parts.withColumn(name, F.explode(F.expr(
            f"sequence(shiftleft({name}, _down), shiftleft({name} + 1, _down) - 1)")))
    parts = parts.withColumn("_lv", F.col("_lv") - F.col("_down")).drop("_down")
    return _meet(parts, counts, on, spot, top)


def _narrow(cells: DataFrame, xy, spot, k: int, base: float) -> DataFrame:
    """Drop cells out of the circle, after narrowing it to where the nearest k surely lie."""
    size = f"(pow(2d, _lv) * {base!r}d)"
    x, y = (f"`{c}`" for c in xy)
    near = [f"greatest({n} * {size} - {c}, {c} - ({n} + 1) * {size}, 0d)" for c, n in ((x, "_cx"), (y, "_cy"))]
    far = [f"greatest({c} - {n} * {size}, ({n} + 1) * {size} - {c})" for c, n in ((x, "_cx"), (y, "_cy"))]
    each = "PARTITION BY " + ", ".join(f"`{c}`" for c in spot)
    kept = [*[f"`{c}`" for c in spot], "_lv", "_cx", "_cy", "_n"]
    cells = cells.selectExpr(*kept, "_r", f"hypot({near[0]}, {near[1]}) AS _min", f"hypot({far[0]}, {far[1]}) AS _max")
    cells = cells.where(f"_min <= _r * {_SLACK!r}d").selectExpr(
        "*", f"sum(_n) OVER ({each} ORDER BY _max, _lv, _cx, _cy ROWS UNBOUNDED PRECEDING) AS _sum")
    sure = f"min(CASE WHEN _sum >= {k} THEN _max END) OVER ({each}) * {_SLACK!r}d"
    cells = cells.selectExpr(*kept, "_min", f"least(_r, {sure}) AS _r").where(f"_min <= _r * {_SLACK!r}d")
    crowd = f"_lv > 0 AND sum(_n) OVER ({each}) > {CROWD + 16 * k}"
    return cells.selectExpr(*kept, "_r", f"{crowd} AS _crowded")


def _spans(left: DataFrame, left_xy, right: DataFrame, right_xy) -> list:
    """Bounds and row count of both sides, in one job; None for an empty side."""
    parts = [df.agg(F.lit(i).alias("s"), F.min(xy[0]), F.min(xy[1]), F.max(xy[0]),
                    F.max(xy[1]), F.count(F.lit(1)))
             for i, (df, xy) in enumerate(((left, left_xy), (right, right_xy)))]
    rows = {r[0]: tuple(r)[1:] for r in parts[0].union(parts[1]).collect()}
    return [None if rows[i][0] is None else rows[i] for i in (0, 1)]


def nearest(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    return k_nearest(left, right, 1, **kw).drop("rank")


def min_distance(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
                 name: str = "distance", **kw) -> DataFrame:
    """All left rows with the distance to the closest right one (NULL without any)."""
    near = nearest(left, right, left_id=left_id, right_id=right_id, **kw)
    on = list(kw.get("on", ()))
    return left.join(near.select(*on, left_id, F.col("distance").alias(name)),
                     [*on, left_id], "left")


def distance_pairs(left: DataFrame, right: DataFrame, max_distance: float, *,
                   left_xy: Sequence[str] = ("x", "y"),
                   right_xy: Sequence[str] = ("rx", "ry"), on: Sequence[str] = (),
                   name: str = "cost", distance: Column | None = None) -> DataFrame:
    """Long distance matrix: one row per pair within ``max_distance``. A missing row is a
    pair out of reach, as NULL is in a dense matrix."""
    d = distance if distance is not None else point_distance(*left_xy, *right_xy)
    return box_pairs(left, right, (*left_xy, *left_xy), (*right_xy, *right_xy),
                     margin=max_distance, condition=d <= max_distance,
                     on=on).withColumn(name, d)
