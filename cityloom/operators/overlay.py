"""Spatial predicates, joins and area overlays between layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import clamp
from .gridjoin import box_left, box_pairs, box_semi

BOX = ("minx", "miny", "maxx", "maxy")


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column but ``keep``, so two layers can meet in one join."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c)
                       for c in df.columns])


def pbox(prefix: str) -> tuple[str, str, str, str]:
    return tuple(prefix + c for c in BOX)  # type: ignore[return-value]


def box_within(inner: Sequence[str], outer: Sequence[str]) -> Column:
    i, o = [F.col(c) for c in inner], [F.col(c) for c in outer]
    return (i[0] >= o[0]) & (i[1] >= o[1]) & (i[2] <= o[2]) & (i[3] <= o[3])


def point_in_box(x: str, y: str, box: Sequence[str]) -> Column:
    """Strictly inside."""
    b = [F.col(c) for c in box]
    return (F.col(x) > b[0]) & (F.col(x) < b[2]) & (F.col(y) > b[1]) & (F.col(y) < b[3])


def _predicate(kind: str, lb, rb, rings: tuple[str, str] | None) -> Column | None:
    """Join condition by name; without rings both sides are plain boxes."""
    if kind not in ("intersects", "within", "contains"):
        raise ValueError(f"unknown predicate: {kind}")
    if rings is None:
        return {"intersects": None, "within": box_within(lb, rb),
                "contains": box_within(rb, lb)}[kind]
    a, b = rings
    return {"intersects": g.intersects(a, b), "within": g.contains(b, a),
            "contains": g.contains(a, b)}[kind]


def spatial_join(left: DataFrame, right: DataFrame, kind: str, left_box, right_box, *,
                 rings: tuple[str, str] | None = None, keep_unmatched: bool = True,
                 key: Sequence[str] = (), **kw) -> DataFrame:
    """Pairs of left and right rows; unmatched left rows stay, with NULLs. Pairs are
    rows, not lists, so one left row with very many matches is no problem."""
    cond = _predicate(kind, left_box, right_box, rings)
    if keep_unmatched:
        return box_left(left, right, left_box, right_box, key, condition=cond, **kw)
    return box_pairs(left, right, left_box, right_box, condition=cond, **kw)


def intersects_any(left: DataFrame, right: DataFrame, left_box, right_box,
                   key: Sequence[str], *, rings: tuple[str, str] | None = None,
                   **kw) -> DataFrame:
    return box_semi(left, right, left_box, right_box, key,
                    condition=_predicate("intersects", left_box, right_box, rings), **kw)


def containers_of(points: DataFrame, areas: DataFrame, xy, area_box, *,
                  rings: str | None = None, **kw) -> DataFrame:
    """Point-in-polygon pairs (interior only)."""
    x, y = xy
    cond = (point_in_box(x, y, area_box) if rings is None
            else g.contains_point(rings, x, y))
    return box_pairs(points, areas, (x, y, x, y), area_box, condition=cond, **kw)


def within_distance(left: DataFrame, right: DataFrame, left_box, right_box,
                    distance: float | Column, **kw) -> DataFrame:
    """Box pairs no further apart than ``distance`` (may depend on the left row)."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    return box_pairs(left, right, left_box, right_box, margin=distance,
                     condition=g.box_box_distance(left_box, right_box) <= d, **kw)


def population_within(areas: DataFrame, zones: DataFrame, area_box, zone_box, *,
                      area_key: Sequence[str], population: str = "population",
                      method: str = "areal", rings: tuple[str, str] | None = None,
                      **kw) -> DataFrame:
    """Population inside each area: by shared area, or by zone centre. Areas that meet no
    zone are absent. Zones without extent count as points (contained or not)."""
    zb = [F.col(c) for c in zone_box]
    cx, cy = (zb[0] + zb[2]) / 2, (zb[1] + zb[3]) / 2
    ab = [F.col(c) for c in area_box]
    if rings is None:
        shared, own = g.box_overlap(area_box, zone_box), g.box_area(*zone_box)
        inside = (cx > ab[0]) & (cx < ab[2]) & (cy > ab[1]) & (cy < ab[3])
    else:
        shared, own = g.overlap_area(*rings), g.area(rings[1])
        center = g.centroid(rings[1])
        inside = g.contains_point(rings[0], center["x"], center["y"])
    if method == "centroid":
        share = F.when(inside, F.lit(1.0)).otherwise(0.0)
    elif method == "areal":
        share = F.when(own > 0, shared / own).otherwise(
            F.when(inside, F.lit(1.0)).otherwise(0.0))
    else:
        raise ValueError(f"unknown method: {method}")
    pairs = box_pairs(areas, zones, area_box, zone_box, **kw)
    return pairs.groupBy(*area_key).agg(
        F.sum(F.coalesce(F.col(population), F.lit(0.0)) * share).alias("population"))


def coverage(served: Column, total: Column) -> Column:
    """Clamped share, 0 when there is nobody."""
    return F.when(total > 0, clamp(served / total, 0.0, 1.0)).otherwise(F.lit(0.0))


def union_pieces(boxes: DataFrame, key: Sequence[str], box: Sequence[str],
                 cell: float | None = None) -> DataFrame:
    """Disjoint slabs of the union of each group's boxes: ``x0, x1, height``.

    Copies are dropped and the boxes cut along a grid first, so that a group with very
    many members becomes many small (group, cell) problems; areas of cells add up. In a
    cell, a slab sits between neighbouring box edges; inside it the boxes are intervals
    in y, merged with a running maximum.
    """
    x0, y0, x1, y1 = box
    b = boxes.select(*key, F.col(x0).alias("_bx0"), F.col(y0).alias("_y0"),
                     F.col(x1).alias("_bx1"), F.col(y1).alias("_y1")).distinct()
    if cell is None:
        mean = b.agg(F.avg(F.greatest(F.col("_bx1") - F.col("_bx0"),
                                      F.col("_y1") - F.col("_y0")))).head()[0]
        cell = max(float(mean or 1.0), 1e-6)
    size = F.lit(cell)
    b = (b.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_bx0") / size),
                                                  F.floor(F.col("_bx1") / size))))
         .withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_y0") / size),
                                                 F.floor(F.col("_y1") / size)))))
    b = b.select(*key, "_cx", "_cy",
                 F.greatest("_bx0", F.col("_cx") * size).alias("_bx0"),
                 F.greatest("_y0", F.col("_cy") * size).alias("_y0"),
                 F.least("_bx1", (F.col("_cx") + 1) * size).alias("_bx1"),
                 F.least("_y1", (F.col("_cy") + 1) * size).alias("_y1"))
    b = b.where((F.col("_bx1") > F.col("_bx0")) & (F.col("_y1") > F.col("_y0"))).distinct()
    slot = [*key, "_cx", "_cy"]
    cuts = (b.select(*slot, F.explode(F.array("_bx0", "_bx1")).alias("x0")).distinct()
            .withColumn("x1", F.lead("x0").over(Window.partitionBy(*slot).orderBy("x0")))
            .where(F.col("x1").isNotNull()))
    strips = cuts.join(b, slot).where(
        (F.col("_bx0") <= F.col("x0")) & (F.col("_bx1") >= F.col("x1")))
    w = Window.partitionBy(*slot, "x0").orderBy("_y0", "_y1")
    top = F.max("_y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0.0), F.col("_y1") - F.greatest(
        F.col("_y0"), F.coalesce(top, F.col("_y0"))))
    return (strips.withColumn("_gain", gain).groupBy(*slot, "x0", "x1")
            .agg(F.sum("_gain").alias("height")))


def union_area(boxes: DataFrame, key: Sequence[str], box: Sequence[str],
               name: str = "area", cell: float | None = None) -> DataFrame:
    """Area of the union of each group's boxes, overlaps counted once."""
    return union_pieces(boxes, key, box, cell).groupBy(*key).agg(
        F.sum((F.col("x1") - F.col("x0")) * F.col("height")).alias(name))


def overlay_fraction(left: DataFrame, right: DataFrame, left_box, right_box,
                     key: Sequence[str], **kw) -> DataFrame:
    """Share of each left box covered by the union of the right boxes, in 0..1."""
    lb, rb = [F.col(c) for c in left_box], [F.col(c) for c in right_box]
    own = left.select(*key, g.box_area(*left_box).alias("_own"))
    pieces = (box_pairs(left, right, left_box, right_box, **kw)
              .select(*key, F.greatest(lb[0], rb[0]).alias("_x0"),
                      F.greatest(lb[1], rb[1]).alias("_y0"),
                      F.least(lb[2], rb[2]).alias("_x1"), F.least(lb[3], rb[3]).alias("_y1"))
              .where((F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))))
    covered = union_area(pieces, key, ("_x0", "_y0", "_x1", "_y1"), "_covered")
    return own.join(covered, list(key), "left").select(
        *key, F.when(F.col("_own") > 0, clamp(
            F.coalesce("_covered", F.lit(0.0)) / F.col("_own"), 0.0, 1.0))
        .otherwise(F.lit(0.0)).alias("fraction"))


def excluded(items: DataFrame, constraints: DataFrame, item_box, constraint_box,
             key: Sequence[str], buffer: Column | float = 0.0, **kw) -> DataFrame:
    """Items that meet the exclusion mask: the union of the constraints, each with its
    own outward buffer. "Meets the union" is "meets any member", so nothing is merged."""
    b = buffer if isinstance(buffer, Column) else F.lit(float(buffer))
    hits = box_pairs(constraints, items, constraint_box, item_box, margin=b,
                     condition=g.box_box_distance(constraint_box, item_box) <= b, **kw)
    return items.join(hits.select(*key).distinct(), list(key), "left_semi")
