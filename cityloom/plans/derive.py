"""Whole-table derivations: wards, knowledge-graph triples, road-bounded land, proposals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ROAD_RATES, WARD_HOUSEHOLD_SIZE
from ..functions import geometry as g
from ..functions.scalars import lookup
from ..operators import network
from ..operators.gridjoin import box_pairs
from ..operators.overlay import BOX, containers_of, pbox, prefixed
from ..operators.traversal import components
from ..session import written

#: Cells a side of the squares in which cells are joined; a column of one is a number of 64 bits.
SQUARE = 64


def quadrant_wards(areas: DataFrame) -> DataFrame:
    """Four wards per area: the quadrants of its bounds (area columns, ``ward`` 1..4)."""
    mx, my = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    quads = ((1, "minx", my, mx, "maxy"), (2, mx, my, "maxx", "maxy"),
             (3, "minx", "miny", mx, my), (4, mx, "miny", "maxx", my))
    parts = F.array(*[F.struct(F.lit(i).alias("ward"), *[
        (F.col(v) if isinstance(v, str) else v).alias(c) for v, c in zip(vs, BOX)])
        for i, *vs in quads])
    rest = [c for c in areas.columns if c not in BOX]
    return areas.withColumn("_w", F.explode(parts)).select(*rest, "_w.*")


def ward_zones(wards: DataFrame, km2: float = 1.5) -> DataFrame:
    """Population zones from wards: households and density."""
    p = F.col("population")
    return wards.withColumns({"households": (p / WARD_HOUSEHOLD_SIZE).cast("int"),
                              "density_per_sqkm": F.bround(p / km2, 2)})


def entity_registry(facilities: DataFrame, wards: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row per named thing, once per id."""
    def entity(df, prefix, kind, name, table):
        return df.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"),
                         kind.alias("entity_type"), name.alias("name"),
                         F.lit(table).alias("table_name"), F.col("id").alias("record_id"))
    land = F.concat(F.lit("Parcel #"), F.col("id").cast("string"), F.lit(" ("), F.coalesce(
        "land_use", F.lit("None")), F.lit(")"))
    parts = (entity(facilities, "fac_", F.upper("type"), F.col("name"), "facilities")
             .unionByName(entity(wards, "ward_", F.lit("WARD"), F.col("name"),
                                 "administrative_areas"))
             .unionByName(entity(parcels, "parcel_", F.lit("PARCEL"), land, "land_parcels")))
    return parts.dropDuplicates(["id"])


def relationships(facilities: DataFrame, wards: DataFrame, parcels: DataFrame) -> DataFrame:
    """Facilities located in, parcels inside the wards that hold their middle."""
    w = prefixed(wards.select("id", *BOX), "w_")

    def triples(points, prefix, predicate):
        return containers_of(points, w, ("x", "y"), pbox("w_")).select(
            F.concat(F.lit(prefix), F.col("id").cast("string")).alias("subject_entity"),
            F.lit(predicate).alias("predicate"),
            F.concat(F.lit("ward_"), F.col("w_id").cast("string")).alias("object_entity"),
            F.lit(0.0).alias("distance_m"))
    middle = parcels.select("id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
                            ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    return triples(facilities.select("id", "x", "y"), "fac_", "located_in").unionByName(
        triples(middle, "parcel_", "inside"))


def land_blocks(areas: DataFrame, roads: DataFrame, cell: float, clearance: float = 8.0,
                key: str = "area_id") -> DataFrame:
    """Road-bounded blocks on a grid: cells of each area whose middle is further than the
    clearance from every road, joined with their four neighbours into blocks.

    ``roads``: straight pieces ``ax, ay, bx, by``. Returns key, cx, cy, block. Cells are joined square by square in
    one task each; only links between squares go through rounds.
    """
    def cells(lo, hi):
        return F.floor(F.col(lo) / cell).cast("long"), (F.ceil(F.col(hi) / cell) - 1).cast("long")

    def squares(first, last):
        return F.explode(F.sequence(*[F.floor(F.col(c) / SQUARE).cast("long") for c in (first, last)]))
    (x0, x1), (y0, y1) = cells("minx", "maxx"), cells("miny", "maxy")
    land = areas.select(key, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).where("x0 <= x1 AND y0 <= y1")
    land = land.withColumn("sx", squares("x0", "x1")).withColumn("sy", squares("y0", "y1"))
    spot = ["sx", "sy"]
    schema = land.select(key, *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).withColumnsRenamed(
        {"x0": "cx", "y0": "cy", "x1": "rx", "y1": "ry"}).schema
    near = _near_columns(roads, cell, clearance)
    free = written(land.groupBy(*spot).cogroup(near.groupBy(*spot)).applyInArrow(_square_pieces(key), schema))
    root = F.struct(key, "rx", "ry")
    links = None
    for c, other in (("cx", "cy"), ("cy", "cx")):
        low = free.where(F.pmod(c, F.lit(SQUARE)) == 0).select(key, (F.col(c) - 1).alias(c), other, root.alias("b"))
        high = free.where(F.pmod(c, F.lit(SQUARE)) == SQUARE - 1).select(key, c, other, root.alias("a"))
        tied = high.join(low.hint("merge"), [key, "cx", "cy"]).select("a", "b").distinct()
        links = tied if links is None else links.unionByName(tied)
    blocks = components(links, "a", "b").select(F.col("node")[key].alias(key), *[F.col("node")[c].alias(c) for c in ("rx", "ry")],
                                                *[F.col("component")[c].alias("_" + c) for c in ("rx", "ry")])
    named = free.join(blocks.hint("merge"), [key, "rx", "ry"], "left")
    return named.select(key, "cx", "cy", _cell_key(F.col(key), F.coalesce("_rx", "rx"), F.coalesce("_ry", "ry")).alias("block"))


def _near_columns(roads: DataFrame, cell: float, clearance: float) -> DataFrame:
    """``sx, sy, cx, bits``: cells within the clearance of a road, by columns of cells in squares. A bit is a cell."""
    def cells(lo, hi):
        return F.explode(F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long")))
    # Some room for rounding: the exact distance decides.
    ends, reach = ("ax", "ay", "bx", "by"), clearance + cell * 1e-6
    r = roads.select(*ends, cells(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach).alias("cx"))
    r = r.withColumn("x", (F.col("cx") + 0.5) * cell)
    lo, hi = F.greatest(F.least("ax", "bx"), F.col("x") - reach), F.least(F.greatest("ax", "bx"), F.col("x") + reach)
    slope = F.when(F.col("bx") == F.col("ax"), F.lit(None)).otherwise((F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    y = [F.coalesce(F.col("ay") + (x - F.col("ax")) * slope, F.col(end)) for x, end in ((lo, "ay"), (hi, "by"))]
    r = r.where(lo <= hi).withColumn("cy", cells(F.least(*y) - reach, F.greatest(*y) + reach))
    line = F.array(F.array(g.vertex("ax", "ay"), g.vertex("bx", "by")))
    r = r.withColumns({"y": (F.col("cy") + 0.5) * cell, "_line": line}).where(g.line_distance("_line", "x", "y") <= clearance)
    bit = F.expr(f"shiftleft(1L, CAST(pmod(cy, {SQUARE}) AS INT))")
    return r.groupBy(*[F.floor(F.col(c) / SQUARE).cast("long").alias(s) for c, s in (("cx", "sx"), ("cy", "sy"))], "cx").agg(
        F.bit_or(bit).alias("bits"))


def _square_pieces(key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Free cells of one square, each with the first cell of its piece."""
    def pieces(land: pa.Table, near: pa.Table) -> pa.Table:
        names, kind = [key, "cx", "cy", "rx", "ry"], land.schema.field(key).type
        if not land.num_rows:
            return pa.table([pa.array([], kind), *[pa.array([], pa.int64())] * 4], names=names)
        left, low = (land.column(c)[0].as_py() * SQUARE for c in ("sx", "sy"))
        off = np.ones((SQUARE, SQUARE), bool)
        if near.num_rows:
            bits = near.column("bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            off[near.column("cx").to_numpy() - left] = ~np.unpackbits(bits, axis=1, bitorder="little").astype(bool)
        own: dict = {}
        for area, *bounds in zip(*[land.column(c).to_pylist() for c in (key, "x0", "x1", "y0", "y1")], strict=True):
            x0, x1, y0, y1 = (max(0, b) for b in (bounds[0] - left, bounds[1] - left + 1, bounds[2] - low, bounds[3] - low + 1))
            own.setdefault(area, np.zeros((SQUARE, SQUARE), bool))[x0:x1, y0:y1] = True
        areas, found = [], []
        for area, mine in own.items():
            free = mine & off
            # Runs of cells in a column, numbered in the order of their first cells; neighbouring columns tie them.
            new = free & ~np.pad(free, ((0, 0), (1, 0)))[:, :-1]
            run = np.cumsum(new).reshape(free.shape) - 1
            tie = free[:-1] & free[1:]
            up = list(range(int(new.sum())))
            for a, b in set(zip(run[:-1][tie].tolist(), run[1:][tie].tolist(), strict=True)):
                while up[a] != a:
                    up[a] = a = up[up[a]]
                while up[b] != b:
                    up[b] = b = up[up[b]]
                up[max(a, b)] = min(a, b)
            for i, a in enumerate(up):
                up[i] = up[a]  # a lower run, whose root is known
            first = np.flatnonzero(new)[np.array(up, dtype=int)[run[free]]] if up else np.array([], int)
            cell = np.flatnonzero(free)
            areas += [area] * len(cell)
            found.append(np.stack([cell // SQUARE + left, cell % SQUARE + low, first // SQUARE + left, first % SQUARE + low]))
        return pa.table([pa.array(areas, kind), *[pa.array(c, pa.int64()) for c in np.concatenate(found, axis=1)]], names=names)
    return pieces


def _cell_key(area: Column, cx: Column, cy: Column) -> Column:
    """Distinct text per cell; padded so that text order is stable."""
    return F.concat_ws("/", area.cast("string"), F.lpad((cx + 10**9).cast("string"), 12, "0"),
                       F.lpad((cy + 10**9).cast("string"), 12, "0"))


def block_parcels(blocks: DataFrame, cell: float, min_area: float = 300.0,
                  key: str = "area_id") -> DataFrame:
    """Blocks as parcels: area, bounds and middle; slivers are dropped."""
    b = blocks.groupBy(key, "block").agg(
        (F.count(F.lit(1)) * cell * cell).alias("area"), (F.min("cx") * cell).alias("minx"),
        (F.min("cy") * cell).alias("miny"), ((F.max("cx") + 1) * cell).alias("maxx"),
        ((F.max("cy") + 1) * cell).alias("maxy"),
        ((F.avg("cx") + 0.5) * cell).alias("x"), ((F.avg("cy") + 0.5) * cell).alias("y"))
    return b.where(F.col("area") > min_area)


def road_proposals(proposals: DataFrame, parcels: DataFrame, buildings: DataFrame,
                   water: DataFrame) -> DataFrame:
    """Impact of proposed straight roads: land and buildings in the corridor, water close
    by, and the rule-of-thumb indices.

    ``proposals``: road_id, road_type, lanes, speed, ax, ay, bx, by (axis-parallel lines
    make the box distances exact).
    """
    box = ("p_minx", "p_miny", "p_maxx", "p_maxy")
    p = proposals.withColumns({
        "p_minx": F.least("ax", "bx"), "p_miny": F.least("ay", "by"),
        "p_maxx": F.greatest("ax", "bx"), "p_maxy": F.greatest("ay", "by"),
        "corridor": F.greatest(F.col("lanes") * 3.5 + 5.0, F.lit(10.0)),
        "length_km": F.greatest(F.bround(F.hypot(F.col("bx") - F.col("ax"), F.col("by")
                                                 - F.col("ay")) / 1000.0, 3), F.lit(0.01))})

    def count(layer, reach, name):
        t = layer.select(*[F.col(c).alias("t_" + c) for c in BOX])
        tb = pbox("t_")
        hit = box_pairs(p.select("road_id", "corridor", *box), t, box, tb, margin=reach,
                        condition=g.box_box_distance(box, tb) <= reach)
        return hit.groupBy("road_id").agg(F.count(F.lit(1)).alias(name))
    out = p
    for layer, reach, name in ((parcels, F.col("corridor"), "parcels_affected"),
                               (buildings, F.col("corridor"), "buildings_affected"),
                               (water, F.lit(50.0), "_water")):
        out = out.join(count(layer, reach, name), "road_id", "left")
    w = F.coalesce("_water", F.lit(0))
    rate = lookup(ROAD_RATES, F.lower("road_type"), 5.0)
    idx = network.proposal_indices(F.col("length_km"), F.col("lanes"), F.col("speed"), rate)
    return out.select(
        "road_id", "length_km", F.coalesce("parcels_affected", F.lit(0)).alias("parcels_affected"),
        F.coalesce("buildings_affected", F.lit(0)).alias("buildings_affected"),
        F.when(w > 2, "High").when(w > 0, "Medium").otherwise("Low").alias("flood_exposure"),
        *[c.alias(n) for n, c in idx.items()])
