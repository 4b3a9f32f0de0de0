"""Road networks as node and edge tables: building, noding, degrading, snapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import ROAD_SPEEDS, TRAVEL_MODES
from ..functions import geometry as g
from ..functions.scalars import lookup, parent_id
from .gridjoin import box_pairs
from .nearest import k_nearest
from .scan import running_total

SNAP_M = 0.5
_HALF = 1 << 31


def node_key(x: Column, y: Column, precision: float = SNAP_M) -> Column:
    """Snapped position packed into one long (exact up to 2**31 grid steps)."""
    ix, iy = F.bround(x / precision).cast("long"), F.bround(y / precision).cast("long")
    return F.shiftleft(ix, 32) + iy + F.lit(_HALF)


def node_xy(node: str | Column, precision: float = SNAP_M) -> tuple[Column, Column]:
    n = F.col(node) if isinstance(node, str) else node
    return (F.shiftright(n, 32) * precision,
            (n.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(_HALF)) * precision)


def segments(roads: DataFrame, line: str = "line") -> DataFrame:
    """One row per straight piece of a road: ``seq, ax, ay, bx, by`` and the road columns."""
    rest = [c for c in roads.columns if c != line]
    out = roads.where(F.size(line) >= 2).select(*rest, F.posexplode(g.edges(F.col(line))))
    e = F.col("col")
    return out.select(*rest, F.col("pos").alias("seq"), e["a"]["x"].alias("ax"),
                      e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by"))


def edge_speed(mode: str) -> Column:
    factor, fixed, _ = TRAVEL_MODES[mode]
    if fixed is not None:
        return F.lit(fixed)
    own = F.when(F.col("speed") != 0, F.col("speed"))
    return F.coalesce(own, lookup(ROAD_SPEEDS, F.col("road_class"), 25.0)) * factor


def build_edges(roads: DataFrame, mode: str = "car", precision: float = SNAP_M,
                by: Sequence[str] = (), order: str = "id") -> DataFrame:
    """Directed edges ``src, dst, length, speed, time, road_id, road_class, capacity``.

    ``roads``: id, line, road_class, speed, capacity, oneway. Ends are snapped half-even
    to the grid, loops dropped, lengths taken before snapping; where roads repeat an edge
    the last one in ``order`` counts.
    """
    if mode not in TRAVEL_MODES:
        raise ValueError(f"unknown mode profile: {mode}")
    closed = list(TRAVEL_MODES[mode][2])
    pieces = segments(roads)
    if closed:
        pieces = pieces.where(F.col("road_class").isNull() | ~F.col("road_class").isin(closed))
    pieces = pieces.withColumns({
        "_u": node_key(F.col("ax"), F.col("ay"), precision),
        "_v": node_key(F.col("bx"), F.col("by"), precision),
        "length": F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")),
        "_speed": edge_speed(mode)}).where("_u <> _v")
    ends = F.filter(F.array(
        F.struct(F.col("_u").alias("src"), F.col("_v").alias("dst"), F.lit(0).alias("dir")),
        F.when(~F.coalesce(F.col("oneway"), F.lit(False)), F.struct(
            F.col("_v").alias("src"), F.col("_u").alias("dst"), F.lit(1).alias("dir")))),
        lambda s: s.isNotNull())
    directed = pieces.withColumn("_e", F.explode(ends))
    seconds = F.col("length") / (F.greatest(F.col("_speed"), F.lit(1.0)) * 1000.0 / 3600.0)
    attrs = F.struct("length", F.col("_speed").alias("speed"), seconds.alias("time"),
                     F.col("id").cast("string").alias("road_id"), "road_class",
                     F.col("capacity").cast("double").alias("capacity"))
    last = F.max_by(attrs, F.struct(F.col(order), F.col("seq"), F.col("_e.dir")))
    return (directed.groupBy(*by, F.col("_e.src").alias("src"), F.col("_e.dst").alias("dst"))
            .agg(last.alias("_a")).select(*by, "src", "dst", "_a.*"))


def nodes_of(edges: DataFrame, by: Sequence[str] = (), precision: float = SNAP_M) -> DataFrame:
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct()
    x, y = node_xy("node", precision)
    return ends.withColumns({"x": x, "y": y})


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")


# ---------------------------------------------------------------------- noding
def node_roads(roads: DataFrame, tolerance: float = 0.01, key: str = "id") -> DataFrame:
    """Split roads where they meet other roads; pieces are named ``parent#n``.

    Meeting points become distances along the road. Runs of cuts closer than the
    tolerance are thinned run by run; a road is then cut between neighbouring distances.
    """
    rest = [c for c in roads.columns if c not in (key, "line")]
    pieces = roads.select(F.col(key).cast("string").alias("road"),
                          F.explode(_measured_edges("line")).alias("s"))
    a = pieces.select("road", *_flat("s", ""))
    b = pieces.select(F.col("road").alias("o_road"), *_flat("s", "o_"))
    box_a, box_b = ("x0", "y0", "x1", "y1"), ("o_x0", "o_y0", "o_x1", "o_y1")
    e, f = _edge(""), _edge("o_")
    met = box_pairs(a, b, box_a, box_b,
                    condition=(F.col("road") != F.col("o_road")) & g.edges_meet(e, f))
    cuts = met.select("road", F.explode(_meeting_measures(e, f)).alias("d"))
    lengths = roads.select(F.col(key).cast("string").alias("road"),
                           g.length(F.array("line")).alias("whole"))
    cuts = cuts.join(lengths, "road").where(
        (F.col("d") > tolerance) & (F.col("d") < F.col("whole") - tolerance))
    kept = _thin_cuts(cuts.select("road", "d").distinct(), tolerance)
    marks = (kept.unionByName(kept.select("road").distinct().withColumn("d", F.lit(0.0)))
             .join(lengths, "road"))
    w = Window.partitionBy("road").orderBy("d")
    spans = marks.withColumn("e", F.coalesce(F.lead("d").over(w), F.col("whole"))).where(
        F.col("e") - F.col("d") > tolerance)
    spans = spans.withColumn("n", F.row_number().over(w) - 1).select("road", "d", "e", "n")
    base = roads.withColumn("road", F.col(key).cast("string"))
    split = base.join(spans, "road").select(
        F.concat_ws("#", "road", "n").alias(key), *rest,
        g.substring(F.col("line"), F.col("d"), F.col("e")).alias("line"))
    whole = base.join(spans, "road", "left_anti").select(F.col("road").alias(key), *rest, "line")
    return whole.unionByName(split)


def _measured_edges(line: str) -> Column:
    def pairs(m):
        n = F.greatest(F.size(m) - 1, F.lit(0))
        return F.zip_with(F.slice(m, F.lit(1), n), F.slice(m, F.lit(2), n),
                          lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    return g.let(g.measured(F.col(line)), pairs)


def _flat(s: str, prefix: str) -> list[Column]:
    a, b = F.col(f"{s}.a"), F.col(f"{s}.b")
    return [F.least(a["x"], b["x"]).alias(prefix + "x0"),
            F.least(a["y"], b["y"]).alias(prefix + "y0"),
            F.greatest(a["x"], b["x"]).alias(prefix + "x1"),
            F.greatest(a["y"], b["y"]).alias(prefix + "y1"),
            a.alias(prefix + "a"), b.alias(prefix + "b")]


def _edge(prefix: str) -> Column:
    return F.struct(F.col(prefix + "a").alias("a"), F.col(prefix + "b").alias("b"))


def _meeting_measures(e: Column, f: Column) -> Column:
    """Distances along ``e``'s road of the points it shares with ``f``: the crossing, or
    both ends of a collinear overlap."""
    ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    fx, fy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
    den = ex * fy - ey * fx
    l2 = ex * ex + ey * ey
    span = F.sqrt(l2)

    def along(p):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (
            (p["x"] - e["a"]["x"]) * ex + (p["y"] - e["a"]["y"]) * ey) / l2))
    t = ((f["a"]["x"] - e["a"]["x"]) * fy - (f["a"]["y"] - e["a"]["y"]) * fx) / den
    at = F.when(den != 0, F.array(t)).otherwise(F.array(along(f["a"]), along(f["b"])))
    return F.when(l2 > 0, F.transform(at, lambda k: e["a"]["m"] + k * span))


def _thin_cuts(cuts: DataFrame, tolerance: float) -> DataFrame:
    """Keep a cut when it is further than the tolerance from the last kept one."""
    w = Window.partitionBy("road").orderBy("d")
    new_run = F.coalesce(F.col("d") - F.lag("d").over(w) > tolerance, F.lit(True))
    runs = running_total(cuts.withColumn("_new", new_run.cast("int")), ["road"],
                         [F.col("d")], F.col("_new"), "_run")

    def keep(acc, d):
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last.isNull() | (d - last > tolerance),
                      F.concat(acc, F.array(d))).otherwise(acc)
    # A run spans neighbours within the tolerance, so its list is short.
    kept = runs.groupBy("road", "_run").agg(F.aggregate(
        F.array_sort(F.collect_list("d")), F.array().cast("array<double>"), keep).alias("ds"))
    return kept.select("road", F.explode("ds").alias("d"))


def apply_road_deltas(base: DataFrame, added: DataFrame, removed: DataFrame,
                      modified: DataFrame, key: str = "id") -> DataFrame:
    """Scenario road set: removed ids gone, patched attributes replaced, new roads added.
    ``modified`` holds the key and the patchable columns (NULL = unchanged)."""
    patch = [c for c in modified.columns if c != key]
    alive = base.join(removed.select(key).distinct(), key, "left_anti")
    joined = alive.join(modified.select(key, *[F.col(c).alias("_p_" + c) for c in patch]),
                        key, "left")
    out = joined.select(*[F.coalesce("_p_" + c, c).alias(c) if c in patch else F.col(c)
                          for c in base.columns])
    return out.unionByName(added, allowMissingColumns=True)


# ------------------------------------------------------------------- degradation
def degrade(edges: DataFrame, closures: DataFrame | None = None, slow_factor: float = 3.0,
            by: Sequence[str] = (), footprints: DataFrame | None = None,
            precision: float = SNAP_M) -> DataFrame:
    """Edges with hazard effects: blocked ones gone, slowed ones slower.

    ``closures``: by..., road_id, effect (``blocked`` or ``slowed``), matched on the full
    or the parent road id; blocked wins. ``footprints``: by..., and closed polygon rings
    in ``rings`` with bounds ``f_minx..``; an edge is closed when an end or its middle is
    inside.
    """
    out = edges
    if closures is not None:
        blocked = F.max(F.when(F.col("effect") == "blocked", 2).otherwise(1)).alias("_level")
        marks = closures.groupBy(*by, F.col("road_id").cast("string").alias("_mark")).agg(blocked)
        raw = marks.withColumnsRenamed({"_mark": "road_id", "_level": "_own"})
        parent = marks.withColumnsRenamed({"_mark": "_parent", "_level": "_inherited"})
        out = (out.withColumn("_parent", parent_id("road_id"))
               .join(raw, [*by, "road_id"], "left").join(parent, [*by, "_parent"], "left"))
        level = F.coalesce(F.greatest("_own", "_inherited"), F.lit(0))
        out = (out.withColumn("_level", level).where(F.col("_level") < 2)
               .withColumn("time", F.when(F.col("_level") == 1, F.col("time")
                                          * max(slow_factor, 1.0)).otherwise(F.col("time")))
               .select(*edges.columns))
    if footprints is not None:
        ux, uy = node_xy("src", precision)
        vx, vy = node_xy("dst", precision)
        probes = out.withColumn("_p", F.explode(F.array(
            g.vertex(ux, uy), g.vertex(vx, vy), g.vertex((ux + vx) / 2, (uy + vy) / 2))))
        probes = probes.select(*by, "src", "dst", F.col("_p.x").alias("_px"),
                               F.col("_p.y").alias("_py"))
        inside = g.contains_point("rings", "_px", "_py")
        hit = box_pairs(probes, footprints, ("_px", "_py", "_px", "_py"),
                        ("f_minx", "f_miny", "f_maxx", "f_maxy"), condition=inside, on=by)
        out = out.join(hit.select(*by, "src", "dst").distinct(), [*by, "src", "dst"],
                       "left_anti")
    return out


# -------------------------------------------------------------------- snapping
def snap(points: DataFrame, nodes: DataFrame, key: str, xy=("x", "y"),
         by: Sequence[str] = ()) -> DataFrame:
    """key, node, snap_m: nearest network node of each point."""
    places = nodes.select(*by, "node", F.col("x").alias("_nx"), F.col("y").alias("_ny"))
    got = k_nearest(points, places, 1, left_id=key, right_id="node", left_xy=xy,
                    right_xy=("_nx", "_ny"), on=by)
    return got.select(*by, key, "node", F.col("distance").alias("snap_m"))


# -------------------------------------------------------------- simple road figures
def road_tables(roads: DataFrame) -> DataFrame:
    """Plain routing rows from a network extract: default speed 40 km/h."""
    mps = F.coalesce(F.col("maxspeed"), F.lit(40.0)) * 1000.0 / 3600.0
    length = F.coalesce(F.col("length_m"), F.lit(100.0))
    seconds = F.when(mps > 0, length / mps).otherwise(length / 11.1)
    return roads.select("source_node", "target_node", F.bround(length, 2).alias("length_m"),
                        F.bround(seconds, 2).alias("travel_time_sec"),
                        F.coalesce("road_class", F.lit("residential")).alias("road_class"))


def minutes_at_40(distance_m: Column) -> Column:
    return F.bround(distance_m / 666.6, 2)


def proposal_indices(length_km: Column, lanes: Column, speed: Column,
                     rate: Column) -> dict[str, Column]:
    """Rule-of-thumb effect of a proposed road."""
    return {"connectivity": F.bround(F.least(length_km * 4.2 + lanes * 0.8, F.lit(25.0)), 1),
            "travel_reduction": F.bround(F.least(length_km * 2.8 + speed * 0.05,
                                                 F.lit(18.0)), 1),
            "cost_cr": F.bround(length_km * lanes * rate, 2)}
