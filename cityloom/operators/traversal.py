"""Iterative graph jobs: shortest times, components, strong core, cut nodes.

Every loop is a sequence of DataFrame jobs over the whole frontier. Each round ends in a
checkpoint on shared storage, which cuts the lineage; several hops are chained inside one
round. Only "is anything left" comes back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_empty, written
from . import blocks
from .blocks import contracted, shortest, strongly_contracted
from .network import nodes_of, reversed_edges


#: A node of a contracted graph with more pairs of ways in and out is not bridged by two-edge ways.
MOST_WAYS = 64


def _spread(frontier: DataFrame, edges: DataFrame, keys: Sequence[str], edge_by: Sequence[str],
            weight: str | None, cutoff: float | str | None) -> DataFrame:
    cost = F.col("value") if weight is None else F.col("value") + F.col("_w")
    step = frontier.join(edges, [*edge_by, "node"]).select(
        *[k for k in keys if k != "node"], F.col("_to").alias("node"), cost.alias("value"))
    if cutoff is not None:
        step = step.where(F.col("value") <= (F.col(cutoff) if isinstance(cutoff, str) else cutoff))
    return step.groupBy(*keys).agg(F.min("value").alias("value"))


def _two_hops(edges: DataFrame, edge_by: Sequence[str], weight: str | None,
              cutoff: float | str | None) -> DataFrame:
    """Edges and two-edge ways as ``node, _to, _w``: half as many rounds for a few times
    the rows (road junctions have few neighbours). Without a weight the graph may be a contracted
    one with hubs: no ways are made across those, only their own edges are followed."""
    cutoff = None if isinstance(cutoff, str) else cutoff
    w = F.lit(0.0) if weight is None else F.col(weight)
    one = edges.select(*edge_by, F.col("src").alias("node"), F.col("dst").alias("_to"),
                       w.alias("_w"))
    if cutoff is not None:
        one = one.where(F.col("_w") <= cutoff)
    on = one.select(*edge_by, F.col("node").alias("_to"), F.col("_to").alias("_far"),
                    F.col("_w").alias("_w2"))
    if weight is None:
        came = one.groupBy(*edge_by, "_to").agg(F.count(F.lit(1)).alias("_i"))
        left = on.groupBy(*edge_by, "_to").agg(F.count(F.lit(1)).alias("_o"))
        hubs = came.join(left, [*edge_by, "_to"]).where(F.col("_i") * F.col("_o") > MOST_WAYS)
        on = on.join(hubs.select(*edge_by, "_to"), [*edge_by, "_to"], "left_anti")
    two = one.join(on, [*edge_by, "_to"]).select(
        *edge_by, "node", F.col("_far").alias("_to"), (F.col("_w") + F.col("_w2")).alias("_w"))
    both = one.unionByName(two).where("node <> _to")
    if cutoff is not None:
        both = both.where(F.col("_w") <= cutoff)
    return both.groupBy(*edge_by, "node", "_to").agg(F.min("_w").alias("_w"))


def relax(edges: DataFrame, starts: DataFrame, *, by: Sequence[str] = (),
          edge_by: Sequence[str] = (), weight: str | None = "time",
          cutoff: float | str | None = None, hops: int = 3, value: str = "cost") -> DataFrame:
    """Smallest value per (by..., node) reachable from ``starts`` along directed edges.

    ``starts``: by..., node, ``value``. With a weight the value grows along edges (shortest
    time), and the search goes block by block (:mod:`.blocks`); without one it is carried unchanged
    (smallest label that reaches a node), and one round follows ``hops`` edges or two-edge ways.
    ``edge_by`` names the keys by which the edge table itself differs (runs). ``cutoff`` is one
    number, or a column of ``by`` that holds the cutoff of each search.
    """
    if weight is not None:
        return shortest(edges, starts, by=by, edge_by=edge_by, weight=weight, cutoff=cutoff, value=value)
    keys = [*by, "node"]
    # Laid out by source once; a lost block is computed again from its source.
    net = _two_hops(edges, edge_by, weight, cutoff).repartition(*edge_by, "node").persist()
    state = cut(starts.groupBy(*keys).agg(F.min(value).alias("value"))
                .withColumn("fresh", F.lit(True)))
    while True:
        frontier = state.where("fresh").drop("fresh")
        reached, step = None, frontier
        for _ in range(hops):
            step = _spread(step, net, keys, edge_by, weight, cutoff)
            reached = step if reached is None else reached.unionByName(step)
        best = reached.groupBy(*keys).agg(F.min("value").alias("_new"))
        better = F.col("_new").isNotNull() & (
            F.col("value").isNull() | (F.col("_new") < F.col("value")))
        state = cut(state.drop("fresh").join(best, keys, "full").select(
            *keys, F.least("value", "_new").alias("value"), better.alias("fresh")))
        if is_empty(state.where("fresh")):
            break
    net.unpersist()
    return state.select(*keys, F.col("value").alias(value))


def travel_times(edges: DataFrame, origins: DataFrame, destinations: DataFrame, *,
                 origin_key: str, dest_key: str, cutoff: float | None = None,
                 by: Sequence[str] = (), hops: int = 3) -> DataFrame:
    """Long travel-time matrix ``by..., origin_key, dest_key, cost``.

    Both sides come snapped (``node``). One search runs per distinct node on the origin
    side, all at once; a missing row is an unreachable pair.
    """
    seeds = origins.select(*by, F.col("node").alias("_from"), "node").distinct().withColumn(
        "cost", F.lit(0.0))
    targets = destinations.select(*by, "node", dest_key)
    reach = relax(edges, seeds, by=[*by, "_from"], edge_by=by, cutoff=cutoff, hops=hops)
    hits = reach.join(targets, [*by, "node"]).select(*by, "_from", dest_key, "cost")
    who = origins.select(*by, origin_key, F.col("node").alias("_from"))
    return who.join(hits, [*by, "_from"]).select(*by, origin_key, dest_key, "cost")


def nearest_time(edges: DataFrame, origins: DataFrame, facilities: DataFrame, *,
                 origin_key: str, cutoff: float | None = None, by: Sequence[str] = (),
                 edge_by: Sequence[str] | None = None, hops: int = 3) -> DataFrame:
    """Time from each origin to its nearest facility, from one search that starts at all
    facilities and follows the edges backwards. The state is one row per node (and run),
    whatever the number of facilities. ``edge_by``: run keys the edges differ by, ``by``
    unless given."""
    seeds = facilities.select(*by, "node").distinct().withColumn("cost", F.lit(0.0))
    reach = relax(reversed_edges(edges), seeds, by=by, cutoff=cutoff, hops=hops,
                  edge_by=by if edge_by is None else edge_by)
    return origins.select(*by, origin_key, "node").join(reach, [*by, "node"]).select(
        *by, origin_key, "cost")


def nearest_sources(edges: DataFrame, starts: DataFrame, k: int, *, by: Sequence[str] = (),
                    slack: float = 0.0) -> DataFrame:
    """``by..., node, source, cost``: at every node the ``k`` nearest sources, and all others up to
    ``slack`` behind the k-th, from one search. ``starts``: by..., node, one source each.

    A source among those of a node is among those of every node on its best way there, so a node
    hands on only these: the state is k rows a node, whatever the number of sources and the extent. The search goes
    block by block (:mod:`.blocks`).
    """
    return blocks.nearest(edges, starts, k, by=by, slack=slack)


def next_hops(edges: DataFrame, dist: DataFrame, by: Sequence[str] = (),
              edge_by: Sequence[str] = ()) -> DataFrame:
    """For distances *to* a target: the next node on a best way, ``node, next, length``.
    Times are positive, so the neighbour with the least total is always nearer."""
    a = dist.where("cost > 0").select(*by, F.col("node").alias("src"))
    b = dist.select(*by, F.col("node").alias("dst"), F.col("cost").alias("_cd"))
    options = edges.select(*edge_by, "src", "dst", "time", "length").join(
        a, [*edge_by, "src"]).join(b, [*by, "dst"])
    best = options.groupBy(*by, "src").agg(F.min(F.struct(
        (F.col("_cd") + F.col("time")).alias("t"), "dst", "length")).alias("_b"))
    return best.select(*by, F.col("src").alias("node"), F.col("_b.dst").alias("next"),
                       F.col("_b.length").alias("length"))


def walk(hops: DataFrame, starts: DataFrame, path_key: Sequence[str],
         by: Sequence[str] = ()) -> DataFrame:
    """All nodes on the ways from ``starts`` (path keys, by..., node) along ``hops``:
    ``path_key, hop, node``. Pointer doubling: log2(longest way) rounds."""
    jump = cut(hops.select(*by, "node", "next"))
    paths = starts.select(*dict.fromkeys([*path_key, *by]), "node").withColumn("hop", F.lit(0))
    size = 1
    while True:
        far = paths.join(jump, [*by, "node"]).select(
            *dict.fromkeys([*path_key, *by]), F.col("next").alias("node"),
            (F.col("hop") + size).alias("hop"))
        paths = written(paths.unionByName(far))
        second = jump.select(*by, F.col("node").alias("next"), F.col("next").alias("_n2"))
        jump = written(jump.join(second, [*by, "next"]).select(
            *by, "node", F.col("_n2").alias("next")))
        size *= 2
        if is_empty(jump):
            return paths


# ------------------------------------------------------------------ components
def components(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``node, component`` of an undirected graph; a component is named by its smallest
    node. Large-star / small-star rounds: their number grows with log(nodes)."""
    loops = pairs.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    e = cut(pairs.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v"))
        large = large.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_low, "u")
        e = cut(linked.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
            .where("u <> v").distinct())
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if before == tuple(mark):
            break
        before = tuple(mark)
    labelled = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.distinct().join(labelled.unionByName(roots), "node", "left_anti").withColumn(
        "component", F.col("node"))
    return labelled.unionByName(roots).unionByName(alone)


def strong_components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., node, component`` of the strongly connected components of a directed graph, of each network that
    ``by`` tells apart. A component is named by its smallest node.

    Pieces inside blocks of the map are merged, and only links on ways through a block are left, which lie in larger
    blocks and are merged again: rounds grow with log(edges). A graph that blocks do not make smaller
    (long one-way ways, or names that are no positions) is coloured.
    """
    by = list(by)
    live = cut(edges.where("src <> dst").select(*by, "src", "dst").distinct())
    label, left = None, live.count()
    while left:
        roots, live = strongly_contracted(live, by, left <= blocks.BLOCK_EDGES)
        live = cut(live)
        label = _renamed(label, roots, by)
        before, left = left, live.count()
        if left > before / 2:
            label, left = _renamed(label, _coloured(live, by), by), 0
    if label is None:
        return live.select(*by, F.col("src").alias("node"), F.col("dst").alias("component"))
    return label.withColumnRenamed("root", "component")


def _renamed(label: DataFrame | None, roots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Names of pieces (``by..., node, root``) after the pieces have been merged to ``roots``."""
    if label is None:
        return roots
    to = roots.select(*by, F.col("node").alias("root"), F.col("root").alias("_root"))
    return cut(label.join(to, [*by, "root"], "left").select(*by, "node", F.coalesce("_root", "root").alias("root")))


def _coloured(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., node, root``: strongly connected components by rounds over the whole graph.

    Ends of two-way edges belong together. What is left, one-way links between those, is trimmed of
    dead ends; what the largest piece reaches and is reached from is one component; the rest is
    coloured: a node takes the smallest name that reaches it, and the nodes
    of that colour that reach its root back form one component.
    """
    if by:
        named = _coloured(edges.select(*[F.struct(*by, F.col(c).alias("node")).alias(c) for c in ("src", "dst")]))
        return named.select(*[F.col("node")[k].alias(k) for k in by], F.col("node")["node"].alias("node"),
                            F.col("root")["node"].alias("root"))
    e = edges
    two_way = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
                     ["src", "dst"], "left_semi")
    every = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    merged = components(two_way)
    label = cut(every.join(merged, "node", "left").select(
        "node", F.coalesce("component", "node").alias("c")))
    ls, ld = (label.select(F.col("node").alias(k), F.col("c").alias("_" + k))
              for k in ("src", "dst"))
    live = cut(e.join(ls, "src").join(ld, "dst").where("_src <> _dst").select(
        F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    found: DataFrame | None = None
    if not is_empty(live):
        # Most links lead to or from one large piece. Colours would pass it one by one.
        hub = cut(label.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c").limit(1).select(
            F.col("c").alias("node"), F.col("c").alias("label")))
        there, back = (relax(e, hub, weight=None, value="label").select("node") for e in (live, reversed_edges(live)))
        core = cut(there.join(back, "node", "left_semi"))
        found = core.join(F.broadcast(core.agg(F.min("node").alias("label"))))
        gone = core.withColumnsRenamed({"node": "src"}), core.withColumnsRenamed({"node": "dst"})
        live = cut(live.join(gone[0], "src", "left_anti").join(gone[1], "dst", "left_anti"))
    while True:
        live = _trim(live)
        if is_empty(live):
            break
        ends = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = relax(live, ends.withColumn("label", F.col("node")), weight=None,
                       value="label")
        cs, cd = (colour.select(F.col("node").alias(k), F.col("label").alias("_" + k))
                  for k in ("src", "dst"))
        inner = live.join(cs, "src").join(cd, "dst").where("_src = _dst").select("src", "dst")
        roots = colour.where("node = label")
        back = relax(reversed_edges(inner), roots, weight=None, value="label")
        found = back if found is None else found.unionByName(back)
        gone = back.select("node")
        live = cut(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
                   .join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if found is None:
        return label.withColumnRenamed("c", "root")
    names = found.select(F.col("node").alias("c"), F.col("label").alias("_scc"))
    return label.join(names, "c", "left").select(
        "node", F.coalesce("_scc", "c").alias("root"))


def _trim(live: DataFrame) -> DataFrame:
    """Drop edges at nodes without incoming or without outgoing edges, until stable."""
    n = live.count()
    while n:
        has_in = live.select(F.col("dst").alias("src")).distinct()
        has_out = live.select(F.col("src").alias("dst")).distinct()
        live = cut(live.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi"))
        left = live.count()
        if left == n:
            break
        n = left
    return live


def largest_component(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes of the biggest component of each network (lowest name among equals)."""
    sizes = labelled.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    if by:
        most = sizes.groupBy(*by).agg(F.max("n").alias("n"))
        top = sizes.join(most, [*by, "n"]).groupBy(*by).agg(F.min("component").alias("component"))
    else:
        top = sizes.orderBy(F.col("n").desc(), F.col("component")).limit(1).select("component")
    return labelled.join(top, [*by, "component"], "left_semi").select(*by, "node")


def routable_core(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes between which every trip is possible, of each network that ``by`` tells apart."""
    return largest_component(strong_components(edges, by), by)


# ----------------------------------------------------------------- service areas
def service_area_nodes(edges: DataFrame, origins: DataFrame, cutoff: float,
                       key: str = "origin_id", hops: int = 3) -> DataFrame:
    """Nodes within ``cutoff`` seconds of each snapped origin: key, node, cost."""
    seeds = origins.select("node", key).withColumn("cost", F.lit(0.0))
    return relax(edges, seeds, by=[key], cutoff=cutoff, hops=hops)


def hull_rings(points: DataFrame, key: Sequence[str], chunk: int = 10_000) -> DataFrame:
    """Convex hull per group in two steps: hulls of bounded, hashed chunks, then the hull
    of their corners."""
    from ..functions.geometry import convex_hull, vertex

    n = points.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_k"))
    parts = points.join(n, list(key)).withColumn(
        "_c", F.pmod(F.xxhash64("x", "y"), F.col("_k")))
    first = parts.groupBy(*key, "_c").agg(
        convex_hull(F.collect_list(vertex("x", "y"))).alias("_h"))
    return first.groupBy(*key).agg(
        convex_hull(F.flatten(F.collect_list("_h"))).alias("ring"))


def isochrone_bands(edges: DataFrame, origins: DataFrame, cutoffs: Sequence[float],
                    key: str = "origin_id", precision: float = 0.5) -> DataFrame:
    """Per origin and cutoff: reachable nodes and the hull they span (the displayed area
    is the hull grown by a buffer; below three nodes there is no hull)."""
    from .network import node_xy

    reach = service_area_nodes(edges, origins, max(cutoffs), key)
    x, y = node_xy("node", precision)
    bands = reach.withColumns({"x": x, "y": y}).withColumn(
        "cutoff", F.explode(F.array(*[F.lit(float(c)) for c in sorted(cutoffs)]))).where(
        F.col("cost") <= F.col("cutoff"))
    counts = bands.groupBy(key, "cutoff").agg(F.count(F.lit(1)).alias("nodes"))
    return counts.join(hull_rings(bands, [key, "cutoff"]), [key, "cutoff"], "left")


# ------------------------------------------------------------------- resilience
def spanning_forest(pairs: DataFrame) -> DataFrame:
    """Tree edges ``u, v`` (u < v) of an undirected graph given as distinct u < v rows.

    Every component takes its smallest outgoing edge and merges along it; the number of
    rounds grows with log(nodes), not with the length of ways.
    """
    live = cut(pairs.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")))
    forest: DataFrame | None = None
    while not is_empty(live):
        rank = F.struct("u", "v")
        ends = live.select(rank.alias("e"), F.explode(F.array(
            F.struct(F.col("cu").alias("c"), F.col("cv").alias("o")),
            F.struct(F.col("cv").alias("c"), F.col("cu").alias("o")))).alias("s"))
        best = cut(ends.groupBy("s.c").agg(F.min(F.struct("e", F.col("s.o").alias("o")))
                                           .alias("b")).select("c", "b.e", "b.o"))
        step = best.select("e.u", "e.v").distinct()
        forest = step if forest is None else forest.unionByName(step)
        merged = components(best.select(F.col("c").alias("src"), F.col("o").alias("dst")))
        merged = cut(merged)
        a, b = (merged.select(F.col("node").alias(k), F.col("component").alias("_" + k))
                for k in ("cu", "cv"))
        live = cut(live.join(a, "cu").join(b, "cv").where("_cu <> _cv").select(
            "u", "v", F.col("_cu").alias("cu"), F.col("_cv").alias("cv")))
    return pairs.select("u", "v").limit(0) if forest is None else forest


def _doubling(table: DataFrame, link: str, key: str, carry: dict[str, Column]) -> DataFrame:
    """Follow ``link`` pointers to the end by doubling; ``carry`` combines the values of a
    row with those of the row it points to (named ``r_<column>``)."""
    names = list(carry)
    state = written(table)
    while not is_empty(state.where(F.col(link).isNotNull())):
        right = state.select(F.col(key).alias(link), F.col(link).alias("_next"),
                             *[F.col(n).alias("r_" + n) for n in names])
        state = written(state.join(right, link, "left").select(
            key, F.col("_next").alias(link), *[c.alias(n) for n, c in carry.items()]))
    return state.drop(link)


def rooted_tree(forest: DataFrame) -> DataFrame:
    """``node, parent, tin, tout`` for a forest: each tree is rooted at its smallest node,
    and a node lies below another when its interval lies inside. Positions come from
    ranking the closed tour around each tree."""
    tree = components(forest.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    arcs = cut(forest.select(F.explode(F.array(
        F.struct(F.col("u").alias("a"), F.col("v").alias("b")),
        F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("s")).select("s.*"))
    # After arriving by (a, b) the tour leaves by the neighbour of b that follows a.
    w = Window.partitionBy("a").orderBy("b")
    turn = arcs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.coalesce(
        F.lead("b").over(w), F.first("b").over(w)).alias("c"))
    first = tree.where("node = component").join(
        arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("f")), "node").select(
        F.struct(F.col("node").alias("a"), F.col("f").alias("b")).alias("start"))
    # Rank backwards: the arc before the start arc ends the list.
    succ = turn.select(F.struct("a", "b").alias("arc"),
                       F.struct(F.col("b").alias("a"), F.col("c").alias("b")).alias("next"))
    stop = first.select(F.col("start").alias("next"), F.lit(True).alias("_stop"))
    chain = succ.join(stop, "next", "left").select(
        "arc", F.when(F.col("_stop").isNull(), F.col("next")).alias("next"), F.lit(1).alias("n"))
    left = _doubling(chain, "next", "arc", {
        "n": F.col("n") + F.coalesce("r_n", F.lit(0))})
    total = tree.groupBy("component").agg((2 * F.count(F.lit(1)) - 2).alias("_m"))
    sizes = tree.join(total, "component").select(F.col("node").alias("a"), "component", "_m")
    pos = left.select("arc.a", "arc.b", "n").join(sizes, "a").withColumn(
        "p", F.col("_m") - F.col("n") + 1)
    back = pos.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    down = pos.join(back, ["a", "b"]).where("p < q").select(
        F.col("b").alias("node"), F.col("a").alias("parent"), F.col("p").alias("tin"),
        F.col("q").alias("tout"))
    roots = total.select(F.col("component").alias("node"), F.lit(None).cast(
        dict(down.dtypes)["parent"]).alias("parent"), F.lit(0).alias("tin"),
        (F.col("_m") + 1).alias("tout"))
    return cut(down.unionByName(roots))


def _subtree_reach(tree: DataFrame, own: DataFrame) -> DataFrame:
    """Smallest and largest ``tin`` that non-tree edges reach from each subtree.
    ``own``: node, lo, hi. Ancestor pointers double; each round hands the values of nodes
    2**k levels down to their ancestor."""
    state = written(own.select("node", "lo", "hi"))
    jump = written(tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("up")))
    while not is_empty(jump):
        risen = state.join(jump, "node").groupBy(F.col("up").alias("node")).agg(
            F.min("lo").alias("l2"), F.max("hi").alias("h2"))
        state = written(state.join(risen, "node", "left").select(
            "node", F.least("lo", "l2").alias("lo"), F.greatest("hi", "h2").alias("hi")))
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("_u2"))
        jump = written(jump.join(above, "up").select("node", F.col("_u2").alias("up")))
    return state


def cut_structure(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bridges ``u, v``; articulation points ``node``) of the undirected graph.

    Tarjan and Vishkin's parallel method: tree edges, named by their lower node, belong to
    one block when a non-tree edge ties them together; blocks are components of that
    relation. A bridge is a block of one tree edge that no other edge passes over; a cut
    node touches two blocks or more.
    """
    pairs = cut(edges.where("src <> dst").select(
        F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
    forest = cut(spanning_forest(pairs))
    tree = rooted_tree(forest)
    other = pairs.join(forest, ["u", "v"], "left_anti")
    at = tree.select("node", "tin", "tout")
    tu = at.withColumnsRenamed({"node": "u", "tin": "iu", "tout": "ou"})
    tv = at.withColumnsRenamed({"node": "v", "tin": "iv", "tout": "ov"})
    spans = cut(other.join(tu, "u").join(tv, "v"))
    far = spans.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("iv").alias("x")),
        F.struct(F.col("v").alias("node"), F.col("iu").alias("x")))).alias("s")).select("s.*")
    ext = far.groupBy("node").agg(F.min("x").alias("_l"), F.max("x").alias("_h"))
    own = at.join(ext, "node", "left").select(
        "node", F.least("tin", "_l").alias("lo"), F.greatest("tin", "_h").alias("hi"))
    full = cut(tree.join(_subtree_reach(tree, own), "node"))
    child = full.where("parent IS NOT NULL")
    inside = (F.col("lo") >= F.col("tin")) & (F.col("hi") <= F.col("tout"))
    bridges = child.where(inside).select(F.least("node", "parent").alias("u"),
                                         F.greatest("node", "parent").alias("v"))
    # Tie tree edges: across unrelated ends of a non-tree edge, and to the parent edge when
    # the subtree reaches outside its parent's interval.
    unrelated = spans.where("NOT (iu <= iv AND ov <= ou) AND NOT (iv <= iu AND ou <= ov)").select(
        F.col("u").alias("src"), F.col("v").alias("dst"))
    up = full.where("parent IS NOT NULL").select(
        F.col("node").alias("parent"), F.col("tin").alias("pi"), F.col("tout").alias("po"))
    climb = child.join(up, "parent").where("lo < pi OR hi > po").select(
        F.col("node").alias("src"), F.col("parent").alias("dst"))
    alone = child.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    block = components(unrelated.unionByName(climb).unionByName(alone))
    tagged = child.join(block, "node").select("node", "parent", "component")
    touches = tagged.select("node", "component").unionByName(
        tagged.select(F.col("parent").alias("node"), "component")).distinct()
    cuts = touches.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    return bridges, cuts


def resilience(edges: DataFrame, bridges: DataFrame, cut_nodes: DataFrame) -> DataFrame:
    """Counts of weak spots and the redundancy index 1 - bridges / directed edges."""
    b = bridges.agg(F.count(F.lit(1)).alias("bridge_edges"))
    n = cut_nodes.agg(F.count(F.lit(1))).scalar()
    e = edges.agg(F.count(F.lit(1))).scalar()
    return b.select("bridge_edges", n.alias("articulation_points"),
                    F.bround(1.0 - F.col("bridge_edges") / e, 4).alias("redundancy_index"))


def off_main_network(labelled: DataFrame, snapped: DataFrame, key: str) -> DataFrame:
    """Snapped facilities whose node is not on the largest component."""
    return snapped.join(largest_component(labelled), "node", "left_anti").select(key)


def degree_summary(edges: DataFrame) -> DataFrame:
    """nodes, directed edges and average degree 2E/N of the undirected graph."""
    und = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    n = nodes_of(edges).agg(F.count(F.lit(1))).scalar()
    u = und.distinct().agg(F.count(F.lit(1))).scalar()
    return e.select(n.alias("nodes"), "edges", F.bround(2.0 * u / n, 3).alias("average_degree"))


def component_sizes(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., component, n``: nodes of every component of the networks that ``by`` tells apart. Pieces
    inside blocks of the map are merged first; one run of :func:`components` over (by..., node) names
    joins them."""
    roots, links = contracted(edges, by)
    roots, links = cut(roots.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n"))), cut(links)
    named = [F.struct(*by, F.col(c).alias("node")).alias(c) for c in ("src", "dst")]
    joined = components(links.select(*named)).select(
        *[F.col("node")[k].alias(k) for k in by], F.col("node")["node"].alias("root"),
        F.col("component")["node"].alias("component"))
    return roots.join(joined, [*by, "root"], "left").groupBy(
        *by, F.coalesce("component", "root").alias("component")).agg(F.sum("n").alias("n"))


def component_summary(labelled: DataFrame) -> DataFrame:
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("connected_components"),
                     F.bround(F.max("n") / F.sum("n"), 4).alias("largest_component_share"))
