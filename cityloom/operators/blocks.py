"""Work on road networks block by block.

Nodes that lie together form blocks of a bounded number of edges: squares that halve until they hold
few enough. What stays inside a block is settled by one task without an exchange; only what
leaves a block is exchanged, so rounds grow with the blocks on a way and not with its edges.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_empty

#: Edges of one block, and searches that one task runs in a block.
BLOCK_EDGES, BLOCK_RUNS = 16384, 64
#: The smallest squares have 2**11 grid steps a side (1 km at half a metre), the largest 2**12 times as many.
FINE, LEVELS = 11, 13
#: Rounds after which the labels found so far are merged.
MERGE = 8
_SPOT = ["_bx", "_by"]


def _spots(node: str, dtype: str) -> list[Column]:
    """The smallest square of a node; names that are no packed positions are dealt by hash."""
    if dtype != "bigint":
        return [F.xxhash64(node).alias("_bx"), F.lit(0).cast("long").alias("_by")]
    n = F.col(node)
    return [F.shiftright(n, 32 + FINE).alias("_bx"),
            F.shiftright(n.bitwiseAND(F.lit((1 << 32) - 1)), FINE).alias("_by")]


def _squares(edges: DataFrame, edge_by: Sequence[str]) -> DataFrame:
    """``_bx, _by, _lv, _deal``: the level of the block of each smallest square, and into how many parts
    one is dealt that holds too much by itself."""
    fine = edges.groupBy(*edge_by, *_spots("src", dict(edges.dtypes)["src"])).agg(F.count(F.lit(1)).alias("_n"))
    fine = cut(fine.groupBy(*_SPOT).agg(F.max("_n").alias("_n")))
    tall = fine.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in range(LEVELS)]))).withColumns(
        {"_sx": F.expr("shiftright(_bx, _lv)"), "_sy": F.expr("shiftright(_by, _lv)")})
    square = ["_lv", "_sx", "_sy"]
    fits = tall.groupBy(*square).agg(F.sum("_n").alias("_all")).where(F.col("_all") <= BLOCK_EDGES).select(*square)
    level = tall.join(fits, square).groupBy(*_SPOT).agg(F.max("_lv").alias("_lv"))
    return cut(fine.join(level, _SPOT, "left").select(
        *_SPOT, F.coalesce("_lv", F.lit(0)).alias("_lv"), F.ceil(F.col("_n") / BLOCK_EDGES).alias("_deal")))


def _housed(df: DataFrame, squares: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the block of ``node``. Two squares of one name would only make one block."""
    x, y = _spots(node, dict(df.dtypes)[node])
    lv = F.coalesce("_lv", F.lit(0))
    out = df.withColumns({"_bx": x, "_by": y}).join(squares, _SPOT, "left").withColumn("_lv", lv)
    part = F.pmod(F.xxhash64(node), F.coalesce("_deal", F.lit(1)))
    return out.withColumn(name, F.xxhash64("_lv", F.expr("shiftright(_bx, _lv)"), F.expr("shiftright(_by, _lv)"), part)).drop(
        *_SPOT, "_lv", "_deal")


def _packed(edges: DataFrame, edge_by: Sequence[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """The squares, and a row for each block: edge_by..., ``_block, links, gates``."""
    home = [*edge_by, "_block"]
    kind = dict(edges.dtypes)["src"]
    squares = _squares(edges, edge_by)
    net = edges.where(F.col(weight).isNotNull()).select(
        *edge_by, "src", F.col("dst").cast(kind).alias("dst"), F.col(weight).cast("double").alias("w"))
    net = _housed(_housed(net, squares, "src", "_block"), squares, "dst", "_next")
    net = cut(net)
    # Gates are the nodes that edges of other blocks lead to.
    gates = net.where("_block <> _next").groupBy(*edge_by, F.col("_next").alias("_block")).agg(
        F.collect_set("dst").alias("gates"))
    ways = net.groupBy(*home).agg(F.collect_list(F.struct("src", "dst", "w", "_next")).alias("links"))
    packed = cut(ways.join(gates, home, "full").withColumns({
        c: F.coalesce(c, F.array().cast(dict([*ways.dtypes, *gates.dtypes])[c])) for c in ("links", "gates")}))
    return squares, packed


def shortest(edges: DataFrame, starts: DataFrame, *, by: Sequence[str] = (), edge_by: Sequence[str] = (),
             weight: str = "time", cutoff: float | str | None = None, value: str = "cost") -> DataFrame:
    """Smallest ``value`` per (by..., node) from ``starts`` along directed edges; see :func:`traversal.relax`.

    A round searches every block that got a better value at one of its nodes, from those nodes on, and hands
    the values of edges that leave it to the blocks they lead to.
    """
    by, edge_by = list(by), list(edge_by)
    kind, home = dict(edges.dtypes)["src"], [*edge_by, "_block"]
    squares, packed = _packed(edges, edge_by, weight)
    keys, mine = [*by, "node"], [*by, "_block"]
    first = starts.withColumn("node", F.col("node").cast(kind)).groupBy(*keys).agg(F.min(value).cast("double").alias("value"))
    news = cut(_housed(first, squares, "node", "_block").select(*keys, "_block", "value"))
    solve = _solver(by, cutoff)
    schema = news.withColumns({"inside": F.lit(True), "gate": F.lit(True)}).schema
    known, have, rounds = news.limit(0), news.limit(0), 0
    while not is_empty(news):
        rows = news.withColumn("fresh", F.lit(True))
        if rounds:
            old = known.join(news.select(*mine).distinct(), mine, "left_semi")
            rows = rows.unionByName(old.withColumn("fresh", F.lit(False)))
        runs = news.select(*dict.fromkeys([*home, *by])).distinct().groupBy(*home).agg(
            F.ceil(F.count(F.lit(1)) / BLOCK_RUNS).alias("_deal"))
        links = packed.join(runs, home)
        if len(by) > len(edge_by):
            rows = rows.join(runs, home).withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_deal"))).drop("_deal")
            links = links.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deal") - 1)))
        else:
            rows, links = rows.withColumn("_part", F.lit(0)), links.withColumn("_part", F.lit(0))
        task = [*home, "_part"]
        found = cut(rows.groupBy(*task).cogroup(links.select(*task, "links", "gates").groupBy(*task)).applyInArrow(solve, schema))
        inside = found.where("inside").select(*keys, "_block", "value")
        known = inside if not rounds else known.unionByName(inside)
        gate = found.where("inside AND gate").select(*keys, F.col("value").alias("_old"))
        have = (gate if not rounds else have.unionByName(gate)).groupBy(*keys).agg(F.min("_old").alias("_old"))
        rounds += 1
        if rounds % MERGE == 0:
            known = cut(known.groupBy(*keys, "_block").agg(F.min("value").alias("value")))
        sent = found.where("NOT inside").groupBy(*keys, "_block").agg(F.min("value").alias("value"))
        have = cut(have)
        news = cut(sent.join(have, keys, "left").where("_old IS NULL OR value < _old").select(*keys, "_block", "value"))
    return known.groupBy(*keys).agg(F.min("value").alias(value))


def _solver(by: list[str], cutoff: float | str | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search inside one block: what became better there, and what leaves it."""
    def solve(rows: pa.Table, links: pa.Table) -> pa.Table:
        names = [*by, "node", "_block", "value"]
        types = [rows.schema.field(c).type for c in names] + [pa.bool_(), pa.bool_()]
        out: list[list] = [[] for _ in types]
        ways, gates = defaultdict(list), set()
        if links.num_rows and rows.num_rows:
            pairs = links.column("links").combine_chunks().flatten()
            gates.update(links.column("gates").combine_chunks().flatten().to_pylist())
            for s, d, w, b in zip(*[pairs.field(i).to_pylist() for i in range(4)], strict=True):
                ways[s].append((d, w, b))
        runs = defaultdict(lambda: ({}, []))
        columns = [rows.column(c).to_pylist() for c in (*by, "node", "value", "fresh")]
        for *run, node, cost, fresh in zip(*columns, strict=True):
            known, news = runs[tuple(run)]
            if fresh:
                news.append((cost, node))
            elif cost < known.get(node, math.inf):
                known[node] = cost
        block = rows.column("_block")[0].as_py() if rows.num_rows else None
        for run, (known, news) in runs.items():
            limit = math.inf if cutoff is None else run[by.index(cutoff)] if isinstance(cutoff, str) else cutoff
            heap = [(c, n) for c, n in news if c < known.get(n, math.inf)]
            known.update((n, c) for c, n in heap)
            heapq.heapify(heap)
            nodes, costs, sent = [], [], {}
            while heap:
                cost, node = heapq.heappop(heap)
                if cost > known[node]:
                    continue
                nodes.append(node)
                costs.append(cost)
                for to, w, where in ways.get(node, ()):
                    far = cost + w
                    if far > limit:
                        continue
                    if where != block:
                        if far < sent.get(to, (math.inf,))[0]:
                            sent[to] = far, where
                    elif far < known.get(to, math.inf):
                        known[to] = far
                        heapq.heappush(heap, (far, to))
            n, m = len(nodes), len(sent)
            for column, one in zip(out, run):
                column.extend([one] * (n + m))
            for column, more in zip(out[len(by):], (
                    [*nodes, *sent], [block] * n + [w for _, w in sent.values()],
                    [*costs, *[c for c, _ in sent.values()]], [True] * n + [False] * m,
                    [*map(gates.__contains__, nodes), *[False] * m])):
                column.extend(more)
        return pa.table([pa.array(v, t) for v, t in zip(out, types)], names=[*names, "inside", "gate"])
    return solve


def nearest(edges: DataFrame, starts: DataFrame, k: int, *, by: Sequence[str] = (), slack: float = 0.0,
            weight: str = "time") -> DataFrame:
    """``by..., node, source, cost``: the ``k`` nearest starts of every node, and all others up to ``slack`` behind the k-th;
    see :func:`traversal.nearest_sources`. Rounds are those of :func:`shortest`."""
    by = list(by)
    home, keys, spot = [*by, "_block"], [*by, "node", "source"], [*by, "node"]
    squares, packed = _packed(edges, by, weight)
    first = starts.select(*by, F.col("node").cast(dict(edges.dtypes)["src"]).alias("node")).distinct().select(
        *by, "node", F.col("node").alias("source"), F.lit(0.0).alias("value"))
    news = cut(_housed(first, squares, "node", "_block").select(*keys, "_block", "value"))
    schema = news.withColumns({"inside": F.lit(True), "gate": F.lit(True)}).schema
    solve = _nearest_solver(by, k, slack)
    whole, order = Window.partitionBy(*spot), Window.partitionBy(*spot).orderBy("value", "source")

    def close(labels: DataFrame) -> DataFrame:
        # The last sums differ in the last digits by the way they were added up.
        ranked = labels.withColumn("_near", F.when(F.row_number().over(order) <= k, F.col("value")))
        return ranked.withColumn("_far", F.max("_near").over(whole)).where(
            F.col("value") <= F.col("_far") * (1 + 1e-9) + slack).drop("_near", "_far")

    known, have, rounds = news.limit(0), news.limit(0), 0
    while not is_empty(news):
        rows, touched = news.withColumn("fresh", F.lit(True)), news.select(*home).distinct()
        if rounds:
            rows = rows.unionByName(known.join(touched, home, "left_semi").withColumn("fresh", F.lit(False)))
        links = packed.join(touched, home, "left_semi")
        found = cut(rows.groupBy(*home).cogroup(links.groupBy(*home)).applyInArrow(solve, schema))
        inside = found.where("inside").select(*keys, "_block", "value")
        known = inside if not rounds else known.unionByName(inside)
        gate = found.where("inside AND gate").select(*keys, F.col("value").alias("_old"))
        have = cut((gate if not rounds else have.unionByName(gate)).groupBy(*keys).agg(F.min("_old").alias("_old")))
        rounds += 1
        if rounds % MERGE == 0:
            known = cut(known.groupBy(*keys, "_block").agg(F.min("value").alias("value")))
        sent = found.where("NOT inside").groupBy(*keys, "_block").agg(F.min("value").alias("_sent"))
        # Labels at a gate that are too far there are too far wherever they would be handed on to.
        both = have.join(sent.select(*spot).distinct(), spot, "left_semi").join(sent, keys, "full").withColumn(
            "value", F.least("_old", "_sent"))
        news = cut(close(both).where("_sent IS NOT NULL AND (_old IS NULL OR _sent < _old)").select(*keys, "_block", "value"))
    return close(known.groupBy(*keys).agg(F.min("value").alias("value"))).select(*keys, F.col("value").alias("cost"))


def _nearest_solver(by: list[str], k: int, slack: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search for the nearest sources inside one block: labels that became better there, and those that leave it."""
    def solve(rows: pa.Table, links: pa.Table) -> pa.Table:
        names = [*by, "node", "source", "_block", "value"]
        types = [rows.schema.field(c).type for c in names] + [pa.bool_(), pa.bool_()]
        ways, gates, labels, heap = defaultdict(list), set(), defaultdict(dict), []
        if links.num_rows and rows.num_rows:
            pairs = links.column("links").combine_chunks().flatten()
            gates.update(links.column("gates").combine_chunks().flatten().to_pylist())
            for s, d, w, b in zip(*[pairs.field(i).to_pylist() for i in range(4)], strict=True):
                ways[s].append((d, w, b))

        def better(node, source, cost):
            mine = labels[node]
            if cost >= mine.get(source, math.inf):
                return False
            rest = sorted(c for s, c in mine.items() if s != source)
            if len(rest) >= k and cost > rest[k - 1] * (1 + 1e-9) + slack:
                return False
            mine[source] = cost
            return True

        columns = [rows.column(c).to_pylist() for c in ("node", "source", "value", "fresh")]
        news = []
        for node, source, cost, fresh in zip(*columns, strict=True):
            if fresh:
                news.append((cost, node, source))
            elif cost < labels[node].get(source, math.inf):
                labels[node][source] = cost
        heap = [n for n in sorted(news) if better(n[1], n[2], n[0])]
        block = rows.column("_block")[0].as_py() if rows.num_rows else None
        nodes, sources, costs, sent = [], [], [], {}
        while heap:
            cost, node, source = heapq.heappop(heap)
            mine = labels[node]
            if cost > mine[source]:
                continue
            near = sorted(mine.values())
            if len(near) >= k and cost > near[k - 1] * (1 + 1e-9) + slack:
                continue
            nodes.append(node)
            sources.append(source)
            costs.append(cost)
            for to, w, where in ways.get(node, ()):
                far = cost + w
                if where != block:
                    if far < sent.get((to, source), (math.inf,))[0]:
                        sent[to, source] = far, where
                elif better(to, source, far):
                    heapq.heappush(heap, (far, to, source))
        n, m = len(nodes), len(sent)
        out = [*[[rows.column(c)[0].as_py()] * (n + m) for c in by if n + m], *([] if n + m else [[] for _ in by])]
        out += [[*nodes, *[t for t, _ in sent]], [*sources, *[s for _, s in sent]], [block] * n + [w for _, w in sent.values()],
                [*costs, *[c for c, _ in sent.values()]], [True] * n + [False] * m,
                [*map(gates.__contains__, nodes), *[False] * m]]
        return pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=[*names, "inside", "gate"])
    return solve


def contracted(pairs: DataFrame, by: Sequence[str] = (), a: str = "src", b: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Undirected pairs with the pieces inside every block merged: ``by..., node, root``, each node with the smallest node
    of its piece, and ``by..., src, dst``, the distinct links between pieces of different blocks."""
    by = list(by)
    ends = pairs.select(*by, F.col(a).alias("src"), F.col(b).alias("dst"))
    squares = _squares(ends, by)
    net = cut(_housed(_housed(ends, squares, "src", "_block"), squares, "dst", "_next"))
    # A link that leaves its block is here for the sake of its ends: a loop at each.
    cross = F.col("_block") != F.col("_next")
    loops = [net.where(cross).select(*by, F.col(e).alias("src"), F.col(e).alias("dst"), F.col(h).alias("_block"))
             for e, h in (("src", "_block"), ("dst", "_next"))]
    own = net.where(~cross).select(*by, "src", "dst", "_block").unionByName(loops[0]).unionByName(loops[1]).distinct()
    schema = own.select(*by, F.col("src").alias("node"), F.col("dst").alias("root")).schema
    roots = cut(own.groupBy(*by, "_block").applyInArrow(_merger(by), schema))
    links = net.where(cross).select(*by, "src", "dst")
    for end in ("src", "dst"):
        links = links.join(roots.withColumnsRenamed({"node": end, "root": "_" + end}), [*by, end])
    return roots, links.select(*by, F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def _merger(by: list[str]) -> Callable[[pa.Table], pa.Table]:
    def merge(rows: pa.Table) -> pa.Table:
        up: dict = {}

        def top(n):
            while up.setdefault(n, n) != n:
                up[n] = n = up[up[n]]
            return n
        for s, d in zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True):
            low, high = sorted((top(s), top(d)))
            up[high] = low
        kind = rows.schema.field("src").type
        nodes = pa.array(list(up), kind)
        run = [pa.repeat(rows.column(c)[0], len(up)) for c in by]
        return pa.table([*run, nodes, pa.array([top(n) for n in list(up)], kind)], names=[*by, "node", "root"])
    return merge


def strongly_contracted(edges: DataFrame, by: Sequence[str] = (), whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Directed edges with the strongly connected pieces inside every block merged: ``by..., node, root``, each node with the
    smallest node of its piece, and ``by..., src, dst``, the distinct links between pieces on ways through their blocks.
    Others are components already: a cycle that leaves a block comes in and goes out. ``whole``: all edges are one block."""
    by, kind = list(by), dict(edges.dtypes)["src"]
    ends = edges.select(*by, "src", F.col("dst").cast(kind).alias("dst"))
    if whole:
        net = ends.withColumns({"_block": F.lit(0), "_next": F.lit(0)})
    else:
        squares = _squares(ends, by)
        net = cut(_housed(_housed(ends, squares, "src", "_block"), squares, "dst", "_next"))
    cross, none = F.col("_block") != F.col("_next"), F.lit(None).cast(kind)
    # A link that leaves its block is half a link on both sides.
    out = net.where(cross).select(*by, "src", none.alias("dst"), "_block").distinct()
    into = net.where(cross).select(*by, none.alias("src"), "dst", F.col("_next").alias("_block")).distinct()
    own = net.where(~cross).select(*by, "src", "dst", "_block").unionByName(out).unionByName(into)
    schema = own.select(*by, "src", "dst").withColumns({"link": F.lit(True), "through": F.lit(True)}).schema
    found = cut(own.groupBy(*by, "_block").applyInArrow(_strong(by), schema))
    roots = found.where("NOT link").select(*by, F.col("src").alias("node"), F.col("dst").alias("root"), "through")
    links = net.where(cross).select(*by, "src", "dst")
    for end in ("src", "dst"):
        links = links.join(roots.where("through").select(*by, F.col("node").alias(end), F.col("root").alias("_" + end)), [*by, end])
    links = links.select(*by, F.col("_src").alias("src"), F.col("_dst").alias("dst")).unionByName(
        found.where("link").select(*by, "src", "dst"))
    return roots.drop("through"), links.distinct()


def _strong(by: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Strongly connected pieces inside one block (Tarjan), and the links between those on a way from outside to outside."""
    def pieces(rows: pa.Table) -> pa.Table:
        number: dict = {}
        ways: list[list[int]] = []
        ins, outs = set(), set()

        def at(node):
            if (i := number.setdefault(node, len(ways))) == len(ways):
                ways.append([])
            return i
        for s, d in zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True):
            if d is None:
                outs.add(at(s))
            elif s is None:
                ins.add(at(d))
            else:
                ways[at(s)].append(at(d))
        names, n = list(number), len(ways)
        seen, low, piece, stack, found, clock = [0] * n, [0] * n, [-1] * n, [], [], 0
        for first in range(n):
            work = [] if seen[first] else [(first, iter(ways[first]))]
            if work:
                clock += 1
                seen[first] = low[first] = clock
                stack.append(first)
            while work:
                v, more = work[-1]
                for d in more:
                    if not seen[d]:
                        clock += 1
                        seen[d] = low[d] = clock
                        stack.append(d)
                        work.append((d, iter(ways[d])))
                        break
                    if piece[d] < 0 and seen[d] < low[v]:
                        low[v] = seen[d]
                else:
                    work.pop()
                    if work and low[v] < low[work[-1][0]]:
                        low[work[-1][0]] = low[v]
                    if low[v] == seen[v]:
                        end = len(stack) - 1
                        while stack[end] != v:
                            end -= 1
                        for m in stack[end:]:
                            piece[m] = len(found)
                        found.append(stack[end:])
                        del stack[end:]
        # Pieces are found after all that they lead to.
        leaves, comes = [False] * len(found), [False] * len(found)
        for i, nodes in enumerate(found):
            leaves[i] = any(m in outs or any(leaves[piece[d]] for d in ways[m]) for m in nodes)
        for i in range(len(found) - 1, -1, -1):
            comes[i] = comes[i] or any(m in ins for m in found[i])
            if comes[i]:
                for m in found[i]:
                    for d in ways[m]:
                        comes[piece[d]] = True
        root = [min(names[m] for m in nodes) for nodes in found]
        through = [a and b for a, b in zip(leaves, comes, strict=True)]
        links = list({(piece[s], piece[d]) for s in range(n) if through[piece[s]] for d in ways[s]
                      if piece[d] != piece[s] and through[piece[d]]})
        kind, k = rows.schema.field("src").type, len(links)
        columns = [pa.array([*names, *[root[a] for a, _ in links]], kind),
                   pa.array([*[root[p] for p in piece], *[root[b] for _, b in links]], kind),
                   pa.array([False] * n + [True] * k), pa.array([*[through[p] for p in piece], *[True] * k])]
        return pa.table([*[pa.repeat(rows.column(c)[0], n + k) for c in by], *columns], names=[*by, "src", "dst", "link", "through"])
    return pieces
