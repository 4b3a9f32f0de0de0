"""Areas of overlaid shapes of any form, by a plane sweep spread over grid cells.

Edges are cut along a grid: to a column of cells exactly, and in it to every cell from their own up to the top of
their shape, where the part of an edge below a cell lies on the cell's lower border. So each (group, cell) is a
problem of its own: in it the edges below a point, added up with their direction, tell how many shapes of a layer
cover the point. Equal pieces of many shapes are added up into one before anything else, which turns a stack of shapes
that fill a cell into one border. A cell with more than ``CELL_EDGES`` pieces is cut finer, again and again.

In a cell, a slab sits between neighbouring end and crossing positions. Inside it no edges cross, so they have an
order from bottom to top, and the area between two neighbours is a trapezoid: its height in the middle times the width
of the slab. The pieces of a cell are one row and its slabs are summed in arrays: as rows, pieces in slabs would be some
hundred times the pieces. Groups and cells of any number meet in the same jobs.

Outer rings run counter-clockwise and holes clockwise, as everywhere in this package.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as g
from ..functions.scalars import clamp
from ..session import is_empty, written
from .gridjoin import box_pairs

#: Pieces of edges that one cell may hold before it is cut finer.
CELL_EDGES = 512
#: A cell is cut into so many parts a side.
FINER = 4
#: Pieces at one spot that no grid can part stay together after so many cuts.
MOST_CUTS = 8
#: Corners of a group that is grown and summed in its own row.
ROW_CORNERS = 32
#: Pieces in slabs, or pairs of pieces, that a task holds at a time.
BLOCK = 1_000_000
#: Bounds of the shape that others are laid over.
WINDOW = ["_wx0", "_wy0", "_wx1", "_wy1"]
_PIECE = ["_layer", "x0", "y0", "x1", "y1"]


def _values(rings: str, coordinate: str) -> Column:
    return F.transform(F.flatten(F.col(rings)), lambda v: v[coordinate])


def _edges(shapes: DataFrame, key: Sequence[str], rings: str, layer: Column, window: Sequence[str] = ()) -> DataFrame:
    """Edges from left to right; ``w`` is 1 where the shape lies above. Upright ones bound no slab. Edges beside or
    above the ``window`` bound nothing in it."""
    e = shapes.select(*key, layer.cast("int").alias("_layer"), F.array_max(_values(rings, "y")).alias("top"),
                      *window, F.explode(g.all_edges(rings)).alias("e"))
    a, b = F.col("e")["a"], F.col("e")["b"]
    if window:
        e = e.where((F.greatest(a["x"], b["x"]) >= F.col(window[0])) & (F.least(a["x"], b["x"]) <= F.col(window[2]))
                    & (F.least(a["y"], b["y"]) <= F.col(window[3])))
    right = a["x"] < b["x"]
    return e.where(a["x"] != b["x"]).select(
        *key, "_layer", "top", F.lit(None).cast("long").alias("last"), F.when(right, 1).otherwise(-1).cast("long").alias("w"),
        *[F.when(right, p[c]).otherwise(q[c]).alias(f"{c}{i}") for i, (p, q) in enumerate(((a, b), (b, a))) for c in "xy"])


def _at(x: Column, piece: str = "") -> Column:
    """Height of a piece at ``x``, exact at its ends."""
    x0, y0, x1, y1 = (F.col(piece + c) for c in ("x0", "y0", "x1", "y1"))
    return F.when(x == x0, y0).when(x == x1, y1).otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))


def _cells(low: Column, high: Column, size: Column) -> Column:
    """Numbers of the cells that a range meets."""
    first = F.floor(low / size).cast("long")
    return F.explode(F.sequence(first, F.greatest(first, (F.ceil(high / size) - 1).cast("long"))))


def _cut(edges: DataFrame, key: Sequence[str], size: float) -> DataFrame:
    """Pieces of edges in cells of ``size``, equal ones added up. ``top`` is where an edge's effect ends, ``last`` the
    last row of cells that it may be put into."""
    s = F.lit(size)
    e = edges.withColumn("cx", _cells(F.col("x0"), F.col("x1"), s))
    left, right = F.greatest("x0", F.col("cx") * s), F.least("x1", (F.col("cx") + 1) * s)
    e = e.select(*key, "cx", "_layer", "w", "top", "last", left.alias("_l"), right.alias("_r"), _at(left).alias("_yl"),
                 _at(right).alias("_yr")).where("_r > _l")
    # The same last row for all edges of a shape: an upper edge on a border belongs to no cell above it.
    e = e.withColumn("last", F.coalesce("last", (F.ceil(F.col("top") / s) - 1).cast("long")))
    e = e.withColumn("cy", _cells(F.least("_yl", "_yr"), F.col("top"), s)).where("cy <= last")
    bottom, ceiling = F.col("cy") * s, (F.col("cy") + 1) * s
    slope = (F.col("_yr") - F.col("_yl")) / (F.col("_r") - F.col("_l"))

    def meets(level: Column) -> Column:
        x = F.when(slope != 0, F.col("_l") + (level - F.col("_yl")) / slope).otherwise(F.col("_l"))
        return F.greatest("_l", F.least("_r", x))

    e = e.withColumns({"_s": slope, "_p": F.least(meets(bottom), meets(ceiling)), "_q": F.greatest(meets(bottom), meets(ceiling))})

    def height(x: Column) -> Column:
        return F.when(x == F.col("_r"), F.col("_yr")).otherwise(F.col("_yl") + (x - F.col("_l")) * F.col("_s"))

    def part(a: str, b: str) -> Column:
        """The part from a to b: inside the cell, or as a whole below or above it."""
        x, z = F.col(a), F.col(b)
        middle = height((x + z) / 2)
        y = [F.when(middle <= bottom, bottom).otherwise(F.greatest(bottom, F.least(ceiling, height(v)))) for v in (x, z)]
        return F.struct(x.alias("x0"), y[0].alias("y0"), z.alias("x1"), y[1].alias("y1"), (middle < ceiling).alias("counts"))

    parts = F.explode(F.array(part("_l", "_p"), part("_p", "_q"), part("_q", "_r")))
    e = e.select(*key, "cx", "cy", "_layer", "w", parts.alias("e")).select(*key, "cx", "cy", "_layer", "w", "e.*")
    # What lies above or on the upper border bounds nothing in this cell.
    e = e.where("x1 > x0 AND counts")
    return e.groupBy(*key, "cx", "cy", *_PIECE).agg(F.sum("w").alias("w")).where("w <> 0").withColumn("size", s)


def _pieces(edges: DataFrame, key: Sequence[str], size: float, cell_edges: int) -> DataFrame:
    slot, kept, cuts = [*key, "cx", "cy"], None, 0
    while True:
        cut = written(_cut(edges, key, size))
        full = written(cut.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_edges).drop("n"))
        last = cuts == MOST_CUTS or not full.limit(1).count()
        # Tables of pieces are small as files and large as rows: none is broadcast.
        full = full.hint("merge")
        fine = cut if last else cut.join(full, slot, "left_anti")
        kept = fine if kept is None else kept.unionByName(fine)
        if last:
            return kept
        edges = cut.join(full, slot, "left_semi").withColumns({
            "top": (F.col("cy") + 1) * F.col("size"), "last": FINER * (F.col("cy") + 1) - 1}).drop("cx", "cy", "size")
        size, cuts = size / FINER, cuts + 1


def cell_size(shapes: DataFrame, rings: str) -> float:
    """Side of a cell from one aggregation: about twice the mean extent of a shape, less for shapes of many edges. A power
    of two, so that cell borders, also of finer cells, are exact numbers."""
    spread = [F.array_max(_values(rings, c)) - F.array_min(_values(rings, c)) for c in "xy"]
    extent, edges = shapes.agg(F.avg(F.greatest(*spread)), F.avg(F.size(F.flatten(F.col(rings))))).head()
    side = 2.0 * float(extent or 1.0) / max(1.0, (float(edges or 1.0) / 64.0) ** 0.5)
    return 2.0 ** math.ceil(math.log2(max(side, 1e-6)))


def _heights(c: np.ndarray, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As :func:`_at`, for pieces ``i`` of the columns x0, y0, x1, y1."""
    x0, y0, x1, y1 = c[:, i]
    return np.where(x == x0, y0, np.where(x == x1, y1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))))


def _crossings(c: np.ndarray) -> Iterator[np.ndarray]:
    """Where two pieces cross, block by block of pairs whose bounds meet."""
    c = c[:, np.argsort(c[0], kind="stable")]
    n = np.maximum(np.searchsorted(c[0], c[2]) - np.arange(1, c.shape[1] + 1), 0)
    bottom, top = np.minimum(c[1], c[3]), np.maximum(c[1], c[3])
    for a, b in _blocks(n):
        i = np.repeat(np.arange(a, b), n[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        meet = (bottom[i] <= top[j]) & (bottom[j] <= top[i])
        i, j = i[meet], j[meet]
        low, high = c[0, j], np.minimum(c[2, i], c[2, j])
        before = _heights(c, i, low) - _heights(c, j, low)
        after = _heights(c, i, high) - _heights(c, j, high)
        cross = before * after < 0
        yield low[cross] + (high[cross] - low[cross]) * (before[cross] / (before[cross] - after[cross]))


def _blocks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of positions that hold about ``BLOCK`` of the ``n`` things at each."""
    starts = np.flatnonzero(np.diff(np.cumsum(n) // BLOCK, prepend=-1))
    return zip(starts, [*starts[1:], len(n)], strict=True)


def _cell_areas(layer: np.ndarray, c: np.ndarray, w: np.ndarray, top: float) -> np.ndarray:
    """Areas in one cell: first layer, second layer, both. ``c`` holds the columns x0, y0, x1, y1."""
    order = np.lexsort((c[3], c[2], c[1], c[0], layer))
    layer, c, w = layer[order], c[:, order], w[order]
    xs = np.unique(np.concatenate([c[0], c[2], *_crossings(c)]))
    first, last = np.searchsorted(xs, c[0]), np.searchsorted(xs, c[2])
    # Pieces in each slab, and slabs in blocks of so many of them.
    meets = np.cumsum(np.bincount(first, minlength=len(xs)) - np.bincount(last, minlength=len(xs)))[:-1]
    total = np.zeros(3)
    for low, high in _blocks(meets):
        begin = np.maximum(first, low)
        n = np.maximum(np.minimum(last, high) - begin, 0)
        piece = np.repeat(np.arange(len(n)), n)
        slab = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n - begin, n)
        y = _heights(c, piece, (xs[slab] + xs[slab + 1]) / 2)
        order = np.lexsort((y, slab))
        piece, slab, y = piece[order], slab[order], y[order]
        new = np.diff(slab, prepend=-1) != 0
        begin = np.maximum.accumulate(np.where(new, np.arange(len(slab)), 0))
        over = []
        for i in (0, 1):
            v = np.where(layer[piece] == i, w[piece], 0)
            run = np.cumsum(v)
            over.append(run - (run - v)[begin] > 0)
        above = np.where(np.append(new[1:], True), top, np.append(y[1:], top))
        area = (xs[slab + 1] - xs[slab]) * (above - y)
        total += [area[m].sum() for m in (over[0], over[1], over[0] & over[1])]
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pieces`` and ``top`` of cells to their three areas; the other columns stay. A cell that holds whole shapes has
    no top, one without pieces no areas."""
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("pieces")), 0))
        lists = batch.column("pieces")
        flat, ends, tops = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), batch.column("top").to_numpy(
            zero_copy_only=False)
        layer, *at, w = (flat.field(n).to_numpy(zero_copy_only=False) for n in (*_PIECE, "w"))
        c = np.array(at, dtype=float)
        out = np.array([_cell_areas(layer[a:b], c[:, a:b], w[a:b], c[1::2, a:b].max() if np.isnan(top) else top) for a, b, top in zip(
            ends[:-1], ends[1:], tops, strict=True)], dtype=float).reshape(-1, 3)
        keys = [n for n in batch.schema.names if n not in ("pieces", "top")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keys), *(pa.array(x) for x in out.T)],
                                         names=[*keys, "_first", "_second", "_both"])


def _sums_schema(cells: DataFrame, key: Sequence[str]) -> StructType:
    out = StructType(list(cells.select(*key).schema.fields))
    for n in ("_first", "_second", "_both"):
        out = out.add(n, "double")
    return out


def overlay_areas(shapes: DataFrame, key: Sequence[str], rings: str = "rings", layer: str | None = None, *,
                  window: Sequence[str] = (), cell: float | None = None, cell_edges: int = CELL_EDGES) -> DataFrame:
    """Areas covered in each group of ``shapes``: ``area_first`` (by the shapes of layer 0), ``area_second`` (layer 1)
    and ``area_both``. Without ``layer`` all shapes are in layer 0. Overlaps inside a layer count once. ``window`` names
    columns with bounds of the group's first layer: only its area and the common one are then whole."""
    for k in key:
        shapes = shapes.where(F.col(k).isNotNull())
    edges = _edges(shapes, key, rings, F.lit(0) if layer is None else F.col(layer), window)
    pieces = _pieces(edges, key, cell or cell_size(shapes, rings), cell_edges)
    cells = pieces.groupBy(*key, "cx", "cy", "size").agg(F.collect_list(F.struct(*_PIECE, "w")).alias("pieces")).select(
        *key, ((F.col("cy") + 1) * F.col("size")).alias("top"), "pieces")
    sums = cells.mapInArrow(_sums, _sums_schema(cells, key))
    # A millionth of a square metre is below the noise of sums of slabs.
    return sums.groupBy(*key).agg(*[F.round(F.sum("_" + n), 6).alias("area_" + n) for n in ("first", "second", "both")])


def union_area(shapes: DataFrame, key: Sequence[str], rings: str = "rings", name: str = "area", **kw) -> DataFrame:
    """Area of the union of each group's shapes."""
    return overlay_areas(shapes, key, rings, **kw).select(*key, F.col("area_first").alias(name))


def covered_areas(left: DataFrame, right: DataFrame, left_box, right_box, key: Sequence[str], rings: tuple[str, str], *,
                  group: Sequence[str] = (), condition: Column | None = None, **kw) -> DataFrame:
    """``key`` (of the left rows) and ``group`` (columns of the right rows) with ``area``, how much of the left shape
    the union of the group's right shapes covers. Pairs without common area are absent, and so are null keys."""
    pairs = written(box_pairs(left, right, left_box, right_box, condition=condition).select(
        *key, *group, F.col(rings[0]).alias("_own"), F.col(rings[1]).alias("_other"), *_bounds(rings[0])))
    own = pairs.groupBy(*key, *group).agg(*[F.first(c).alias(c) for c in ("_own", *WINDOW)])
    return shared_areas(own, pairs, [*key, *group], **kw)


def _bounds(rings: str) -> list[Column]:
    return [f(_values(rings, c)).alias(n) for n, f, c in zip(
        WINDOW, (F.array_min, F.array_min, F.array_max, F.array_max), "xyxy", strict=True)]


def shared_areas(own: DataFrame, other: DataFrame, key: Sequence[str], **kw) -> DataFrame:
    """``area`` that the ``_other`` shapes of a key cover of its ``_own`` one, whose bounds are in ``WINDOW`` on both
    sides. Keys without common area are absent."""
    sides = own.select(*key, F.col("_own").alias("_rings"), F.lit(0).alias("_side"), *WINDOW).unionByName(
        other.select(*key, F.col("_other").alias("_rings"), F.lit(1).alias("_side"), *WINDOW))
    return overlay_areas(sides, key, "_rings", "_side", window=WINDOW, **kw).where("area_both > 0").select(
        *key, F.col("area_both").alias("area"))


def overlay_fraction(left: DataFrame, right: DataFrame, left_box, right_box, key: Sequence[str],
                     rings: tuple[str, str], **kw) -> DataFrame:
    """Share of each left shape that the union of the right shapes covers, in 0..1."""
    covered = covered_areas(left, right, left_box, right_box, key, rings, **kw)
    own = left.select(*key, g.area(rings[0]).alias("_whole"))
    return own.join(covered.hint("merge"), list(key), "left").select(*key, F.when(F.col("_whole") > 0, clamp(
        F.coalesce("area", F.lit(0.0)) / F.col("_whole"), 0.0, 1.0)).otherwise(F.lit(0.0)).alias("fraction"))


def _grown(rings: str | Column, d: Column, quarter_segments: int) -> Column:
    """The shapes whose union is a shape grown by ``d``, as an array: itself, a strip along each edge, a disc at each corner."""
    whole = F.col(rings) if isinstance(rings, str) else rings

    def strip(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        k = d / F.hypot(dx, dy)
        corners = [(e["a"], 1), (e["b"], 1), (e["b"], -1), (e["a"], -1), (e["a"], 1)]
        return F.array(F.array(*[g.vertex(p["x"] + side * dy * k, p["y"] - side * dx * k) for p, side in corners]))

    edges = F.filter(g.all_edges(rings), lambda e: e["a"] != e["b"])
    return F.when(d > 0, F.concat(F.array(whole), F.transform(edges, strip), F.transform(
        edges, lambda e: g.disc_rings(e["a"]["x"], e["a"]["y"], d, quarter_segments)))).otherwise(F.array(whole))


def buffer_shapes(shapes: DataFrame, rings: str, distance: Column | float, quarter_segments: int = 16) -> DataFrame:
    """A row for each of the shapes whose union is the shape grown by ``distance``: itself, a strip along each edge and
    a disc at each corner. ``rings`` now holds that part, ``minx .. maxy`` its bounds; other columns stay."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    # A small file of shapes is one task, and each shape becomes some hundred times its size.
    out = shapes.repartition(_tasks(shapes)).withColumn(rings, F.explode(_grown(rings, d, quarter_segments)))
    return out.withColumns({n + c: f(_values(rings, c)) for n, f in (("min", F.array_min), ("max", F.array_max))
                            for c in "xy"})


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buffer_areas(shapes: DataFrame, key: Sequence[str], rings: str, distance: Column | float, name: str = "area",
                 quarter_segments: int = 16) -> DataFrame:
    """Area of the union of each group's shapes, grown by ``distance``. Groups of up to ``ROW_CORNERS`` corners are
    grown and summed where they are, so that edges of discs are not shuffled; others go through the grid."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    shapes = shapes.select(*key, F.col(rings).alias("_rings"), d.cast("double").alias("_d"))
    for k in key:
        shapes = shapes.where(F.col(k).isNotNull())
    sizes = written(shapes.groupBy(*key).agg(F.sum(F.size(F.flatten("_rings"))).alias("_n")))
    big = sizes.where(F.col("_n") > ROW_CORNERS).select(*key)
    some, rows = not is_empty(big), sizes.count()
    small = shapes.join(big.hint("merge"), list(key), "left_anti") if some else shapes
    # A group's pieces take some ten kilobytes: tasks of a thousand groups keep batches small.
    small = small.groupBy(*key).agg(F.collect_list(F.struct("_rings", "_d")).alias("_s")).repartition(
        max(_tasks(shapes), -(-rows // 1000)))
    pieces = F.flatten(F.transform("_s", lambda s: F.flatten(F.transform(
        _grown(s["_rings"], s["_d"], quarter_segments), lambda part: _row_pieces(part)))))
    cells = small.select(*key, F.lit(None).cast("double").alias("top"), pieces.alias("pieces"))
    out = cells.mapInArrow(_sums, _sums_schema(cells, key)).select(*key, F.round("_first", 6).alias(name))
    if not some:
        return out
    grown = buffer_shapes(shapes.join(big.hint("merge"), list(key), "left_semi"), "_rings", F.col("_d"), quarter_segments)
    return out.unionByName(union_area(grown, key, "_rings", name))


def _row_pieces(part: Column) -> Column:
    """The edges of :func:`_edges` as an array."""
    def piece(e: Column) -> Column:
        a, b = e["a"], e["b"]
        right = a["x"] < b["x"]
        ends = [F.when(right, p[c]).otherwise(q[c]).alias(f"{c}{i}") for i, (p, q) in enumerate(((a, b), (b, a))) for c in "xy"]
        return F.struct(F.lit(0).alias("_layer"), *ends, F.when(right, 1).otherwise(-1).cast("long").alias("w"))
    return F.transform(F.filter(g.all_edges(part), lambda e: e["a"]["x"] != e["b"]["x"]), piece)
