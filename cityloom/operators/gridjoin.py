"""Spatial joins as equi-joins on grid cells.

Both sides are spread over the cells their bounds touch, joined on the cell, and a pair
is kept only in the one cell that owns the lower-left corner of the shared bounds, so no
``distinct`` follows. Very unequal sizes use coarser levels (cell times 8 per level), so
an object never touches more than four cells. A cell with too many rows is split into a
grid of salts: left rows go to one salt row, right rows to one salt column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = Sequence[str]

LEVEL_FACTOR = 8
# Rows of one side in one cell that a single task may handle.
CELL_ROWS = 500_000
# Up to so many rows on both sides Spark may broadcast one. Above, both are shuffled: Spark judges by the bytes of the
# files read, and shapes, cells and long text made of small files can be a hundred times as large.
BROADCAST_ROWS = 100_000
# Rows of both sides, before they are spread over cells, for each task of a large join: shapes are sorted in memory.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Grid:
    """Cell size and the object levels found on each side."""

    cell: float
    left_levels: tuple[int, ...] = (0,)
    right_levels: tuple[int, ...] = (0,)
    rows: int = 0


def _extent(box: Box, margin: Column) -> Column:
    return (F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]))
            + margin * 2)


def _exponent(extent: Column) -> Column:
    return F.ceil(F.log2(F.greatest(extent, F.lit(1e-6)))).cast("int")


def measure(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box,
            margin: Column) -> Grid:
    """One small aggregation over both sides: typical size, sizes present, row count."""
    zero = F.lit(0.0)
    sizes = (left.select(F.lit(0).alias("s"), _exponent(_extent(left_box, margin)).alias("e"))
             .unionByName(right.select(F.lit(1).alias("s"),
                                       _exponent(_extent(right_box, zero)).alias("e"))))
    rows = sizes.groupBy("s", "e").count().collect()  # at most ~60 sizes per side
    if not rows:
        return Grid(1.0)

    def p95(side: int) -> int:
        counts = sorted((r["e"], r["count"]) for r in rows if r["s"] == side)
        total, seen = sum(c for _, c in counts), 0
        for e, c in counts:
            seen += c
            if seen >= 0.95 * total:
                return e
        return -20

    base = max(p95(0), p95(1))
    step = int(math.log2(LEVEL_FACTOR))

    def levels(side: int) -> tuple[int, ...]:
        found = {max(0, -((base - r["e"]) // step)) for r in rows if r["s"] == side}
        return tuple(sorted(found)) or (0,)

    return Grid(float(2.0 ** base), levels(0), levels(1), sum(r["count"] for r in rows))


def _place(df: DataFrame, box: Box, margin: Column, grid: Grid, other: tuple[int, ...],
           own: tuple[int, ...], tag: str) -> DataFrame:
    """Add level and cell columns; one row per touched cell and joint level."""
    step = int(math.log2(LEVEL_FACTOR))
    base = int(math.log2(grid.cell))
    point = box[0] == box[2] and box[1] == box[3]
    if own == (0,) and other == (0,):
        df = df.withColumn("_lv", F.lit(0))
    else:
        level = F.greatest(F.lit(0), F.ceil(
            (_exponent(_extent(box, margin)) - base) / step).cast("int"))
        df = df.withColumn("_lv", F.explode(F.array_distinct(F.array(
            *[F.greatest(level, F.lit(o)) for o in other]))))
    size = F.lit(grid.cell) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("_lv"))

    def cell(name: str, delta: Column) -> Column:
        return F.floor((F.col(name) + delta) / size).cast("long")

    df = df.withColumns({f"{tag}cx": cell(box[0], -margin), f"{tag}cy": cell(box[1], -margin)})
    if point and _is_zero(margin):
        return df.withColumns({"_cx": F.col(f"{tag}cx"), "_cy": F.col(f"{tag}cy")})
    return (df.withColumn("_cx", F.explode(F.sequence(F.col(f"{tag}cx"),
                                                      cell(box[2], margin))))
            .withColumn("_cy", F.explode(F.sequence(F.col(f"{tag}cy"),
                                                    cell(box[3], margin)))))


def _is_zero(margin: Column) -> bool:
    return str(margin._jc.toString()) in ("0.0", "0") if hasattr(margin, "_jc") else False


def _salt(left: DataFrame, right: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Split hot cells into salts. The table of hot cells has at most rows / cell_rows
    entries per side, which bounds the broadcast."""
    keys = ["_lv", "_cx", "_cy"]

    def hot(df: DataFrame, name: str) -> DataFrame:
        return (df.groupBy(*keys).count().where(F.col("count") > cell_rows)
                .select(*keys, F.ceil(F.col("count") / cell_rows).cast("int").alias(name)))

    parts = hot(left, "_sl").join(hot(right, "_sr"), keys, "full")
    parts = parts.select(*keys, F.coalesce("_sl", F.lit(1)).alias("_sl"),
                         F.coalesce("_sr", F.lit(1)).alias("_sr"))

    def spread(df: DataFrame, mine: str, theirs: str, a: str, b: str) -> DataFrame:
        df = df.join(F.broadcast(parts), keys, "left")
        draw = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns
                                   if c not in ("_sl", "_sr")]),
                      F.coalesce(F.col(mine), F.lit(1)))
        return (df.withColumn(a, draw.cast("int"))
                .withColumn(b, F.explode(F.sequence(
                    F.lit(0), F.coalesce(F.col(theirs), F.lit(1)) - 1)))
                .drop("_sl", "_sr"))

    return spread(left, "_sl", "_sr", "_a", "_b"), spread(right, "_sr", "_sl", "_b", "_a")


def box_pairs(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, *,
              margin: float | Column = 0.0, condition: Column | None = None,
              on: Sequence[str] = (), grid: Grid | None = None,
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every (left, right) pair whose bounds meet once the left ones grow by ``margin``
    and ``condition`` holds. Column names of the two sides must differ, except for the
    shared key columns ``on`` (for example a run or region), which must be equal."""
    fixed = not isinstance(margin, Column)
    grow = F.lit(float(margin)) if fixed else margin
    spec = grid or measure(left, right, left_box, right_box, grow)
    lefts = _place(left, left_box, grow, spec, spec.right_levels, spec.left_levels, "_l")
    rights = _place(right, right_box, F.lit(0.0), spec, spec.left_levels,
                    spec.right_levels, "_r")
    keys = [*on, "_lv", "_cx", "_cy"]
    if spec.rows > cell_rows:
        lefts, rights = _salt(lefts, rights, cell_rows)
        keys += ["_a", "_b"]
        # By number, which adaptive execution does not merge again: a task stays as small however much data there is.
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(spec.rows / TASK_ROWS))
        # A level that is the same everywhere is no join key to Spark, and other keys would be exchanged again.
        deal = [k for k in keys if k != "_lv" or not spec.left_levels == spec.right_levels == (0,)]
        lefts, rights = lefts.repartition(tasks, *deal), rights.repartition(tasks, *deal)
    # A grid that was handed in without counting has no rows: taken as large.
    pairs = lefts.join(rights if 0 < spec.rows <= BROADCAST_ROWS else rights.hint("merge"), keys)
    lb, rb = [F.col(c) for c in left_box], [F.col(c) for c in right_box]
    keep = ((F.col("_cx") == F.greatest("_lcx", "_rcx"))
            & (F.col("_cy") == F.greatest("_lcy", "_rcy"))
            & (lb[0] - grow <= rb[2]) & (lb[2] + grow >= rb[0])
            & (lb[1] - grow <= rb[3]) & (lb[3] + grow >= rb[1]))
    if condition is not None:
        keep = keep & condition
    extra = ["_lv", "_cx", "_cy", "_lcx", "_lcy", "_rcx", "_rcy", "_a", "_b"]
    return pairs.where(keep).drop(*extra)


def box_semi(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box,
             key: Sequence[str], *, anti: bool = False, **kw) -> DataFrame:
    """Left rows that have (or, with ``anti``, lack) a partner; each once."""
    hits = box_pairs(left, right, left_box, right_box, **kw).select(*key).distinct()
    return left.join(hits, list(key), "left_anti" if anti else "left_semi")


def box_left(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box,
             key: Sequence[str], **kw) -> DataFrame:
    """Like :func:`box_pairs`, and left rows without a partner once, with NULLs."""
    pairs = box_pairs(left, right, left_box, right_box, **kw)
    mine = [c for c in left.columns if c not in key]
    return left.join(pairs.drop(*mine), list(key), "left")
