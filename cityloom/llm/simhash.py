"""SimHash near duplicates by tiled exact comparison.

1. A map over whole texts gives each row its 64-bit fingerprint: A-Z lower-cased, shingles of ``WORDS`` words with
   repeats, XXH64 of each, and a bit for every position that is set in over half of them. Rows with equal
   fingerprints are one from then on (smallest ids and counts add up inside tasks first).
2. A fingerprint's tile is given by the set bits in each of its ``SEGMENTS`` equal parts. Bits that differ are at
   least the sum of these counts' differences, so a pair of tiles whose counts lie further apart than the radius
   is skipped; all others are compared. A tile with more than ``TILE`` fingerprints is split by hash.
3. Each kept pair of tiles is one row with both sides, compared whole by exclusive-or and bit counts in numpy. It
   reports a spanning forest of its links, not the links: at most as many rows as the two sides have fingerprints.
4. Components of the forests are those of all links.

No link is lost and none is approximate. Comparisons grow with the square of distinct fingerprints, times the share
of tile pairs that is kept (0.05 for evenly spread bits and four parts), as the method implies; shuffled bytes grow
with fingerprints times neighbouring tiles, 8 bytes each, until tiles are split.

Defined cases: a null or blank text has no words and fingerprint zero, which links like any other; fewer words than
a shingle make one shingle. A null doc_id is never the smallest of a component unless it has no other id; then
component_id is null. Repeated rows share a fingerprint. Other columns, of any name, play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, byte_texts, frugal, join_small, partitions, slices, text_of, written
from .links import components

WORDS = 3
SEED = 42
RADIUS = 3
SEGMENTS = 4
#: Fingerprints of a tile.
TILE = 8192
#: Shingles whose bits are counted at a time.
_PART = 1 << 16
#: Comparisons held at a time.
_CELLS = 1 << 20


# ------------------------------------------------------------------ fingerprints
def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: folds A-Z only, splits at the six ASCII separators only
    if not words:
        return np.zeros(0, np.uint64)
    plain, digest = b" ".join(words), xxhash.xxh64_intdigest
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    k = min(WORDS, len(words))
    spans = zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist(), strict=True)
    return np.fromiter((digest(plain[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half of ``hashes`` have it; zero for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        bits = np.unpackbits(hashes[at:at + _PART].astype("<u8").view(np.uint8), bitorder="little")
        total += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (as a signed long) of every row."""
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    schema = pa.schema([("doc_id", rows.limit(0).toArrow().schema.field(0).type), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = [fingerprint(shingle_hashes(t)) for t in byte_texts(b.column("text"))]
            yield as_batch({"doc_id": b.column("doc_id"), "print": np.array(prints, np.uint64).view(np.int64)}, schema)

    return rows.mapInArrow(frugal(run), f"doc_id {rows.dtypes[0][1]}, print long")


# ------------------------------------------------------------------ tiles
def _counts(value: Column, segments: int) -> list[Column]:
    """Set bits in each of the equal parts of a 64-bit value."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(value, width * i).bitwiseAND(mask)) for i in range(segments)]


def _steps(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of counts that sum up to ``radius`` at most, one of each pair of opposites."""
    near = [s for s in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, s)) <= radius]
    return [s for s in near if s >= (0,) * segments]


def _tile(counts: list[Column]) -> Column:
    """One number for the counts of all parts; no neighbour leaves its place."""
    number = F.lit(0).cast("long")
    for c in counts:
        number = number * 256 + c.cast("long") + 64
    return number


def tile_pairs(prints: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``left``, ``right``: the fingerprints of every pair of tiles that may hold a link; null on the right for a
    tile against itself. ``prints`` has distinct values of ``print``."""
    placed = prints.select("print", _tile(_counts(F.col("print"), segments)).alias("tile"))
    tiles = written(placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("parts")))
    dealt = join_small(placed, tiles, ["tile"]).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")))
    # A part holds about ``tile`` values: they are distinct and dealt by hash.
    content = written(dealt.groupBy("tile", "part").agg(F.collect_list("print").alias("values")))
    steps = [sum(d << 8 * i for i, d in enumerate(reversed(s))) for s in _steps(segments, radius)]
    near = tiles.select("tile", "parts", F.explode(F.lit(steps)).alias("step")).select(
        F.col("tile").alias("a"), "parts", (F.col("tile") + F.col("step")).alias("b"))
    near = near.join(tiles.select(F.col("tile").alias("b"), F.col("parts").alias("others")), "b")
    to = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    pairs = (near.select("a", "b", "others", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"))
             .select("a", "b", "i", F.explode(to).alias("j")).where("a <> b OR i <= j"))
    pairs = pairs.join(content.select(F.col("tile").alias("a"), F.col("part").alias("i"), F.col("values").alias("left")),
                       ["a", "i"])
    same = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    return pairs.join(content.select(F.col("tile").alias("b"), F.col("part").alias("j"), F.col("values").alias("right")),
                      ["b", "j"]).select("left", F.when(~same, F.col("right")).alias("right"))


def links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``left``, in ``right``) of the values within ``radius``; without ``right``, pairs of ``left``."""
    other = left if right is None else right
    high = max(1, _CELLS // max(len(other), 1))
    found = []
    for at in range(0, len(left), high):
        near = np.bitwise_count(left[at:at + high, None] ^ other[None, :]) <= radius
        a, b = np.nonzero(near)
        keep = a + at < b if right is None else slice(None)
        found.append((a[keep] + at, b[keep]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its part) for the values of two tiles that have links."""
    a, b = links(left, right, radius)
    if right is None:
        values = left
    else:
        values, b = np.concatenate((left, right)), b + len(left)
    if not len(a):
        return values[:0], values[:0]
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    a, b, root = rank[a], rank[b], np.arange(len(values))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(values)))
    return values[order[other]], values[order[root[other]]]


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for name in ("left", "right"):
                column = b.column(name)
                values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
                sides.append((values, column.offsets.to_numpy().tolist(), column.is_valid().to_pylist()))
            (left, at, _), (right, to, two) = sides
            found = [forest(left[at[i]:at[i + 1]], right[to[i]:to[i + 1]] if two[i] else None, radius)
                     for i in range(b.num_rows)]
            yield as_batch({n: np.concatenate([x[k] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64)
                            for k, n in enumerate(("a", "b"))}, FOUND)
    return run


def simhash_components(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that
    links reach)."""
    rows = written(fingerprints(docs))
    groups = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    pairs = tile_pairs(groups, segments, radius, tile).repartition(2 * partitions(docs))
    found = written(pairs.mapInArrow(frugal(_compare(radius)), "a long, b long"))
    joined = written(components(found).select(F.col("node").alias("print"), "root"))
    tops = written(joined.join(groups, "print").groupBy("root").agg(F.min("least").alias("component_id")))
    linked = joined.join(tops, "root").select("print", "component_id")
    # Documents without links keep the smallest id of their own copies.
    known = written(groups.join(linked.withColumn("linked", F.lit(True)), "print", "left").select(
        "print", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    return join_small(rows, known, ["print"]).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
