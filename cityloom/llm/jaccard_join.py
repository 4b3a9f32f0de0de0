"""Self-join on the Jaccard similarity of five-word shingles, with Bayesian pruning.

1. One pass turns each text into the digest of its shingle set and the hashes of 32 MinHash
   bands of 4 values. Rows of equal sets are copies of one node and are counted, not paired.
2. Nodes that share a band are linked to the smallest node of that band (a star, so a crowded
   band costs one row a node), and components of these links are the groups of candidates.
   A pair at similarity 0.8 shares none of the 32 bands with probability 5e-8.
3. Texts of nodes in such groups are read again, and the members of a group are compared with
   each other inside a task; a group of more than ``BLOCK`` nodes is dealt out as pairs of
   blocks. Each pair's MinHash values are compared 16 at a time; as soon as the posterior
   probability that its similarity reaches the threshold, under a uniform prior, falls below
   ``TOLERANCE``, the pair is dropped. What remains is verified exactly on whole shingle sets.
4. Tasks return link counts and a spanning forest of the links, never the pairs.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. A text of one to four words
has one shingle, all of its words. A text without words (null, empty, blank) is alone in its class
and has no links. Rows with equal shingle sets are linked to each other (similarity 1). Ids may be
null or repeated; other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan, mix, shingles
from .common import (as_batch, byte_texts, cut, frugal, join_small, numbered, partitions, retain, slices,
                     text_of, written)
from .links import components

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 4
STEP = 16            # MinHash values that a round of comparison adds
TOLERANCE = 1e-9     # posterior probability below which a pair is dropped
BLOCK = 512          # nodes of a group that one task compares with as many others

_VALUES = BANDS * BAND_ROWS
_FACTORS = mix(np.arange(7, 7 + _VALUES, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each), a row per set; ``counts`` must be positive."""
    starts = np.cumsum(counts) - counts
    out = np.empty((_VALUES, len(counts)), np.uint32)
    for i, factor in enumerate(_FACTORS):
        x = hashes * factor
        x ^= x >> np.uint64(32)
        out[i] = np.minimum.reduceat((x * factor) >> np.uint64(32), starts)
    return out.T.copy()


def least_matches(rounds: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 1, 2, ... rounds of ``STEP`` values: the fewest matches m of n with which
    P(similarity >= threshold | m of n) is at least the tolerance. The posterior is
    Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    out = []
    for k in range(1, rounds + 1):
        n = k * STEP + 1
        tail, m = 0.0, 0
        while True:  # P(Beta >= t) = P(Binomial(n + 1, t) <= m)
            tail += comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


# ------------------------------------------------------------------ first pass
PROFILE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_key", pa.binary()),
                     ("bands", pa.list_(pa.int64()))])


def _profiles(kind: pa.DataType):
    schema = pa.schema([pa.field("doc_id", kind), *list(PROFILE)[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, counts = shingles(Scan(byte_texts(b.column("text"))), WORDS)
            full = np.flatnonzero(counts)
            keys: list[bytes | None] = [None] * b.num_rows
            bands: list[np.ndarray | None] = [None] * b.num_rows
            if len(full):
                ends = np.cumsum(counts)
                sig = signatures(hashes, counts[full]).astype(np.uint64)
                band = np.zeros((len(full), BANDS), np.uint64)
                for r in range(BAND_ROWS):
                    band = mix(band * np.uint64(31) + sig[:, r::BAND_ROWS] + np.uint64(r))
                band = mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for i, t in enumerate(full.tolist()):
                    own = hashes[ends[t] - counts[t]:ends[t]]
                    keys[t] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    bands[t] = band[i]
            yield as_batch({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"),
                            "set_key": keys, "bands": bands}, schema)
    return run


def _hashed(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(docs["doc_id"], F.xxhash64(text).alias("text_hash"), text.alias("text"))


# ------------------------------------------------------------------ comparison in tasks
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "copies", "grp", "blocks", "block"]
    for b in slices(batches):
        hashes, counts = shingles(Scan(byte_texts(b.column("text"))), WORDS)
        raw, ends = hashes.tobytes(), np.cumsum(counts)
        sets = [raw[8 * (e - c):8 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sets, pa.binary())],
                                         names=[*names, "shingles"])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (left[i], right[i])."""
    if len(left) < 8 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                            for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.int64, len(left))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(np.bincount(column) > 1)  # the others are in no intersection
    place = np.full(column.max() + 1, -1)
    place[shared] = np.arange(len(shared))
    place = place[column]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(shared), 4096):
        use = (place >= lo) & (place < lo + 4096)
        part = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
        part[row[use], place[use] - lo] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, threshold: float = THRESHOLD
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``sets`` at the threshold or above. ``side`` is 0 or 1: with both present only
    pairs across are compared, else all."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    sig = signatures(np.concatenate(sets), sizes)
    need = least_matches(_VALUES // STEP, threshold)
    if side.any() and not side.all():
        left, right = (x.ravel() for x in np.meshgrid(
            np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    else:
        left, right = np.triu_indices(len(sets), 1)
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    fit = small >= threshold * large - 1e-9  # a larger difference in size rules the pair out
    left, right = left[fit], right[fit]
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(need):
        part = np.ascontiguousarray(sig[:, k * STEP:(k + 1) * STEP])
        for lo in range(0, len(left), 1 << 16):
            hi = lo + (1 << 16)
            matches[lo:hi] += (part[left[lo:hi]] == part[right[lo:hi]]).sum(axis=1)
        alive = matches >= least
        left, right, matches = left[alive], right[alive], matches[alive]
    both = _common(sets, left, right)
    ok = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
    return left[ok], right[ok]


FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("whole", pa.bool_())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is held at a time."""
    def rows():
        for b in batches:
            names = ("grp", "low", "high", "block", "blocks", "node", "copies")
            cols = [b.column(n).to_pylist() for n in names]
            yield from zip(*cols, b.column("shingles"), strict=True)

    for (_, low, high), members in groupby(rows(), key=lambda x: x[:3]):
        unit = list({x[5]: x for x in members}.values())  # repeated rows carry the same node
        if len(unit) < 2:
            continue
        node = np.array([x[5] for x in unit], np.int64)
        copies = np.array([x[6] for x in unit], np.int64)
        side = np.array([x[3] != low for x in unit], np.int64)
        left, right = linked_pairs([np.frombuffer(x[7].as_py(), np.uint64) for x in unit],
                                   side if low != high else np.zeros(len(unit), np.int64))
        if not len(left):
            continue
        links = np.zeros(len(unit), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        order = np.argsort(node)
        rank = np.empty(len(unit), np.int64)
        rank[order] = np.arange(len(unit))
        root, a, b = np.arange(len(unit)), rank[left], rank[right]
        while True:  # smallest node of each connected part
            least = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        use = links > 0
        yield as_batch({"node": node[use], "root": node[order][root[rank[use]]], "links": links[use],
                        "whole": np.full(int(use.sum()), unit[0][4] == 1)}, FOUND)


# ------------------------------------------------------------------ the join
def similarity_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the class, classes being
    components of links), class_size, links (other rows at similarity 0.8 or more), row_id, text_hash
    and is_first (the one row of the class to keep: largest doc_id)."""
    kind = _hashed(docs.limit(0)).select("doc_id")
    arrow = kind.toArrow().schema.field(0).type
    name = kind.dtypes[0][1]
    profile = _hashed(docs).mapInArrow(
        frugal(_profiles(arrow)), f"doc_id {name}, text_hash long, set_key binary, bands array<long>")
    rows = numbered(profile, "doc_id", "text_hash", "set_key", "bands")
    groups = rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups)
    members = written(join_small(rows, groups, ["set_key"], "left").select(
        "row_id", "doc_id", "text_hash", F.coalesce("node", "row_id").alias("node"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.when(F.col("row_id") == F.col("node"), F.col("bands")).alias("bands")))
    band = members.where("bands is not null").select("node", F.explode("bands").alias("band"))
    crowded = cut(band.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").drop("n"))
    star = join_small(band, crowded, ["band"]).where("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b"))
    candidates = cut(components(star).withColumnRenamed("root", "grp"))
    sizes = candidates.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    dealt = cut(candidates.join(sizes, "grp"))
    wanted = join_small(members.where("row_id = node").select("doc_id", "text_hash", "node", "copies"),
                        dealt, ["node"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    wanted = written(wanted.select(F.col("doc_id").alias("want_id"), F.col("text_hash").alias("want_hash"),
                                   "node", "copies", "grp", "blocks", "block"))
    match = (F.col("text_hash") == F.col("want_hash")) & F.col("doc_id").eqNullSafe(F.col("want_id"))
    sets = join_small(_hashed(docs), wanted, match).select(
        "text", "node", "copies", "grp", "blocks", "block").mapInArrow(
        frugal(_sets), "node long, copies long, grp long, blocks long, block long, shingles binary")
    units = (sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
             .drop("other").repartition(partitions(docs), "grp", "low", "high")
             .sortWithinPartitions("grp", "low", "high"))
    found = written(units.mapInArrow(frugal(_compare), "node long, root long, links long, whole boolean"))
    counts = found.groupBy("node").agg(F.sum("links").alias("linked"), F.min("root").alias("root"),
                                       F.min("whole").alias("whole"))
    parts = found.where("not whole").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if parts.limit(1).count():
        joined = components(parts).withColumnRenamed("root", "over")
        counts = counts.join(joined, "node", "left").withColumn("root", F.coalesce("over", "root"))
    counts = written(counts.select(F.col("node"), "linked", "root"))
    labelled = written(join_small(members.drop("bands"), counts, ["node"], "left")
                       .withColumn("root", F.coalesce("root", "node"))
                       .withColumn("links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1))
    classes = written(labelled.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
        F.max(F.struct("doc_id", "row_id")).alias("first")).where("class_size > 1"))
    return join_small(labelled, classes, ["root"], "left").select(
        "doc_id", F.when(F.col("class_size") > 1, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "links", "row_id", "text_hash",
        (F.col("first").isNull() | (F.col("first.row_id") == F.col("row_id"))).alias("is_first"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns; of each class the row with the largest doc_id stays."""
    verdicts = similarity_classes(docs).select(
        "doc_id", F.col("text_hash").alias("key"), F.col("is_first").alias("keep"))
    return retain(docs, verdicts, F.xxhash64(text_of(docs)))
