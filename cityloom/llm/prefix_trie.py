"""Prefix trie of conversations by truncation peeling.

1. Turns are dealt by conversation and sorted; one pass over a task's sorted rows chains the digests of a
   conversation's turns, so that ``keys[d]`` names the sequence of its first d turns. Texts are not shuffled.
2. Conversations that end on the same sequence are packed: sorted by sequence and id over the whole cluster, ids
   written out in chunks, and the chunks of a sequence run through SHA-256 in order. A sequence on which a third of
   all conversations end is sorted by many tasks; the digest itself, which is sequential, reads only the chunks.
3. Sequences are dealt by their first turn; where more than ``GROUP`` of them share it, by their first two turns, and
   so on. What lies below such a common start is whole in one task and is peeled there: from the greatest depth up,
   newly ended conversations are merged with the surviving nodes, every node is cut by its last turn, and the rest is
   regrouped. A node is found and its counts are finished at once. A task holds ``GROUP`` sequences of ``BLOCK``
   levels, whatever their length.
4. The levels above are peeled in the same way by Spark, one aggregation (added up inside tasks first) for each
   depth, written and reread. There are as many rounds as starts are long that more than ``GROUP`` sequences share.

A row carries the keys of at most ``BLOCK`` levels; when they are used up, the next ones come from the table of
step 1 by the node's smallest conversation.

With ``family`` every conversation c that is not a multiple of ``family`` is a branch: the first h turns of
conversation c - c % family, then its own turns after its first h, with h = crc32(c) % ``BRANCHES``.

Defined cases: null role or text counts as empty; turns are ordered by ``turn``, null first, equal turns by the
SHA-256 of role and text. Rows without conv_id belong to no conversation. A conversation that has no turns after
rebuilding is a member of the root alone. Repeated rows are turns of their own. Other columns, of any name, play no
part. An empty table gives an empty result (no root).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, join_small, partitions, shared_folder, written

#: Levels whose keys a row carries.
BLOCK = 64
#: Sequences below one start that a task peels.
GROUP = 256
#: A branch takes over fewer turns than this.
BRANCHES = 9
#: Characters of joined ids in one chunk.
CHUNK = 1 << 16
_ROOT = b""
_FLUSH = 4096

PATHS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("length", pa.int64()),
                   ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
PATHS_SQL = "conv_id long, block long, length long, keys array<binary>, sizes array<long>"


def _turns(conversations: DataFrame, family: int | None) -> DataFrame:
    conv = conversations["conv_id"].cast("long")
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    home, kept = conv, F.lit(0).cast("long")
    if family:
        home, kept = conv - conv % F.lit(family), F.crc32(conv.cast("string").cast("binary")) % F.lit(BRANCHES)
    return conversations.select(
        home.alias("home"), conv.alias("conv_id"), kept.alias("kept"), conversations["turn"].alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size")
    ).where("conv_id is not null")


class _Path:
    """The chained keys of one conversation, handed out in blocks."""

    def __init__(self, conv: int, block: int):
        self.block = block
        self.conv, self.key, self.length, self.keys, self.sizes = conv, _ROOT, 0, [], []

    def add(self, digest: bytes, size: int, out: list) -> None:
        if len(self.keys) == self.block:
            out.append((self.conv, self.length // self.block - 1, None, self.keys, self.sizes))
            self.keys, self.sizes = [], []
        self.key = hashlib.sha256(self.key + digest).digest()[:16]
        self.keys.append(self.key)
        self.sizes.append(size)
        self.length += 1

    def close(self, out: list) -> None:
        out.append((self.conv, max(self.length - 1, 0) // self.block, self.length, self.keys, self.sizes))


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                      schema=schema)


def _chain(block: int):
    """Rows come sorted by home (its own conversation first), conversation and turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, stem, stem_home, own = [], None, [], None, 0
        for b in batches:
            names = ("home", "conv_id", "kept", "digest", "size")
            for home, conv, kept, digest, size in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if path is None or conv != path.conv:
                    if path is not None:
                        path.close(out)
                    if home != stem_home:
                        stem, stem_home = [], home
                    path, own = _Path(conv, block), 0
                    if conv != home:
                        for turn in stem[:kept]:
                            path.add(*turn, out)
                own += 1
                if conv == home and own < BRANCHES:
                    stem.append((digest, size))
                if conv == home or own > kept:
                    path.add(digest, size, out)
            if len(out) >= _FLUSH:
                yield _rows(out, PATHS)
                out = []
        if path is not None:
            path.close(out)
        if out:
            yield _rows(out, PATHS)
    return run


ENDS = pa.schema([("length", pa.int64()), ("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()),
                  ("ids", pa.string()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
ENDS_SQL = "length long, key binary, conv_id long, n long, ids string, keys array<binary>, sizes array<long>"


def _pack(chunk: int):
    """Rows come sorted by length, key and id: one row for each run of ids on one key, in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, first, ids, width = [], None, None, [], 0

        def close() -> None:
            out.append((*now, first[0], len(ids), ",".join(ids), *first[1:]))

        for b in batches:
            names = ("length", "key", "conv_id", "keys", "sizes")
            keys, sizes = b.column("keys"), b.column("sizes")
            for i, (length, key, conv) in enumerate(zip(*(b.column(n).to_pylist() for n in names[:3]), strict=True)):
                if (length, key) != now or width >= chunk:
                    if now is not None:
                        close()
                    now, first, ids, width = (length, key), (conv, keys[i].as_py(), sizes[i].as_py()), [], 0
                ids.append(str(conv))
                width += len(ids[-1]) + 1
            if len(out) >= _FLUSH or sum(len(x[4]) for x in out) >= 16 * chunk:
                yield _rows(out, ENDS)
                out = []
        if now is not None:
            close()
        if out:
            yield _rows(out, ENDS)
    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by length, key and first id: one row for each key, ``ids`` now their SHA-256."""
    out, now, first, n, sha = [], None, None, 0, None

    def close() -> None:
        out.append((*now, first[0], n, sha.hexdigest(), *first[1:]))

    for b in batches:
        for row in b.to_pylist():
            if (row["length"], row["key"]) != now:
                if now is not None:
                    close()
                now, n = (row["length"], row["key"]), 0
                first, sha = (row["conv_id"], row["keys"], row["sizes"]), hashlib.sha256()
            sha.update(("," if n else "").encode() + row["ids"].encode())
            n += row["n"]
        if len(out) >= _FLUSH:
            yield _rows(out, ENDS)
            out = []
    if now is not None:
        close()
    if out:
        yield _rows(out, ENDS)


def _ended(paths: DataFrame, chunk: int) -> DataFrame:
    """One row for each sequence on which conversations end: length, key, smallest conv_id, n, ids (their digest)."""
    n = partitions(paths)
    last = paths.where("length is not null").select(
        "length", F.coalesce(F.try_element_at("keys", F.lit(-1)), F.lit(_ROOT)).alias("key"), "conv_id", "keys", "sizes")
    chunks = (last.repartitionByRange(n, "length", "key", "conv_id").sortWithinPartitions("length", "key", "conv_id")
              .mapInArrow(frugal(_pack(chunk)), ENDS_SQL))
    return written(chunks.repartition(n, "length", "key").sortWithinPartitions("length", "key", "conv_id")
                   .mapInArrow(frugal(_digest), ENDS_SQL))


NODES = ("key binary, depth long, parent_key binary, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, keys array<binary>, sizes array<long>")
NODE = pa.schema([(n, pa.binary() if t == "binary" else pa.string() if t == "string" else pa.list_(pa.binary())
                   if t == "array<binary>" else pa.list_(pa.int64()) if t == "array<long>" else pa.int64())
                  for n, t in (x.split() for x in NODES.split(", "))])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ below one start, in a task
def _dealt(ends: DataFrame, paths: DataFrame, block: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(sequences with ``deal``, the key of their start, and ``top``, its depth; sequences that end above)."""
    above, small = ends.where("length = 0"), []
    live, top = ends.where("length > 0").drop("keys", "sizes"), 1
    while True:
        if (top - 1) % block == 0:
            live = live.drop("start").join(paths.where(F.col("block") == (top - 1) // block).select(
                "conv_id", F.col("keys").alias("start")), "conv_id")
        live = written(live.withColumn("deal", F.element_at("start", (top - 1) % block + 1))
                       .withColumn("top", F.lit(top).cast("long")))
        big = written(live.groupBy("deal").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group)
                      .select("deal", F.lit(True).alias("big")))
        if not big.limit(1).count():
            small.append(live.drop("start"))
            break
        marked = written(join_small(live, big, ["deal"], "left"))
        small.append(marked.where("big is null").drop("start", "big"))
        here = marked.where("big").drop("deal", "top", "big")
        above = above.unionByName(ends.join(here.where(F.col("length") == top).select("conv_id"), "conv_id", "left_semi"))
        live, top = here.where(F.col("length") > top), top + 1
    for more in small[1:]:
        small[0] = small[0].unionByName(more)
    return small[0], above


def _subtree(rows: Iterator[tuple], block: int) -> Iterator[tuple]:
    """Nodes below one start. Rows (deal, top, block, conv_id, length, n, ids, keys, sizes) come from the last block
    down. A living node is [key, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, ids]."""
    alive, top = [], 1
    for at, members in groupby(rows, key=itemgetter(2)):
        low, paths, ending = at * block, {}, defaultdict(list)
        for _, top, _, conv, length, n, ids, keys, sizes in members:
            paths[conv] = keys, sizes
            if low < length <= low + block:
                ending[length].append((conv, n, ids))
        depth = alive[0][1] - 1 if alive else max(ending)
        while depth > low and depth >= top - 1:
            level = {}
            for node in alive:
                keys, sizes = paths[node[2]]
                key = keys[depth - low - 1]
                if depth < top:
                    yield *node[:2], key, *node[2:], keys[:depth - low], sizes[:depth - low]
                    continue
                yield *node[:2], key, *node[2:], None, None
                into = level.get(key)
                if into is None:
                    into = level[key] = [key, depth, node[2], 0, 0, 0, 0, _NO_ENDS]
                into[2] = min(into[2], node[2])
                into[3] += node[3]
                into[4] += 1
                into[5] += node[5]
                into[6] += node[6]
            for conv, n, ids in ending.get(depth, ()):
                key = paths[conv][0][depth - low - 1]
                into = level.setdefault(key, [key, depth, conv, 0, 0, 0, 0, _NO_ENDS])
                into[2], into[3], into[7] = min(into[2], conv), into[3] + n, ids
            alive = list(level.values())
            for node in alive:
                node[5] = node[5] or 1
                node[6] += (node[3] - 1) * paths[node[2]][1][depth - low - 1]
            depth -= 1
    for node in alive:
        yield *node[:2], _ROOT, *node[2:], [], []


def _peel(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by start, then from the last block down."""
        def rows():
            for b in batches:
                names = ("deal", "top", "block", "conv_id", "length", "n", "ids", "keys", "sizes")
                yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)

        out = []
        for _, members in groupby(rows(), key=itemgetter(0)):
            for node in _subtree(members, block):
                out.append(node)
                if len(out) >= _FLUSH:
                    yield _rows(out, NODE)
                    out = []
        if out:
            yield _rows(out, NODE)
    return run


# ------------------------------------------------------------------ above, by Spark
def _level(rows: DataFrame, depth: int, paths: DataFrame, block: int) -> DataFrame:
    """The nodes of one depth from surviving and newly ended rows; keys and sizes already cut by the last turn."""
    size = F.coalesce(F.try_element_at("sizes", F.lit(-1)), F.lit(0).cast("long"))
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ids").alias("ids"),
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
    nodes = nodes.select(
        "key", F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * size).alias("saved_tokens"),
        F.coalesce("ids", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.slice("keys", 1, F.greatest(F.size("keys") - 1, F.lit(0))).alias("keys"),
        F.slice("sizes", 1, F.greatest(F.size("sizes") - 1, F.lit(0))).alias("sizes"))
    above = depth - 1
    if above > 0 and above % block == 0:  # the keys above are in the block before
        before = paths.where(F.col("block") == above // block - 1).select("conv_id", "keys", "sizes")
        nodes = nodes.drop("keys", "sizes").join(before, "conv_id")
    parent = F.try_element_at("keys", F.lit(-1)) if above > 0 else F.lit(_ROOT if above == 0 else None).cast("binary")
    return nodes.withColumn("parent_key", parent).select(*(x.split()[0] for x in NODES.split(", ")))


def prefix_trie(conversations: DataFrame, family: int | None = None, block: int = BLOCK, chunk: int = CHUNK,
                group: int = GROUP) -> DataFrame:
    """One row per node of the trie over ``conversations`` (conv_id, turn, role, text): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of text that sharing saves in the
    subtree) and ends_sha256 (digest of the ids that end here)."""
    spark = conversations.sparkSession
    turns = _turns(conversations, family)
    paths = written(turns.repartition(partitions(turns), "home")
                    .sortWithinPartitions("home", F.col("conv_id") != F.col("home"), "conv_id", "turn", "digest")
                    .drop("turn").mapInArrow(frugal(_chain(block)), PATHS_SQL))
    ends = _ended(paths, chunk)
    dealt, above = _dealt(ends, paths, block, group)
    whole = dealt.drop("key").join(paths.select(
        F.col("conv_id").alias("of"), "block", "keys", "sizes"), (F.col("conv_id") == F.col("of"))
        & (F.col("block") >= F.floor((F.col("top") - 2) / block)))
    folder = shared_folder(spark, "trie")
    (whole.repartition(partitions(turns), "deal").sortWithinPartitions("deal", F.desc("block"), "conv_id")
     .mapInArrow(frugal(_peel(block)), NODES).write.parquet(f"{folder}/below"))
    tops = spark.read.schema(NODES).parquet(f"{folder}/below").where("keys is not null")
    none = F.lit(0).cast("long")
    above = written(above)
    deepest = max(x.agg(F.max(c)).head()[0] or 0 for x, c in ((above, "length"), (tops, F.col("depth") - 1)))
    rounds = tops
    for depth in range(deepest, -1, -1):
        rows = above.where(F.col("length") == depth).select(
            "key", "conv_id", F.col("n").alias("n_convs"), none.alias("n_children"), none.alias("n_leaves"),
            none.alias("saved_tokens"), "ids", "keys", "sizes")
        rows = rows.unionByName(rounds.where(F.col("depth") == depth + 1).select(
            F.col("parent_key").alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"),
            "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ids"), "keys", "sizes"))
        _level(rows, depth, paths, block).write.parquet(f"{folder}/{depth}")
        rounds = tops.unionByName(spark.read.schema(NODES).parquet(f"{folder}/{depth}"))
    nodes = spark.read.schema(NODES).option("recursiveFileLookup", "true").parquet(folder)
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return join_small(nodes.drop("keys", "sizes"), parents, ["depth", "parent_key"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
