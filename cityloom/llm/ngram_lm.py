"""A bigram language model with interpolated modified Kneser-Ney smoothing.

Counting is two exchanges of sorted, Golomb-coded arrays between Spark tasks.

1. Words: every task sorts and counts the 64-bit hashes of its words; owners of equal hash ranges add them
   up and write the vocabulary as a sorted hash array with a count array. A word's id is its rank.
2. Pairs: every task counts (context id, word id) pairs; shards add them up and write sorted arrays of pairs,
   counts, and of contexts with their statistics. A context goes to one shard, but one with at least a quarter
   of a shard's tokens is split over all shards by pair, and its statistics are added up afterwards.
3. How many contexts each word follows is sent from the shards to the words' owners in the same coding.

Scoring is a map: each worker memory-maps the arrays from the shared folder and looks up the distinct pairs of
a chunk of texts in sorted order, so what it holds is pages of files, not the model. What comes to the driver
is a few numbers for each owner and shard, and the split contexts (at most four a shard).

    p(w) = max(n(.w) - D, 0) / n(..) + g / (V + 1)          n(.w): distinct contexts of w
    p(w | h) = max(c(h w) - D, 0) / c(h) + g(h) p(w)        D by count 1, 2, 3 or more

The + 1 is for all unknown words together; after an unknown or unseen context p(w | h) is p(w). Every text begins
in a context of its own and ends with an end token. Masses add up to 1 for every context.

Defined cases: A-Z are read as a-z; words are ``[^\\x20\\x09-\\x0D]+``; a null text is empty, so it has the end token only.
Rows with a null id are neither learned from nor held out. With nothing to learn from, all probabilities are 1
(score 0). Repeated rows count as often as they occur. Other columns, of any name, play no part. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan, mix
from .common import (as_batch, byte_texts, frugal, kept_in_worker, mounted, publish, shared_folder, slices,
                     text_of, written)
from .exact_dedup import decode_gaps, encode_gaps

OWNER_BYTES = 64 << 20      # bytes of text for each owner of words
SHARD_TOKENS = 4_000_000    # tokens for each shard of pairs
FLUSH_TOKENS = 2_000_000    # tokens that a task counts before it sends
BASE_ADD = 0.1

END = mix(np.array([0xE4D], np.uint64))[0]
U = np.uint64


@dataclass
class Model:
    """What a worker needs besides the arrays in ``folder``."""

    folder: str
    offsets: list[int] = field(default_factory=lambda: [0])   # first id of each owner; last: vocabulary
    tokens: int = 0
    shards: int = 1
    hot: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)  # contexts that are split
    pair_off: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_off: tuple[float, float, float] = (0.5, 1.0, 1.5)
    kinds: int = 0               # distinct pairs
    spare: float = 1.0           # mass of p(w) that is spread evenly

    @property
    def size(self) -> int:
        return self.offsets[-1]


class Arrays:
    """Memory-mapped arrays of a model."""

    def __init__(self, model: Model):
        def load(name: str, n: int) -> list[np.ndarray]:
            return [np.load(f"{model.folder}/{name}-{i}.npy", mmap_mode="r") for i in range(n)]

        owners = len(model.offsets) - 1
        self.model, self.words, self.counts = model, load("word", owners), load("count", owners)
        self.low = _lows(max(owners, 1))

    def load_pairs(self) -> Arrays:
        if not self.model.kinds:
            return self
        n, owners = self.model.shards, len(self.model.offsets) - 1
        self.after = [np.load(f"{self.model.folder}/after-{i}.npy", mmap_mode="r") for i in range(owners)]
        self.pair, self.times, self.context, self.stat = (
            [np.load(f"{self.model.folder}/{x}-{i}.npy", mmap_mode="r") for i in range(n)]
            for x in ("pair", "times", "context", "stat"))
        hot = sorted(self.model.hot)
        self.hot = np.array(hot, np.int64)
        self.hot_stat = np.array([self.model.hot[h] for h in hot], np.int64).reshape(-1, 4)
        return self

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        if self.model.size:
            cuts = np.append(np.searchsorted(hashes, self.low), len(hashes))
            for o, known in enumerate(self.words):
                ask = hashes[cuts[o]:cuts[o + 1]]
                if len(ask) and len(known):
                    at = np.minimum(np.searchsorted(known, ask), len(known) - 1)
                    out[cuts[o]:cuts[o + 1]] = np.where(known[at] == ask, at + self.model.offsets[o], -1)
        return out

    def per_word(self, arrays: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Values at sorted ids (0 for -1)."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.model.offsets)
        for o, values in enumerate(arrays):
            part = ids[cuts[o]:cuts[o + 1]]
            out[cuts[o]:cuts[o + 1]] = values[part - self.model.offsets[o]]
        return out

    def shard(self, context: np.ndarray, key: np.ndarray, hot: np.ndarray) -> np.ndarray:
        return _shard(self.model.shards, context, key, hot)

    def find(self, context: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each pair, statistics of its context): total, and pairs seen once, twice, more."""
        count, stat = np.zeros(len(key), np.int64), np.zeros((len(key), 4), np.int64)
        if not self.model.kinds:
            return count, stat
        where = self.shard(context, key, self.hot)
        for s in np.unique(where):
            mine = np.flatnonzero(where == s)
            for known, ask, values, out in ((self.pair[s], key[mine], self.times[s], count),
                                            (self.context[s], context[mine], self.stat[s], stat)):
                if len(known):
                    at = np.minimum(np.searchsorted(known, ask), len(known) - 1)
                    hit = known[at] == ask
                    out[mine[hit]] = values[at[hit]]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hit = self.hot[at] == context
            stat[hit] = self.hot_stat[at[hit]]
        return count, stat


@kept_in_worker
@lru_cache(1)
def _words_of(folder: str, offsets: tuple[int, ...]) -> Arrays:
    return Arrays(Model(folder, list(offsets)))


_OPEN: dict[str, Arrays] = {}


def _arrays(model: Model) -> Arrays:
    if model.folder not in _OPEN:
        _OPEN.clear()
        _OPEN[model.folder] = Arrays(model).load_pairs()
    return _OPEN[model.folder]


def _lows(owners: int) -> np.ndarray:
    return np.array([(i << 64) // owners for i in range(owners)], U)


def _shard(shards: int, context: np.ndarray, key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    split = np.isin(context, hot)
    return (mix(np.where(split, key.astype(U), context.astype(U) + U(1) << U(33))) % U(shards)).astype(np.int64)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts, number of each); an end token closes every text."""
    scan = Scan(texts)
    a, b = scan.words()
    owner = scan.text_of(a)
    count = np.bincount(owner, minlength=scan.n) + 1
    out = np.full(len(a) + scan.n, END, U)
    out[np.arange(len(a)) + owner] = scan.hasher(fold=True)(a, b)
    return out, count


def contexts(ids: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; ``start`` at the beginning of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(counts) - counts] = start
    return out


# ------------------------------------------------------------------ exchange
SENT_SQL = "owner int, n long, rice int, gaps binary, counts binary"
SENT = pa.schema([("owner", pa.int32()), ("n", pa.int64()), ("rice", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])


def _pack(owner: int, keys: np.ndarray, counts: np.ndarray, low: int, span: int) -> tuple:
    gaps, rice = encode_gaps(keys, low, span)
    return owner, len(keys), rice, gaps, zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpack(rows: list[dict], low: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all rows, and the sums of their counts."""
    keys = np.concatenate([decode_gaps(x["gaps"], x["n"], x["rice"], low) for x in rows])
    counts = np.concatenate([np.frombuffer(zlib.decompress(x["counts"]), "<u4") for x in rows])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _counted(chunks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts, of at most about ``FLUSH_TOKENS`` keys at a time."""
    held, n = [], 0
    for keys in chunks:
        held.append(keys)
        n += len(keys)
        if n >= FLUSH_TOKENS:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def _rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SENT.types, strict=True)], schema=SENT)


def _send_words(owners: int):
    low = _lows(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (sequences(byte_texts(b.column("text")))[0] for b in slices(batches))
        for keys, counts in _counted(chunks):
            cuts = np.append(np.searchsorted(keys, low), len(keys))
            yield from _rows(_pack(o, keys[a:b], counts[a:b], int(low[o]), (1 << 64) // owners)
                             for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a)
    return run


def _own_words(path: str, owners: int):
    low, hot = _lows(owners), SHARD_TOKENS // 4

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        owner = rows[0]["owner"]
        keys, counts = _unpack(rows, int(low[owner]))
        publish(path, {f"word-{owner}": keys, f"count-{owner}": counts})
        often = np.flatnonzero(counts >= hot)
        return pa.table({"owner": [owner], "n": [len(keys)], "total": [int(counts.sum())], "often": [often.tolist()]},
                        schema=pa.schema([("owner", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("often", pa.list_(pa.int64()))]))
    return run


def _send_pairs(model: Model, hot: list[int]):
    split = np.array(sorted(hot), np.int64)
    base, shards = model.size + 1, model.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(model.folder, tuple(model.offsets))

        def chunks():
            for b in slices(batches):
                tokens, counts = sequences(byte_texts(b.column("text")))
                seen, back = np.unique(tokens, return_inverse=True)
                ids = words.ids(seen)[back]
                yield (contexts(ids, counts, model.size) * base + ids).astype(U)

        for keys, counts in _counted(chunks()):
            signed = keys.astype(np.int64)
            where = _shard(shards, signed // base, signed, split)
            yield from _rows(_pack(int(s), keys[mine], counts[mine], 0, base * base)
                             for s in np.unique(where) for mine in (where == s,))
    return run


FOUND = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.list_(pa.int64())), *list(SENT)])
FOUND_SQL = f"kind string, a long, b array<long>, {SENT_SQL}"


def _bins(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and 3 or more."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum())]


def _own_pairs(model: Model, hot: list[int]):
    split, base, offsets = np.array(sorted(hot), np.int64), model.size + 1, model.offsets

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        shard = rows[0]["owner"]
        keys, counts = _unpack(rows, 0)
        context, word = (x.astype(np.int64) for x in np.divmod(keys, U(base)))
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        stat = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in
                         (counts, counts == 1, counts == 2, counts > 2)], axis=1)
        context = context[first]
        part = np.isin(context, split)
        publish(model.folder, {f"pair-{shard}": keys.astype(np.int64), f"times-{shard}": counts.astype(np.uint32),
                               f"context-{shard}": context[~part], f"stat-{shard}": stat[~part].astype(np.int32)})
        nothing = (None,) * 5
        out = [("shard", shard, [len(keys), *_bins(counts)], *nothing)]
        out += [("hot", int(c), s.tolist(), *nothing) for c, s in zip(context[part], stat[part], strict=True)]
        words, after = np.unique(word, return_counts=True)
        cuts = np.searchsorted(words, offsets)
        for o, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if y > x:
                out.append(("after", o, None, *_pack(o, words[x:y].astype(U), after[x:y], offsets[o], offsets[o + 1] - offsets[o])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND)
    return run


def _own_after(model: Model):
    offsets = model.offsets

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        owner = rows[0]["owner"]
        keys, counts = _unpack(rows, offsets[owner])
        after = np.zeros(offsets[owner + 1] - offsets[owner], np.int64)
        after[keys.astype(np.int64) - offsets[owner]] = counts
        publish(model.folder, {f"after-{owner}": after})
        return pa.table({"b": [[int(after.sum()), *_bins(after)]]}, schema=pa.schema([("b", pa.list_(pa.int64()))]))
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more; the usual halves where a class is empty."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), i) for i, d in enumerate(raw, 1))


def learn(train: DataFrame) -> Model:
    """Count the texts of ``train`` and write the model's arrays to the shared folder."""
    spark = train.sparkSession
    texts = train.select(text_of(train).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 1)).head()[0] or 0
    path = mounted(shared_folder(spark, "model"))
    if not size:
        return Model(path)
    owners = -(-size // OWNER_BYTES)
    sent = texts.mapInArrow(frugal(_send_words(owners)), SENT_SQL)
    found = {r["owner"]: r for r in sent.groupBy("owner").applyInArrow(
        _own_words(path, owners), "owner int, n long, total long, often array<long>").collect()}
    if len(found) < owners:  # a range of hashes without any word
        for o in set(range(owners)) - set(found):
            publish(path, {f"word-{o}": np.zeros(0, U), f"count-{o}": np.zeros(0, np.int64)})
    offsets = np.cumsum([0, *(found[o]["n"] if o in found else 0 for o in range(owners))]).tolist()
    model = Model(path, offsets, sum(r["total"] for r in found.values()))
    model.shards = -(-model.tokens // SHARD_TOKENS)
    # The context of beginnings may be as frequent as there are texts; it is split like the others.
    hot = [offsets[o] + i for o, r in found.items() for i in r["often"]] + [model.size]
    pairs = texts.mapInArrow(frugal(_send_pairs(model, hot), _words_of), SENT_SQL)
    parts = written(pairs.groupBy("owner").applyInArrow(_own_pairs(model, hot), FOUND_SQL))
    bins = np.zeros(6, np.int64)
    seen = set()
    for r in parts.where("kind = 'shard'").select("a", "b").collect():
        bins += r["b"]
        seen.add(r["a"])
    for s in set(range(model.shards)) - seen:
        publish(path, {f"pair-{s}": np.zeros(0, np.int64), f"times-{s}": np.zeros(0, np.uint32),
                       f"context-{s}": np.zeros(0, np.int64), f"stat-{s}": np.zeros((0, 4), np.int32)})
    model.kinds, model.pair_off = int(bins[0]), discounts(*bins[1:5].tolist())
    split = parts.where("kind = 'hot'").groupBy("a").agg(*[F.sum(F.col("b")[i]).alias(f"s{i}") for i in range(4)])
    model.hot = {r[0]: tuple(r[1:]) for r in split.collect()}
    ends = np.zeros(6, np.int64)
    sizes = parts.where("kind = 'after'").select(*SENT.names).groupBy("owner").applyInArrow(_own_after(model), "b array<long>")
    for r in sizes.collect():
        ends += r["b"]
    for o in range(owners):
        if o not in found:
            publish(path, {f"after-{o}": np.zeros(0, np.int64)})
    model.word_off = discounts(*ends[1:5].tolist())
    model.spare = sum(d * n for d, n in zip(model.word_off, (ends[1], ends[2], ends[5]), strict=True)) / ends[0]
    return model


# ------------------------------------------------------------------ scoring
def probabilities(model: Model, arrays: Arrays, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """p(word | context) for pairs of ids; -1 is unknown."""
    flat = np.full(len(word), model.spare / (model.size + 1))
    if not model.kinds:
        return flat
    ids, back = np.unique(word, return_inverse=True)
    after = arrays.per_word(arrays.after, ids)
    off = np.array([0.0, *model.word_off])[np.minimum(after, 3)]
    p = flat + (np.maximum(after - off, 0) / model.kinds)[back]
    ask = np.flatnonzero(context >= 0)
    count, stat = arrays.find(context[ask], context[ask] * (model.size + 1) + np.maximum(word[ask], 0))
    count[word[ask] < 0] = 0
    seen = stat[:, 0] > 0
    total = np.maximum(stat[:, 0], 1)
    own = np.maximum(count - np.array([0.0, *model.pair_off])[np.minimum(count, 3)], 0) / total
    left = (stat[:, 1:] @ np.array(model.pair_off)) / total
    p[ask] = np.where(seen, own + left * p[ask], p[ask])
    return p


def _score(model: Model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays(model)
        base = BASE_ADD * (model.size + 1) + model.tokens
        for b in slices(batches):
            tokens, counts = sequences(byte_texts(b.column("text")))
            text = np.repeat(np.arange(b.num_rows), counts)
            seen, back = np.unique(tokens, return_inverse=True)
            ids = arrays.ids(seen)
            order = np.argsort(ids, kind="stable")
            known = np.zeros(len(ids), np.int64)
            known[order] = arrays.per_word(arrays.counts, ids[order])
            flat = np.log10((known + BASE_ADD) / base)[back]
            word = ids[back]
            context = contexts(word, counts, model.size)
            pair, where = np.unique((context + 1) * (model.size + 2) + word + 1, return_inverse=True)
            left, right = np.divmod(pair, model.size + 2)
            p = np.log10(probabilities(model, arrays, left - 1, right - 1))[where]
            yield as_batch({
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": counts,
                "n_known": np.bincount(text, known[back] > 0, b.num_rows).astype(np.int64),
                "train_tokens": np.full(b.num_rows, model.tokens), "base_score": np.bincount(text, flat, b.num_rows),
                "score": np.bincount(text, p, b.num_rows)}, schema)
    return run


OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, modulus: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rest = F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus
    rows = docs.select(docs["doc_id"], F.coalesce(rest == 0, F.lit(False)).alias("held_out"), text_of(docs).alias("text"))
    name = rows.dtypes[0][1]
    kind = rows.limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return rows.mapInArrow(frugal(_score(model, schema)), f"doc_id {name}, held_out boolean, {OUT}")


def language_model_scores(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """Scores of all of ``docs`` by a model of those whose id's crc32 is no multiple of ``modulus``."""
    rest = F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus
    return score(docs, learn(docs.where(rest != 0)), modulus)
