"""Alignment of two tokenizers' tokens by interval coalescing.

Every text is encoded by tokenizer A (byte-level BPE, of a space and the text) and by B (pieces with byte fallback,
which puts the space itself). Token bytes laid end to end give both the same line, so tokens are intervals on it:

1. All A and B tokens of many texts are lexsorted by start; ``maximum.accumulate`` over their ends gives how far the
   tokens so far reach, and a group breaks where a start reaches that. Inside a group the overlapping pairs, the
   links, are expanded: for each A token the run of B tokens that begin before its end and end after its start.
2. Links are counted over the whole corpus. A task numbers the id pairs it meets in a dictionary (a new one beyond
   ``WORDS`` pairs), keeps for each document how often it holds each number, compressed, and hands the dictionary
   with its counts to one shuffle, which adds them up and marks the pairs of the highest count of their B id.
3. Totals go back to the dictionaries that hold the pair and meet their documents there. Only dictionaries and
   compressed numbers are shuffled, never texts or tokens, and each text is encoded once.

A task holds one dictionary and one slice of texts. Dictionaries of equal size have no hot key: a pair is in each of
them once at most, whatever its count.

A's ids are those of the ``tokenizers`` library. Where all characters of a text are of a class that no version of
Unicode has changed (``_PLAIN``), the faster ``tiktoken`` encodes it with ranks from the same file.

Defined cases: a null or empty text, and one whose bytes the tokens of A or B do not give back (a written-out space
mark U+2581, or invalid UTF-8), has no tokens: counts are zero and the digest is the empty string. Rows that share a
doc_id, or have none, are told apart. Other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, frugal, join_small, kept_in_worker, partitions, slices, text_of, written

#: Pairs of one dictionary.
WORDS = 1 << 20
#: Bytes of text that are encoded and aligned at a time.
SLICE = 1 << 20
#: Where byte-level BPE splits a text before merging (a fixed value of such vocabularies).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin, Cyrillic, kana, unified ideographs and general punctuation.
_PLAIN = re.compile("[\x00-ɏА-я‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥]*")


def default_models() -> tuple[str, str]:
    """Paths of the public vocabularies A and B that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies spell it: printable ones spell themselves, the
    others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec, alphabet = json.loads(a), byte_alphabet()
        special = {x["id"] for x in spec["added_tokens"]}
        vocabulary = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.exact = Tokenizer.from_str(a.decode())
        self.exact.encode_special_tokens = True
        # Ranks stand for merges only if every merge made the next id.
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        ranked = all(ids[x + y] == 256 + i for i, (x, y) in enumerate(merges))
        self.fast = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks={v: k for k, v in vocabulary.items()},
                                      special_tokens={}) if ranked else None
        self.bytes_a = [vocabulary.get(i, b"") for i in range(max(ids.values()) + 1)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode()
                        for i, n in enumerate(names)]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64)
        self.n = max(len(self.bytes_a), len(self.bytes_b))
        self.spelt = np.array([f"{i}{s}" for s in (",", "|", ";", "") for i in range(self.n)], object)

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each text; none where they do not spell the text."""
        plain = [t.decode(errors="replace") for t in texts]
        a: list = [None] * len(texts)
        slow = [i for i, t in enumerate(plain) if self.fast is None or not _PLAIN.fullmatch(t)]
        for i, e in zip(slow, self.exact.encode_batch([" " + plain[i] for i in slow], add_special_tokens=False), strict=True):
            a[i] = e.ids
        b = self.pieces.encode(plain, num_threads=1)
        for i, raw in enumerate(texts):
            if a[i] is None:
                a[i] = self.fast.encode_ordinary(" " + plain[i])
            whole = b" " + raw
            if not raw or any(b"".join(map(spell.__getitem__, ids)) != whole for spell, ids in (
                    (self.bytes_a, a[i]), (self.bytes_b, b[i]))):
                a[i] = b[i] = []
        return a, b


def coalesce(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Group of each interval: groups break where a start reaches the running maximum of the ends before."""
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    first = np.zeros(len(order), np.int64)
    first[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first)
    return group


class Aligned:
    """Groups and links of a list of texts."""

    def __init__(self, model: Aligner, texts: list[bytes]):
        a, b = model.encode(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, self.n_a), (b, self.n_b)))
        end_a, end_b = np.cumsum(model.size_a[ids_a]), np.cumsum(model.size_b[ids_b])
        start_a, start_b = end_a - model.size_a[ids_a], end_b - model.size_b[ids_b]
        # Texts lie end to end on one line, so no group spans two of them.
        kind = np.repeat(np.arange(2), (len(ids_a), len(ids_b)))
        group = coalesce(np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b)), kind)
        doc = np.repeat(np.arange(len(texts)), self.n_a)
        heads = np.flatnonzero(np.diff(group[:len(ids_a)], prepend=-1))
        self.n_groups = np.bincount(doc[heads], minlength=len(texts))
        # Every group has both kinds; inside it, each A token links to a run of B tokens.
        low = np.searchsorted(end_b, start_a, side="right")
        count = np.searchsorted(start_b, end_a, side="left") - low
        left = np.repeat(np.arange(len(ids_a)), count)
        right = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(left))
        self.doc = doc[left]
        self.n_links = np.bincount(self.doc, minlength=len(texts))
        self.pairs = ids_a[left] << 32 | ids_b[right]
        self._spell(model, np.concatenate((ids_a, ids_b)), 2 * group + kind, np.concatenate(
            (doc, np.repeat(np.arange(len(texts)), self.n_b))))

    def _spell(self, model: Aligner, ids: np.ndarray, place: np.ndarray, doc: np.ndarray) -> None:
        order = np.argsort(place, kind="stable")
        place, doc = place[order], doc[order]
        sign = np.full(len(order), 2)
        sign[:-1][place[1:] == place[:-1]] = 0
        sign[:-1][(place[1:] == place[:-1] + 1) & (place[:-1] % 2 == 0)] = 1
        if len(order):
            sign[np.append(np.flatnonzero(np.diff(doc)), len(order) - 1)] = 3
        spelt = model.spelt[sign * model.n + ids[order]]
        edges = np.searchsorted(doc, np.arange(len(self.n_a) + 1)).tolist()
        self.groups = ["".join(spelt[x:y].tolist()) for x, y in zip(edges, edges[1:], strict=False)]


@kept_in_worker
@lru_cache(1)
def _loaded(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


class _Dictionary:
    """Numbers of id pairs in order of arrival, with their counts."""

    def __init__(self):
        self.keys, self.number, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct ``keys``, new ones added; their counts are added up."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        fresh = np.arange(int((~known).sum())) + len(self.keys)
        self.keys = np.insert(self.keys, at[~known], keys[~known])
        self.number = np.insert(self.number, at[~known], fresh)
        self.total = np.concatenate((self.total, np.zeros(len(fresh), np.int64)))
        mine = self.number[np.searchsorted(self.keys, keys)]
        self.total[mine] += counts
        return mine


_TABLE = [("doc_id", None, None), ("book", pa.int64(), "long"), ("n_a", pa.int64(), "long"), ("n_b", pa.int64(), "long"),
          ("n_groups", pa.int64(), "long"), ("n_links", pa.int64(), "long"), ("groups", pa.string(), "string"),
          ("numbers", pa.binary(), "binary"), ("times", pa.binary(), "binary"),
          ("number", pa.int64(), "long"), ("pair", pa.int64(), "long"), ("total", pa.int64(), "long")]


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), "<u4").astype(np.int64)


def _encode(sent, schema: pa.Schema, words: int, spelt: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(*sent.value)
        book, entries = TaskContext.get().partitionId() << 24, _Dictionary()

        def table(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if c is None
                 else pa.array(c, f.type) for f in schema], schema=schema)

        def written_out() -> Iterator[pa.RecordBatch]:
            order = np.argsort(entries.number)
            for at in range(0, len(order), 1 << 16):
                part = order[at:at + (1 << 16)]
                yield table(len(part), {"book": np.full(len(part), book), "number": entries.number[part],
                                        "pair": entries.keys[part], "total": entries.total[entries.number[part]]})

        for b in slices(batches, size=SLICE):
            found = Aligned(model, byte_texts(b.column("text")))
            keys, link, counts = np.unique(found.pairs, return_inverse=True, return_counts=True)
            number = entries.take(keys, counts)
            # Distinct numbers of each text, ascending, as gaps, and how often it holds each.
            code, times = np.unique(found.doc << 32 | number[link], return_counts=True)
            doc, number = code >> 32, code & 0xFFFFFFFF
            gaps = np.diff(number, prepend=0)
            head = np.flatnonzero(np.diff(doc, prepend=-1))
            gaps[head] = number[head]
            edges = np.searchsorted(doc, np.arange(b.num_rows + 1)).tolist()
            cuts = list(zip(edges, edges[1:], strict=False))
            names = found.groups if spelt else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
            yield table(b.num_rows, {
                "doc_id": b.column("doc_id"), "book": np.full(b.num_rows, book), "n_a": found.n_a, "n_b": found.n_b,
                "n_groups": found.n_groups, "n_links": found.n_links, "groups": names,
                "numbers": [_packed(gaps[x:y]) for x, y in cuts], "times": [_packed(times[x:y]) for x, y in cuts],
                "total": [y - x for x, y in cuts]})
            if len(entries.keys) >= words:
                yield from written_out()
                book, entries = book + 1, _Dictionary()
        yield from written_out()
    return run


def _sums(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by dictionary, its entries first, by number."""
        book, parts, count, best = None, [], None, None
        for b in batches:
            books = b.column("book").to_numpy()
            entry = b.column("number").is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(books) != 0) | (np.diff(entry.astype(int)) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if books[lo] != book:
                    book, parts, count = books[lo], [], None
                if entry[lo]:
                    parts.append((part.column("total").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if count is None:
                    count, best = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
                sums, bests = [], []
                for n, numbers, times in zip(part.column("total").to_pylist(), part.column("numbers"), part.column("times"), strict=True):
                    number, time = np.cumsum(_unpacked(numbers.as_py(), n)), _unpacked(times.as_py(), n)
                    sums.append(int((count[number] * time).sum()))
                    bests.append(int(time[best[number]].sum()) if n else 0)
                keep = [part.column(x) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), part.column("groups")], schema=schema)
    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, total, best`` of rows (pair, total): counts added up, ``best`` for the highest of their B id (a B id
    has no more pairs than A has ids)."""
    totals = pairs.groupBy("pair").agg(F.sum("total").alias("total"))
    other = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(other))


def align(docs: DataFrame, models: tuple[str, str] | None = None, words: int = WORDS, spelt: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
    their B id), count_sum (counts of all links added up) and ``groups`` (`a1,a2|b1;a3|b2`), or its SHA-256."""
    spark = docs.sparkSession
    blobs = []
    for path in models or default_models():
        with open(path, "rb") as f:
            blobs.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(blobs))
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    kind, sql = rows.limit(0).toArrow().schema.field(0).type, rows.dtypes[0][1]
    schema = pa.schema([(n, t or kind) for n, t, _ in _TABLE])
    coded = written(rows.mapInArrow(frugal(_encode(sent, schema, words, spelt), _loaded),
                                    ", ".join(f"{n} {t or sql}" for n, _, t in _TABLE)))
    entries = coded.where("number is not null").select("book", "number", "pair", "total")
    counts = written(pair_counts(entries.select("pair", "total")))
    answers = join_small(entries.drop("total"), counts, ["pair"]).drop("pair")
    texts = coded.where("number is null").drop("number", "pair")
    both = answers.unionByName(texts, allowMissingColumns=True).repartition(partitions(docs), "book").sortWithinPartitions(
        "book", F.asc_nulls_last("number"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    out = pa.schema([(n, kind if n == "doc_id" else pa.string() if n == "groups" else pa.int64()) for n in columns])
    return both.mapInArrow(frugal(_sums(out)), ", ".join(
        f"{n} {sql if n == 'doc_id' else 'string' if n == 'groups' else 'long'}" for n in columns))
