"""Substring deduplication by sliding sentence spans.

A sentence ends with a word that ends in ``. ! ?`` (or their full-width forms), or at a line's end. A span is
the shortest run of consecutive sentences from a sentence on, or back from a sentence's end, that has at least
``LEAST_WORDS`` words, whatever white space lies between the words. The spans inside a longer run cover all of
it from head to tail, so every repeated run of that many words goes, a single long sentence included, as if all
runs had been hashed. A span's 64-bit hash is that of its word sequence, so passages of the same sentences have
the same spans wherever they stand. Spans of all documents are grouped by hash; in each group the first occurrence (smallest doc_id, then earliest in the text) stays,
and every sentence that a later occurrence covers is removed.

Grouping adds up smallest ids and counts inside each task first and is joined back on plain exchanges,
so a span that a third of all documents share is split over tasks, never gathered.

Defined cases: a null or blank text has no sentences and stays as it is (null gives an empty text). Rows
that share a doc_id count as one document (a null id is smallest), so spans are not removed from one for
the other's sake; what is removed from a row depends on its own text only. Text without sentence ends is one sentence to the end of its line; a run of sentences
shorter than ``LEAST_WORDS`` words in all has no span. Line ends that cut the same words into other sentences make
other spans; of such passages only the runs that end alike go. Without ``every_run`` a span has at least
``LEAST_SENTENCES`` sentences and only runs from a sentence on are hashed. Other columns, of any name, play no part. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import Scan, mix, prefix_runs
from .common import as_batch, byte_texts, cut, frugal, join_small, slices, text_of, written

LEAST_SENTENCES = 2
LEAST_WORDS = 20
_NO_ID = -(1 << 63)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_WIDE = ["。".encode(), "！".encode(), "？".encode()]


class Sentences:
    """Sentences of many texts: ``first`` and ``stop`` are word indices, ``text`` the owner, ``begin`` and
    ``end`` byte positions (with the white space that follows)."""

    def __init__(self, texts: list[bytes]):
        self.scan = scan = Scan(texts)
        a, b = scan.words()
        self.words = scan.hasher()(a, b)
        owner = scan.text_of(a)
        data = scan.data
        last = _ENDS[data[b - 1]] if len(a) else np.zeros(0, bool)
        for mark in _WIDE:
            wide = b - a >= 3
            for k in range(3):
                wide = wide & (data[np.maximum(b - 3 + k, 0)] == mark[k])
            last = last | wide
        breaks = np.cumsum(data == 10)
        final = np.ones(len(a), bool)
        final[:-1] = last[:-1] | (breaks[a[1:]] > breaks[b[:-1] - 1]) | (owner[1:] != owner[:-1])
        self.stop = np.flatnonzero(final) + 1
        self.first = np.concatenate(([0], self.stop[:-1])) if len(self.stop) else self.stop
        self.text = owner[self.first]
        self.begin = a[self.first]
        self.end = scan.end[self.text].copy()
        inner = np.flatnonzero(self.text[1:] == self.text[:-1])
        self.end[inner] = self.begin[inner + 1]
        self.per_text = np.bincount(self.text, minlength=scan.n)
        self.offset = np.cumsum(self.per_text) - self.per_text

    def spans(self, every_run: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, sentence after the last, hash) of every span, by place."""
        at = np.arange(len(self.first))
        least = 1 if every_run else LEAST_SENTENCES
        after = np.maximum(np.searchsorted(self.stop, self.first + LEAST_WORDS), at + least - 1) + 1
        ok = after <= (self.offset + self.per_text)[self.text]
        if every_run:
            back = np.searchsorted(self.first, self.stop - LEAST_WORDS, side="right") - 1
            mine = back >= self.offset[self.text]
            n = len(at) + 1
            # A run found both ways is one span.
            both = np.unique(np.concatenate((at[ok] * n + after[ok], back[mine] * n + at[mine] + 1)))
            at, after = np.divmod(both, n)
        else:
            at, after = at[ok], after[ok]
        return at, after, prefix_runs(self.words, self.first[at], self.stop[after - 1])


SPANS = pa.schema([("span", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("after", pa.int32()),
                   ("again", pa.bool_())])


def _emit(every_run: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = Sentences(byte_texts(b.column("text")))
            at, after, span = s.spans(every_run)
            if not len(at):
                continue
            text = s.text[at]
            own = mix(span ^ mix(text.astype(np.uint64) + np.uint64(1)))  # one value per span and text
            _, first = np.unique(own, return_index=True)
            again = np.ones(len(at), bool)
            again[first] = False  # the earliest of its text
            doc, own_hash = (b.column(n).to_numpy()[text] for n in ("doc", "hash"))
            yield as_batch({"span": span.view(np.int64), "doc": doc, "hash": own_hash, "at": (at - s.offset[text]).astype(np.int32),
                            "after": (after - s.offset[text]).astype(np.int32), "again": again}, SPANS)
    return run


CLEAN = ("n_sentences long, n_removed long, removed array<struct<start:int,stop:int>>, text string")


def _clean(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = byte_texts(b.column("text"))
            s = Sentences(texts)
            covers = b.column("covers").to_pylist()
            gone, spans, out = np.zeros(len(texts), np.int64), [], []
            for t, (text, cover) in enumerate(zip(texts, covers, strict=True)):
                if not cover:
                    spans.append([])
                    out.append(text.decode(errors="replace"))
                    continue
                n, lo = int(s.per_text[t]), int(s.offset[t])
                mark = np.zeros(n + 1, np.int64)
                for c in cover:
                    mark[c >> 32] += 1
                    mark[c & 0xFFFFFFFF] -= 1
                dead = np.cumsum(mark)[:n] > 0
                gone[t] = dead.sum()
                edge = np.flatnonzero(np.diff(np.concatenate(([False], dead, [False]))))
                begin = s.begin[lo:lo + n] - s.scan.at[t]
                end = s.end[lo:lo + n] - s.scan.at[t]
                holes = [(int(begin[x]), int(end[y - 1])) for x, y in zip(edge[0::2], edge[1::2], strict=True)]
                parts, place = [], 0
                for x, y in holes:
                    parts.append(text[place:x])
                    place = y
                out.append(b"".join([*parts, text[place:]]).decode(errors="replace"))
                spans.append([{"start": len(text[:x].decode(errors="replace")),
                               "stop": len(text[:y].decode(errors="replace"))} for x, y in holes])
            yield as_batch({"doc_id": b.column("doc_id"), "n_sentences": s.per_text, "n_removed": gone,
                            "removed": spans, "text": out}, schema)
    return run


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID))


def remove_repeated_spans(docs: DataFrame, every_run: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_removed, removed (ranges of code points) and the
    text that is left. With ``every_run`` all repeated runs of ``LEAST_WORDS`` words go, not only those that
    shortest runs from a sentence on make up."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], _doc(docs).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    spans = written(rows.select("doc", "hash", "text").mapInArrow(
        frugal(_emit(every_run)), "span long, doc long, hash long, at int, after int, again boolean"))
    shared = cut(spans.groupBy("span").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").drop("n"))
    # Never broadcast: one way for any number of shared spans, between bare exchanges.
    later = spans.join(shared.hint("merge"), "span").where((F.col("doc") > F.col("first")) | F.col("again"))
    # Ranges belong to a text of an id, not to the id: its other rows may hold other texts.
    covers = written(later.groupBy("doc", "hash").agg(F.collect_set(
        F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("after").cast("long"))).alias("covers")))
    touched = covers.select("doc", "hash")
    none = F.array().cast("array<long>")
    # Untouched texts need no join with the ranges.
    hit = join_small(rows, touched, ["doc", "hash"], "left_semi").join(covers, ["doc", "hash"]).select("doc_id", "text", "covers")
    rest = join_small(rows, touched, ["doc", "hash"], "left_anti").select("doc_id", "text", none.alias("covers"))
    name = rows.dtypes[0][1]
    kind = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("doc_id", kind), ("n_sentences", pa.int64()), ("n_removed", pa.int64()),
                        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                        ("text", pa.string())])
    return hit.unionByName(rest).mapInArrow(frugal(_clean(schema)), f"doc_id {name}, {CLEAN}")
