"""Quality of documents by labelling their lines as content or boilerplate.

Every line that has a word gets categorical features (length, final punctuation, symbols, bars, capitals,
repetition, place in the text, and the same of its neighbours). A linear-chain conditional random field
(``crf.py``) labels the lines of a text together, by Viterbi decoding. A text stays if lines labelled
content hold at least ``CONTENT_SHARE`` of its words and the two base rules do not fail it.

The field is fitted on the driver to lines of a bounded sample: ``SAMPLE_TEXTS`` texts of each quality in
``labels``, picked by a hash of the id, none above ``SAMPLE_CHARS`` characters, and to texts spliced from a
good and a bad one of them, so that changes between the labels are seen. All counts are exact and come from
whole texts inside the scan tasks, without a shuffle.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null or blank text has no words, so it fails. Without
labels to learn from, the base rules decide alone. Repeated rows and null ids are judged by their own text.
Other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import top_per_group
from .bytescan import Scan, inside, mix, runs
from .common import as_batch, byte_texts, frugal, join_small, slices, text_of
from .crf import ChainCRF, fit

SAMPLE_TEXTS = 400
SAMPLE_CHARS = 20_000
CONTENT_SHARE = 0.5
WINDOW = 8               # words of a window that counts as repeated
LEAST_WORDS = 20
REPEAT_PERCENT = 30
CONTENT, BOILERPLATE = 0, 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_BAR = np.zeros(256, np.int64)
_BAR[ord("|")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!:;\"'"]] = True
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1
CARDS = [8, 2, 5, 4, 4, 3, 4, 5, 5, 4]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


class Lines:
    """Exact counts of texts, and the features of their lines that have a word."""

    def __init__(self, texts: list[bytes]):
        self.scan = scan = Scan(texts)
        data = scan.data
        a, b = scan.words()
        self.owner = owner = scan.text_of(a)
        n = scan.n
        self.n_words = np.bincount(owner, minlength=n)
        heads = _sums((data & 0xC0) != 0x80)
        self.word_chars = np.bincount(owner, heads[b] - heads[a], n).astype(np.int64)
        symbols = _sums(_SYMBOL[data])
        self.n_symbols = symbols[scan.end] - symbols[scan.at]
        starts, ends = scan.lines()
        line_of = np.searchsorted(starts, a, side="right") - 1
        self.words = words = np.bincount(line_of, minlength=len(starts))
        full = np.flatnonzero(words)
        starts, ends, words = starts[full], ends[full], words[full]
        text = np.searchsorted(scan.at, starts, side="right") - 1
        own = mix(scan.hasher()(starts, ends) ^ mix(text.astype(np.uint64) + np.uint64(1)))
        _, first = np.unique(own, return_index=True)
        dup = np.ones(len(own), bool)
        dup[first] = False
        self.n_dup_lines = np.bincount(text[dup], minlength=n)
        self.n_repeat_words = self._repeats(scan.hasher()(a, b), owner, n)
        self.line_text, self.line_words = text, words
        self.per_text = np.bincount(text, minlength=n)
        self.features = self._features(data, starts, ends, words, text, dup, symbols)

    @staticmethod
    def _repeats(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        ok = inside(owner, WINDOW)
        window = runs(words, WINDOW)
        at = np.flatnonzero(ok)
        own = mix(window[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        mark = np.zeros(len(words) + 1, np.int64)
        mark[at[twice]] += 1
        np.subtract.at(mark, at[twice] + WINDOW, 1)
        covered = np.cumsum(mark)[:len(words)] > 0
        return np.bincount(owner[covered], minlength=n)

    def _features(self, data, starts, ends, words, text, dup, symbols) -> np.ndarray:
        def counts(table):
            total = _sums(table[data])
            return total[ends] - total[starts]

        size = np.maximum(ends - starts, 1)
        symbol = np.digitize((symbols[ends] - symbols[starts]) / size, [0.001, 0.02, 0.06, 0.12])
        bar = np.digitize(counts(_BAR) / words, [0.001, 0.2, 0.4])
        upper, lower = counts(_UPPER), counts(_LOWER)
        caps = np.digitize(upper / np.maximum(upper + lower, 1), [0.001, 0.15, 0.6])
        shout = np.digitize(counts(_SHOUT) / words, [0.05, 0.5])
        tail = ends.copy()  # last byte that is no white space: the end of the last word
        last = np.cumsum(np.bincount(np.searchsorted(starts, self.scan.words()[0], side="right") - 1,
                                     minlength=len(starts))) - 1 if len(starts) else np.zeros(0, np.int64)
        if len(starts):
            tail = self.scan.words()[1][last]
        stop = _STOP[data[tail - 1]].astype(np.int64)
        length = np.digitize(words, [2, 4, 7, 12, 20, 40, 80])
        place = np.arange(len(starts)) - (np.cumsum(self.per_text) - self.per_text)[text]
        rest = self.per_text[text] - 1 - place
        spot = np.where(self.per_text[text] == 1, 3, np.where(place == 0, 0, np.where(rest == 0, 2, 1)))
        before, after = np.full(len(starts), 4), np.full(len(starts), 4)
        if len(starts) > 1:
            same = np.flatnonzero(text[1:] == text[:-1])
            kind = np.minimum(symbol, 3)
            before[same + 1] = kind[same]
            after[same] = kind[same + 1]
        return np.stack([length, dup.astype(np.int64), symbol, bar, caps, shout, stop + 2 * (length < 2),
                         before, after, spot], axis=1)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``quality, text`` of a bounded sample of labelled texts."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"),
        F.xxhash64("doc_id").alias("order"))
    # Twice as many as needed are picked: not every text is short enough.
    some = top_per_group(marks, ["quality"], [F.col("order"), F.col("id")], 2 * SAMPLE_TEXTS).drop("rank")
    texts = docs.select(docs["doc_id"].alias("id"), text_of(docs).alias("text"))
    found = join_small(texts, some, ["id"]).where(F.length("text") <= SAMPLE_CHARS)
    return top_per_group(found, ["quality"], [F.col("order"), F.col("id"), F.col("text")], SAMPLE_TEXTS).select("quality", "text")


def _worded(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if _WORD.search(line)]


def splice(good: list[bytes], bad: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Texts made of a good and a bad one, in turn one after the other, the other way round, and the bad
    one in the middle of the good one; and the labels of their lines that have a word."""
    texts, marks = [], []
    for i, (a, b) in enumerate(zip(good, bad, strict=False)):
        a, b = _worded(a), _worded(b)
        at = (len(a), 0, len(a) // 2)[i % 3]
        texts.append(b"\n".join(a[:at] + b + a[at:]))
        marks.append(np.repeat([CONTENT, BOILERPLATE, CONTENT], [at, len(b), len(a) - at]))
    return texts, marks


def learn(docs: DataFrame, labels: DataFrame) -> ChainCRF | None:
    """The field fitted to the sample; None unless it has texts of both qualities."""
    rows = sorted((r["quality"], r["text"].encode()) for r in training_rows(docs, labels).collect())
    good, bad = ([t for q, t in rows if q == k] for k in (1, 0))
    if not good or not bad:
        return None
    mixed, marks = splice(good, bad)
    lines = Lines([*bad, *good, *mixed])
    own = [np.full(n, BOILERPLATE if i < len(bad) else CONTENT)
           for i, n in enumerate(lines.per_text[:len(rows)])]
    sequences = []
    for label, end in zip([*own, *marks], np.cumsum(lines.per_text), strict=True):
        first = end - len(label)
        for at in range(0, len(label), 64):  # long texts are learned from in parts
            part = label[at:at + 64]
            sequences.append((lines.features[first + at:first + at + len(part)], part))
    return fit(sequences, CARDS, 2)


OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, content_share double, kept boolean")


def _judge(model: ChainCRF | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = Lines(byte_texts(b.column("text")))
            failed = (x.n_words < LEAST_WORDS) | (100 * x.n_repeat_words > REPEAT_PERCENT * x.n_words)
            share = np.ones(b.num_rows)
            if model is not None:
                label = model.decode(model.scores(x.features), x.per_text[x.per_text > 0])
                good = np.bincount(x.line_text[label == CONTENT], x.line_words[label == CONTENT], b.num_rows)
                share = good / np.maximum(x.n_words, 1)
            yield as_batch({
                "doc_id": b.column("doc_id"), "key": b.column("key"), "n_words": x.n_words,
                "word_chars": x.word_chars, "n_symbols": x.n_symbols, "n_dup_lines": x.n_dup_lines,
                "n_repeat_words": x.n_repeat_words, "base_failed": failed, "content_share": share,
                "kept": ~failed & (share >= CONTENT_SHARE)}, schema)
    return run


def judge(docs: DataFrame, model: ChainCRF | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), the counts, base_failed,
    content_share (of the words) and kept."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("key"), text.alias("text"))
    name = rows.dtypes[0][1]
    kind = rows.limit(0).toArrow().schema.field(0).type
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([("doc_id", kind), ("key", pa.int64()),
                        *((n, types[t]) for n, t in (f.split() for f in OUT.split(", ")))])
    return rows.mapInArrow(frugal(_judge(model, schema)), f"doc_id {name}, key long, {OUT}")
