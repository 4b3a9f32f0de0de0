"""Language identification with a byte convolutional network.

The network (``byte_cnn.py``) is fitted on the driver to a bounded sample: ``SAMPLE_TEXTS`` distinct
texts of each label, or all if there are fewer, ``SAMPLE_WINDOWS`` windows of each text, picked by a hash of the text. Labels are a
closed set of language codes, so the sample is a few megabytes however many documents there are.
Prediction reads every byte of every text in windows of 256 bytes inside the scan tasks, without a
shuffle; a text's score is the softmax of its windows' mean log-probabilities, weighted by bytes.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, as is every text
when no labelled text can be learned from. Rows with a null label, null or letterless text are not
learned from. Other columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import top_per_group
from .byte_cnn import WINDOW, ByteCNN, train, windows_of
from .common import as_batch, byte_texts, cut, frugal, retain, slices, text_of

UNKNOWN = "und"
SAMPLE_TEXTS = 300       # labelled texts of each language that the network is fitted to
SAMPLE_WINDOWS = 6       # windows of each such text
LEAST_SCORE = 0.3        # what the filter asks of a prediction


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def fold_of(docs: DataFrame, modulus: int) -> Column:
    """crc32 of the id, as text, modulo ``modulus``; null for a null id."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, learn: Column) -> DataFrame:
    """``label, part``: the windows to learn from, a bounded number for each label."""
    text = text_of(docs)
    rows = docs.where(learn & docs["lang"].isNotNull() & has_letter(text)).select(
        docs["lang"].cast("string").alias("label"), text.alias("text"),
        F.xxhash64(text).alias("order"))
    # Distinct texts of each label; copies are merged inside their own tasks.
    counts = {r["label"]: r["count"]
              for r in rows.select("label", "order").distinct().groupBy("label").count().collect()}
    if not counts:
        return rows.select("label", F.col("text").alias("part")).limit(0)
    # About three times as many as needed pass a hash threshold before any are ranked.
    shares = {k: 3 * SAMPLE_TEXTS / n for k, n in counts.items()}
    while True:
        share = F.create_map(*[F.lit(x) for k, v in sorted(shares.items()) for x in (k, min(1.0, v))])
        near = cut(rows.where((F.pmod("order", F.lit(1 << 30)) / float(1 << 30)) <= share[F.col("label")])
                   .groupBy("label", "order").agg(F.min("text").alias("text")))
        got = {r["label"]: r["count"] for r in near.groupBy("label").count().collect()}
        few = [k for k, n in counts.items() if shares[k] < 1 and got.get(k, 0) < min(SAMPLE_TEXTS, n)]
        if not few:
            break
        shares |= {k: 4 * shares[k] for k in few}
    best = top_per_group(near, ["label"], [F.col("order"), F.col("text")], SAMPLE_TEXTS)
    step = F.greatest(F.lit(WINDOW), F.floor(F.length("text") / SAMPLE_WINDOWS).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), step)
    return best.select("label", F.explode(F.slice(F.transform(
        starts, lambda i: F.substr("text", i, F.lit(WINDOW))), 1, SAMPLE_WINDOWS)).alias("part"))


def fit(docs: DataFrame, learn: Column) -> ByteCNN | None:
    """The network learned from the rows that ``learn`` admits; None if there are none."""
    rows = sorted((r["label"], r["part"].encode()[:WINDOW]) for r in sample(docs, learn).collect())
    rows = [r for r in rows if r[1]]
    if not rows:
        return None
    labels = sorted({label for label, _ in rows})
    windows, owner, _ = windows_of([part for _, part in rows])
    target = np.array([labels.index(label) for label, _ in rows])[owner]
    return train(windows, target, labels)


def _predict(net: ByteCNN | None, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("key", pa.int64()), ("fold", pa.int64()),
                        ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net is not None else None
        for b in slices(batches):
            n = b.num_rows
            best, sure = np.full(n, -1), np.zeros(n)
            if score is not None:
                windows, owner, used = windows_of(byte_texts(b.column("text")))
                total, size = np.zeros((n, len(net.labels))), np.zeros(n)
                np.add.at(total, owner, score(windows) * used[:, None])
                np.add.at(size, owner, used)
                mean = total / np.maximum(size, 1)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                ok = b.column("lettered").to_numpy(zero_copy_only=False)
                best[ok], sure[ok] = p.argmax(axis=1)[ok], p.max(axis=1)[ok]
            names = [*(net.labels if net is not None else []), UNKNOWN]
            yield as_batch({"doc_id": b.column("doc_id"), "key": b.column("key"),
                            "fold": b.column("fold"), "lang_pred": [names[i] for i in best],
                            "score": sure}, schema)
    return run


def identify(docs: DataFrame, net: ByteCNN | None, modulus: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), fold, lang_pred, score."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("key"),
                       fold_of(docs, modulus).alias("fold"), has_letter(text).alias("lettered"),
                       text.alias("text"))
    name = rows.dtypes[0][1]
    kind = rows.limit(0).toArrow().schema.field(0).type
    return rows.mapInArrow(frugal(_predict(net, kind)), f"doc_id {name}, key long, fold long, "
                           "lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Predictions for all of ``docs`` by a network that never saw the held-out fold."""
    found = identify(docs, fit(docs, F.coalesce(fold_of(docs, modulus) != held_out, F.lit(False))), modulus)
    return found.select("doc_id", F.coalesce(F.col("fold") == held_out, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, without texts whose language is not recognised."""
    found = identify(docs, fit(docs, F.coalesce(fold_of(docs, 4) != 2, F.lit(False))))
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return retain(docs, found.select("doc_id", "key", keep.alias("keep")), F.xxhash64(text_of(docs)))
