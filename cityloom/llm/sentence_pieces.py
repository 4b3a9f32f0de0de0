"""SentencePiece encoding and decoding of documents, by the transducer of ``piece_fst.py``.

The model file is read on the driver and broadcast (its vocabulary bounds its size, half a megabyte
here); each Python worker compiles it once. Encoding and decoding are maps inside the scan tasks.

Defined cases: a null or empty text has no tokens. Every other text, whatever characters it holds,
decodes to itself, save that a space mark (U+2581) written out in it comes back as a space, which is
how the model reads it. Ids outside the vocabulary cannot be decoded and fail the task; lists of ids
that spell no UTF-8 decode with replacement characters. Other columns, of any name, play no part.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, byte_texts, frugal, kept_in_worker, slices, text_of
from .piece_fst import PieceModel, Transducer


def default_model() -> str:
    """Path of the public model with byte fallback that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@kept_in_worker
@lru_cache(1)
def _compiled(blob: bytes) -> Transducer:
    return Transducer(PieceModel(blob))


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: bytes, check: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_tokens, n_bytes (byte-fallback tokens) and, with
    ``check``, ``round_trip``: whether decoding the ids gives the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    kind = rows.limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
                        ("n_bytes", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(sent.value)
        is_byte = np.zeros(fst.model.size, np.int64)
        is_byte[fst.model.byte_ids] = 1
        for b in slices(batches):
            texts = byte_texts(b.column("text"))
            ids, counts = fst.encode(texts)
            total = np.concatenate(([0], np.cumsum(is_byte[ids])))
            ends = np.cumsum(counts)
            same = [t.replace("▁".encode(), b" ") == d for t, d in zip(
                texts, fst.decode(ids, counts), strict=True)] if check else [None] * len(texts)
            yield as_batch({"doc_id": b.column("doc_id"), "ids": _lists(ids, counts), "n_tokens": counts,
                            "n_bytes": total[ends] - total[ends - counts], "round_trip": same}, schema)

    out = rows.mapInArrow(frugal(run, _compiled), f"doc_id {rows.dtypes[0][1]}, ids array<int>, n_tokens long, "
                          "n_bytes long, round_trip boolean")
    return out if check else out.drop("round_trip")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select(encoded["doc_id"], F.coalesce(encoded["ids"], F.array().cast("array<int>")).alias("ids"))
    kind = rows.limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("doc_id", kind), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.diff(lists.offsets.to_numpy())
                texts = [x.decode(errors="replace") for x in fst.decode(ids, counts)]
                yield as_batch({"doc_id": part.column("doc_id"), "text": texts}, schema)

    return rows.mapInArrow(frugal(run, _compiled), f"doc_id {rows.dtypes[0][1]}, text string")
