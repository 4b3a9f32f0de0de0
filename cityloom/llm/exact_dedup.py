"""Exact duplicates by exchange of Golomb-coded fingerprints.

1. Each sender (a partition of the keyed rows) sorts the distinct 64-bit fingerprints of its
   texts, splits them by owner (equal ranges of the fingerprint space) and sends every owner
   its gaps, Golomb-Rice coded, with one bit per fingerprint that it holds more than once.
2. Each owner decodes what it got, finds fingerprints held twice, and answers every sender
   with a bitmap over the sender's sorted list.
3. Only rows whose bit is set are suspects. Their texts, and no others, are shuffled and
   compared byte by byte (grouping on the text itself).

A copy group of any size costs each sender one fingerprint, and the grouping on text adds up
inside each task first, so no task ever holds a group.

Defined cases: a null text counts as empty, and all empty texts are equal. Of rows equal in
text the one with the largest ``doc_id`` stays (null is smallest); among rows that also share
that id, exactly one stays. Other columns, of any name, play no part. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, frugal, join_small, numbered, retain, text_of, written

#: Fingerprints that one owner is meant to hold; owners grow with the rows.
OWNER_ROWS = 2_000_000


def encode_gaps(values: np.ndarray, low: int, span: int) -> tuple[bytes, int]:
    """Golomb-Rice code of sorted distinct ``values`` in ``[low, low + span)``: quotients in
    unary, then remainders of ``r`` bits; returns the bytes and ``r``."""
    n = len(values)
    r = max(0, int(span // max(n, 1)).bit_length() - 1)
    gaps = np.diff(np.concatenate(([np.uint64(low)], values)))
    quotient = (gaps >> np.uint64(r)).astype(np.int64)
    stops = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if n else 0, np.uint8)
    unary[stops] = 1
    rest = (gaps[:, None] >> np.arange(r, dtype=np.uint64)) & np.uint64(1)
    return (np.packbits(unary).tobytes()
            + np.packbits(rest.astype(np.uint8).ravel()).tobytes()), r


def decode_gaps(blob: bytes, n: int, r: int, low: int) -> np.ndarray:
    """Inverse of :func:`encode_gaps`."""
    tail = (n * r + 7) // 8
    head = np.frombuffer(blob, np.uint8, len(blob) - tail)
    stops = np.flatnonzero(np.unpackbits(head))[:n]
    quotient = np.diff(np.concatenate(([-1], stops))) - 1
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, tail, len(blob) - tail))[:n * r]
    rest = (bits.reshape(n, r).astype(np.uint64) << np.arange(r, dtype=np.uint64)).sum(
        axis=1, dtype=np.uint64) if r else np.zeros(n, np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(r)) + rest
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _ranges(owners: int) -> np.ndarray:
    return np.array([(i << 64) // owners for i in range(owners)], np.uint64)


SENT = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int64()),
                  ("rice", pa.int32()), ("gaps", pa.binary()), ("held", pa.binary())])


def _send(owners: int):
    low = _ranges(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        senders, prints = [], []
        for b in batches:
            senders.append(b.column("sender").to_numpy())
            prints.append(b.column("print").to_numpy().view(np.uint64))
        if not prints:
            return
        sender, seen = np.concatenate(senders), np.concatenate(prints)
        for s in np.unique(sender):
            values, counts = np.unique(seen[sender == s], return_counts=True)
            cuts = np.append(np.searchsorted(values, low), len(values))
            for o in range(owners):
                part = values[cuts[o]:cuts[o + 1]]
                if len(part):
                    blob, r = encode_gaps(part, int(low[o]), (1 << 64) // owners)
                    twice = np.packbits(counts[cuts[o]:cuts[o + 1]] > 1).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(
                            (int(s), o, len(part), r, blob, twice), SENT.types, strict=True)],
                        schema=SENT)
    return run


MARKS = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("bitmap", pa.binary())])


def _answer(owners: int):
    low = _ranges(owners)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lists = [decode_gaps(x["gaps"], x["n"], x["rice"], int(low[x["owner"]])) for x in rows]
        twice = [np.unpackbits(np.frombuffer(x["held"], np.uint8))[:x["n"]] for x in rows]
        values, back = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(back, weights=1 + np.concatenate(twice)) > 1
        marks = np.split(total[back], np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"sender": [x["sender"] for x in rows],
                         "owner": [x["owner"] for x in rows],
                         "bitmap": [np.packbits(m).tobytes() for m in marks]}, schema=MARKS)
    return run


SUSPECTS = "row_id long, doc_id {kind}, text_sha256 string"


def _mark(owners: int):
    low = _ranges(owners)

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        seen = rows.column("print").to_numpy().view(np.uint64)
        values = np.unique(seen)
        cuts = np.append(np.searchsorted(values, low), len(values))
        flag = np.zeros(len(values), bool)
        for x in marks.to_pylist():
            a, b = cuts[x["owner"]], cuts[x["owner"] + 1]
            flag[a:b] = np.unpackbits(np.frombuffer(x["bitmap"], np.uint8))[:b - a]
        keep = flag[np.searchsorted(values, seen)]
        return rows.select(["row_id", "doc_id", "text_sha256"]).filter(pa.array(keep))
    return run


def suspects(keyed: DataFrame, owners: int | None = None) -> DataFrame:
    """Rows of ``keyed`` (row_id, doc_id, text_sha256, sender, print) whose fingerprint
    another row has too, by the exchange."""
    owners = owners or max(1, -(-keyed.count() // OWNER_ROWS))
    sent = keyed.select("sender", "print").repartition("sender").mapInArrow(
        frugal(_send(owners)), "sender long, owner int, n long, rice int, gaps binary, held binary")
    marks = sent.groupBy("owner").applyInArrow(
        _answer(owners), "sender long, owner int, bitmap binary")
    kind = dict(keyed.dtypes)["doc_id"]
    return keyed.groupBy("sender").cogroup(marks.groupBy("sender")).applyInArrow(
        _mark(owners), SUSPECTS.format(kind=kind))


def exact_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    sha = F.sha2(text_of(docs), 256)
    # A sender is a slice of a scan task, so its list stays small whatever the task reads.
    keyed = numbered(docs, docs["doc_id"], sha.alias("text_sha256"))
    keyed = keyed.withColumn("sender", F.shiftright("row_id", 14)).withColumn(
        "print", F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long"))
    found = cut(suspects(keyed, owners))
    keys = cut(found.select("text_sha256").distinct())
    texts = docs.select(sha.alias("text_sha256"), text_of(docs).alias("text"))
    # Byte verification: equal groups are groups of equal texts, not of equal digests.
    same = (join_small(texts, keys, ["text_sha256"], "left_semi")
            .groupBy("text_sha256", "text").agg(F.count(F.lit(1)).alias("group_size"))
            .select("text_sha256", "group_size").where("group_size > 1"))
    first = found.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row_id")).alias("keep"))
    groups = written(same.join(first, "text_sha256").select(
        "text_sha256", "group_size", F.col("keep.doc_id").alias("keep_id"),
        F.col("keep.row_id").alias("keep_row"), F.lit(True).alias("shared")))
    out = join_small(keyed.select("row_id", "doc_id", "text_sha256"), groups,
                     ["text_sha256"], "left")
    return out.select(
        "doc_id", F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("doc_id"))
        .alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("shared").isNull() | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, without the rows that :func:`exact_duplicates` drops."""
    verdicts = exact_duplicates(docs).select(
        "doc_id", F.col("text_sha256").alias("key"), F.col("kept").alias("keep"))
    return retain(docs, verdicts, F.sha2(text_of(docs), 256))
