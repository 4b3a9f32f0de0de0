"""What the operators share: column guards, checked joins, text chunks, shared files."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir, written

#: A join side of at most so many short rows (under about 100 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of text that a vectorised step works on at a time.
CHUNK_BYTES = 1 << 19


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def numbered(df: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of ``df`` with a ``row_id``, written down so that ids never change."""
    return written(df.select(F.monotonically_increasing_id().alias("row_id"), *columns))


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | Column,
               how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a materialised side: broadcast if its counted rows are few, else a
    shuffle join between bare exchanges, whose hot keys adaptive execution splits."""
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def retain(docs: DataFrame, verdicts: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs``, with its own columns, whose verdict is to keep them.

    ``verdicts`` has doc_id, key and keep for every row; ``key`` is a hash of the text of
    ``docs``. Rows equal in id and text are told apart by number only: if some of them are
    kept and some not, one stays.
    """
    dead = written(verdicts.groupBy("doc_id", "key").agg(
        F.count(F.when(F.col("keep"), 1)).alias("stay"), F.count(F.lit(1)).alias("n"))
        .where("stay < n").select(F.col("doc_id").alias("dead_id"), F.col("key").alias("dead_key"),
                                  "stay"))
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), key.alias("key"))
    match = (F.col("key") == F.col("dead_key")) & F.col("id").eqNullSafe(F.col("dead_id"))
    kept = join_small(rows, dead, match, "left_anti")
    repeats = cut(dead.where("stay > 0"))
    if repeats.limit(1).count():
        kept = kept.unionByName(
            join_small(rows, repeats, match, "left_semi").dropDuplicates(["id", "key"]))
    return kept.select("row.*")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ text in tasks
def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null gives none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text (or one row)."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(lengths + 16) // size
        edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


_CACHES: list = []


def kept_in_worker(cache):
    """Register what a function cached by ``lru_cache`` keeps between the tasks of a worker."""
    _CACHES.append(cache)
    return cache


def frugal(run, keeps=None):
    """``run`` for ``mapInArrow``, in a worker that serves many kinds of tasks: what other operators
    have cached is dropped first, and freed memory goes back to the system afterwards."""
    def wrapped(batches):
        for cache in _CACHES:
            if cache is not keeps:
                cache.cache_clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)
    return wrapped


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type)
         for n, c in columns.items()], schema=schema)


# ------------------------------------------------------------------ shared files
def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """Path of a shared folder that every machine mounts, as memory-mapping needs it."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {uri}")
    return unquote(at.path)


def publish(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays under their final names in one step each, so that a repeated task
    replaces whole files by equal ones."""
    os.makedirs(path, exist_ok=True)
    for name, values in arrays.items():
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, values)
        os.replace(part, f"{path}/{name}.npy")


__all__ = ["BROADCAST_ROWS", "CHUNK_BYTES", "as_batch", "byte_texts", "cut", "frugal", "join_small",
           "kept_in_worker", "mounted", "numbered", "partitions", "publish", "retain", "shared_folder", "slices",
           "text_of", "written"]
