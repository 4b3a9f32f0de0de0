"""Ordered computations that never put one group, or the whole table, in one task.

``global_rank``, ``running_total`` and ``last_before`` sort by range, so that a hot
group spans several partitions, work inside each partition, and carry a small
per-partition summary across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# A group above this many rows is spread over several tasks.
GROUP_ROWS = 2_000_000


def _names(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _slices(df: DataFrame, slices: int | None) -> int:
    return slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sliced(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Range-sorted copy with ``_slice`` (partition) and ``_pos`` (0-based inside it).

    It is materialised, because range boundaries come from sampling and both passes of
    the callers must see the same ones.
    """
    n = _slices(df, slices)
    low33 = F.lit((1 << 33) - 1)
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
               .withColumn("_slice", F.spark_partition_id())
               .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(low33)))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                slices: int | None = None) -> DataFrame:
    """1-based position over the whole table; ``order`` must be total."""
    s = sliced(df, order, slices)
    # One row per partition: the window below is over a few hundred rows at most.
    sizes = s.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    return (s.join(F.broadcast(offsets), "_slice")
            .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
            .drop("_slice", "_pos", "_offset"))


def top_rank(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows with their position; only those n rows meet in one task."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count")).head()
    return int(row[0] or 0)


def _is_hot(df: DataFrame, keys: Sequence[str], limit: int | None) -> bool:
    return largest_group(df, keys) > (GROUP_ROWS if limit is None else limit)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column,
                  name: str, group_rows: int | None = None,
                  slices: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group."""
    if not _is_hot(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value).over(w))
    s = sliced(df.withColumn("_v", value), [*_names(keys), *order], slices)
    carry = s.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_t"))
    carry = carry.withColumn("_carry", F.coalesce(F.sum("_t").over(
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    local = Window.partitionBy(*keys, "_slice").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (s.withColumn("_local", F.sum("_v").over(local))
            .join(carry, [*keys, "_slice"])
            .withColumn(name, F.col("_carry") + F.col("_local"))
            .drop("_slice", "_pos", "_v", "_local", "_carry"))


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column,
                name: str, group_rows: int | None = None,
                slices: int | None = None) -> DataFrame:
    """Last non-null ``value`` on an earlier row of the group (NULL when there is none)."""
    if not _is_hot(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    s = sliced(df.withColumn("_v", value), [*_names(keys), *order], slices)
    tail = s.where(F.col("_v").isNotNull()).groupBy(*keys, "_slice").agg(
        F.max_by("_v", "_pos").alias("_t"))
    slots = s.select(*keys, "_slice").distinct().join(tail, [*keys, "_slice"], "left")
    carry = slots.withColumn("_carry", F.last("_t", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1))).drop("_t")
    local = Window.partitionBy(*keys, "_slice").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, -1)
    return (s.withColumn("_local", F.last("_v", ignorenulls=True).over(local))
            .join(carry, [*keys, "_slice"])
            .withColumn(name, F.coalesce("_local", "_carry"))
            .drop("_slice", "_pos", "_v", "_local", "_carry"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The filter on row_number lets Spark keep only n rows
    of a group in each task before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
