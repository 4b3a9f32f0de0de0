"""Mixing sources to target weights by weighted fair queueing.

Every source gets a weight; together the sources share a budget of words. A source's target is its
weight's part, at most ``REPEATS`` times its own words, what is above being shared by the others by
weight (a water level found from running sums over the sources sorted by where they fill up). Each
source's documents are put in an order of md5 hashes of their ids and served in it, again from the
start for a second pass. An entry's virtual finish time is the words its source has been served by
then divided by the target, so all sources run dry at time 1. Entries are sorted by finish time over
the whole table and truncated where the words served reach the budget.

Running sums go over range-sorted slices with one carried number per slice, so a source of any size
spans many tasks, and nothing but three numbers comes to the driver.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null text has size 0 and takes nothing. Null is a
source of its own, last in the order of sources. Repeated rows are documents of their own. Other
columns, of any name, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import sliced
from .common import cut, join_small, numbered, partitions, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)   # of the sources in order, repeating
SHARE = 1.5                 # budget, as a multiple of all words
REPEATS = 2                 # times that a document is served at most
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows up to and with this one in the
    (total) ``order``."""
    s = sliced(df.select("*", *[v.alias(f"_{n}") for n, v in sums.items()]), order, partitions(df))
    totals = s.groupBy("_slice").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    carried = cut(totals.select("_slice", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_c_{n}")
                                            for n in sums]))
    local = Window.partitionBy("_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(carried), "_slice")  # as many rows as slices
    out = out.withColumns({n: F.sum(f"_{n}").over(local) + F.col(f"_c_{n}") for n in sums})
    return out.drop("_slice", "_pos", *[f"_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target`` and ``before``, the words of the sources
    earlier in order."""
    ranked = written(running(sources, [F.col("source").asc_nulls_last()],
                             {"rank": F.lit(1), "through": F.col("source_size")}))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, len(weights)) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size").cast("double"))
    budget, weigh = ranked.agg(share * F.sum("source_size"), F.sum("weight")).head()
    filled = running(ranked.withColumn("full_at", F.col("cap") / F.col("weight")),
                     [F.col("full_at"), F.col("rank")], {"caps": F.col("cap"), "weighs": F.col("weight")})
    # Before the first source that does not fill up, all are at their caps.
    level = (F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(weigh) - (F.col("weighs") - F.col("weight")))
    found = filled.where(level <= F.col("full_at")).agg(F.min_by(level, F.struct("full_at", "rank"))).head()[0]
    level = float("inf") if found is None else found
    return ranked.select("source", "source_size", (F.col("through") - F.col("source_size")).alias("before"),
                         F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, key (hash of the text), size, source_size, target
    and ``served``: for each pass that serves some of it, the words served, in order of passes."""
    text = text_of(docs)
    sized = numbered(docs, docs["doc_id"], F.xxhash64(text).alias("key"), docs["source"].cast("string").alias("source"),
                     F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                     F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")).alias("spot"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = written(targets(sources))
    budget = F.lit(int(SHARE * (wanted.agg(F.sum("source_size")).head()[0] or 0)))
    order = [F.col("source").asc_nulls_last(), F.col("spot"), F.col("doc_id"), F.col("key"), F.col("row_id")]
    queue = running(sized, order, {"through": F.col("size")})
    aim = wanted.select(F.col("source").alias("name"), "source_size", "before", "target")
    queue = written(join_small(queue, aim, F.col("source").eqNullSafe(F.col("name"))).drop("name"))
    goal = F.ceil("target")
    entries = queue.where("size > 0").withColumn(
        "turn", F.explode(F.array(*map(F.lit, range(REPEATS))))).withColumn(
        "start", F.col("through") - F.col("size") - F.col("before") + F.col("turn") * F.col("source_size"))
    entries = entries.where(F.col("start") < goal).withColumn(
        "words", F.least("size", goal - F.col("start"))).withColumn(
        "finish", (F.col("start") + F.col("size")) / F.col("target"))
    served = running(entries.select("row_id", "turn", "words", "finish", "source", "spot", "doc_id", "key"),
                     [F.col("finish"), *order[:4], F.col("turn"), F.col("row_id")], {"total": F.col("words")})
    served = served.withColumn("words", F.greatest(F.least("words", budget - F.col("total") + F.col("words")), F.lit(0)))
    taken = written(served.where("words > 0").groupBy("row_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "words"))), lambda x: x["words"]).alias("served")))
    return join_small(queue, taken, ["row_id"], "left").select(
        "row_id", "doc_id", "key", "size", "source_size", "target",
        F.coalesce("served", F.array().cast("array<long>")).alias("served"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target",
                            F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that serves a document. A
    document that is cut off (at most one of each source in each pass) keeps only the words served,
    with single spaces between them. Rows equal in id and text share their turns evenly."""
    plan = written(mix(docs).where(F.size("served") > 0).select(
        F.col("doc_id").alias("take_id"), F.col("key").alias("take_key"), "size", "served"))
    text, columns = text_of(docs), docs.columns
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), text.alias("__text"),
                       F.xxhash64(text).alias("key"))
    # Of rows equal in id and text each is planned for itself; one of them stands for all.
    once = plan.groupBy("take_id", "take_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    match = (F.col("key") == F.col("take_key")) & F.col("id").eqNullSafe(F.col("take_id"))
    once = cut(once)
    if once.limit(1).count():
        rows = join_small(rows, once, match, "left_anti").unionByName(
            join_small(rows, once, match, "left_semi").dropDuplicates(["id", "key"]))
    # About a row for each document, so never broadcast: one way for any size.
    turns = rows.join(plan.hint("merge"), match).withColumn("words", F.explode("served"))
    short = F.array_join(F.slice(F.expr(r"regexp_extract_all(__text, '[^\\x20\\x09-\\x0D]+', 0)"),
                                 F.lit(1), F.greatest(F.col("words"), F.lit(1)).cast("int")), " ")
    body = F.when(F.col("words") < F.col("size"), short).otherwise(F.col("__text"))
    return turns.select(*[(body if c == "text" else F.col("row").getField(c)).alias(c) for c in columns])
