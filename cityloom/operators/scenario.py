"""Scenario change logs: vocabulary, ordered resolution, diffs and summaries.

A change is accepted or rejected by whether its object exists at that moment, and that
depends only on the last earlier change that created or removed it. So the ordered fold is
a "last value before" scan per object, not a loop, and hot objects can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BUILDABLE_TYPES, ENTITY_NAMES, ENTITY_TYPES, OPERATIONS
from ..functions.scalars import lookup
from ..session import cut, is_empty
from .scan import last_before, running_total

KEY = ("scenario_id", "entity_type", "entity_id")


def engine_changes(log: DataFrame) -> DataFrame:
    """Stored rows (``object_type, operation, object_id, parameters`` JSON) to engine terms:
    lower-case entity types, add / modify / delete, attributes as a map and the geometry
    apart. Unknown words pass in lower case."""
    kind, verb = F.lower("object_type"), F.upper("operation")
    raw = F.from_json(F.coalesce("parameters", F.lit("{}")), "map<string,string>")
    return log.select(
        "change_id", "scenario_id",
        F.coalesce(lookup(ENTITY_NAMES, kind), kind).alias("entity_type"),
        F.coalesce(lookup(OPERATIONS, verb), F.lower("operation")).alias("operation"),
        F.col("object_id").cast("string").alias("entity_id"),
        F.map_filter(raw, lambda k, _: k != "geometry").alias("attributes"),
        F.get_json_object("parameters", "$.geometry").alias("geometry"))


def _has_geometry() -> Column:
    return F.col("geometry").isNotNull() & F.col("entity_type").isin(list(BUILDABLE_TYPES))


def _judge(changes: DataFrame, base: DataFrame, group_rows: int | None) -> DataFrame:
    """Add ``exists`` (before the change) and ``reason`` (NULL when applied)."""
    op = F.col("operation")
    effect = F.when(op == "delete", F.lit(False)).when(
        (op == "add") & _has_geometry(), F.lit(True))
    known = base.select("entity_type", F.col("id").cast("string").alias("entity_id")).distinct(
        ).withColumn("_base", F.lit(True))
    ordered = last_before(changes, list(KEY), [F.col("change_id")], effect, "_before",
                          group_rows)
    out = ordered.join(known, ["entity_type", "entity_id"], "left").withColumn(
        "exists", F.coalesce("_before", "_base", F.lit(False)))
    ok_type = F.col("entity_type").isin(list(ENTITY_TYPES))
    reason = (F.when(~ok_type, F.lit("unknown entity_type"))
              .when((op == "delete") & ~F.col("exists"), F.lit("delete target not found"))
              .when((op == "modify") & ~F.col("exists"), F.lit("modify target not found"))
              .when((op == "add") & F.col("exists"), F.lit("add id already exists"))
              .when((op == "add") & ~_has_geometry(),
                    F.lit("cannot construct record; geometry missing"))
              .when(~op.isin("add", "modify", "delete"),
                    F.concat(F.lit("unknown operation '"), op, F.lit("'"))))
    return out.withColumn("reason", reason).drop("_before")


def judge(changes: DataFrame, base: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Every change with ``reason`` (NULL = applied) and its final ``entity_id``.

    ``base``: entity_type, id of the existing objects, shared by all scenarios. An add
    without id is named ``proposed-<type>-<n>`` with n one above the number of such
    objects at that moment. That number needs the verdicts of the changes before it, and
    a verdict may hang on such a name; so naming and judging alternate until the names
    stay. Each pass settles at least the first open name of a scenario, and normally all.
    """
    if is_empty(changes.where(F.col("entity_id").isNull() & (F.col("operation") == "add"))):
        return _judge(changes, base, group_rows).drop("_base")
    sizes = base.groupBy("entity_type").agg(F.count(F.lit(1)).alias("_n0"))
    auto = F.col("entity_id").isNull() & (F.col("operation") == "add")
    todo = cut(changes.withColumn("_auto", auto))
    first = _judge(todo.where(~F.col("_auto")), base, group_rows)
    assumed = todo.where("_auto").select("change_id", _has_geometry().cast("int").alias("_step"))
    steps = _steps(first).unionByName(assumed)
    before = None
    while True:
        moved = todo.join(steps, "change_id", "left").withColumn(
            "_d", F.coalesce("_step", F.lit(0))).drop("_step")
        total = running_total(moved, ["scenario_id", "entity_type"], [F.col("change_id")],
                              F.col("_d"), "_sum", group_rows)
        size = F.coalesce("_n0", F.lit(0)) + F.col("_sum") - F.col("_d") + 1
        named = total.join(F.broadcast(sizes), "entity_type", "left").withColumn(
            "entity_id", F.when(F.col("_auto"), F.concat(
                F.lit("proposed-"), F.col("entity_type"), F.lit("-"), size.cast("string")))
            .otherwise(F.col("entity_id"))).select(*todo.columns)
        out = cut(_judge(named, base, group_rows).drop("_base"))
        mark = out.where("_auto").agg(F.sum(F.xxhash64("change_id", "entity_id").cast(
            "decimal(38,0)"))).head()[0]
        if mark == before:
            return out.drop("_auto")
        before, steps = mark, _steps(out)


def _steps(judged: DataFrame) -> DataFrame:
    """What each applied change does to the number of objects of its type."""
    return judged.select("change_id", F.when(F.col("reason").isNull(), F.when(
        F.col("operation") == "add", 1).when(F.col("operation") == "delete", -1)
        .otherwise(0)).otherwise(0).alias("_step"))


def resolve(judged: DataFrame, base: DataFrame) -> DataFrame:
    """Net effect per touched object: ``state`` (added, modified, deleted) and the last
    value of each attribute since the object was last created or removed.

    Objects without accepted change are not listed; the base itself is never rewritten.
    """
    applied = judged.where(F.col("reason").isNull())
    turn = F.col("operation") != "modify"
    last = applied.groupBy(*KEY).agg(
        F.max(F.when(turn, F.col("change_id"))).alias("_turn"),
        F.max_by("operation", F.when(turn, F.col("change_id"))).alias("_op"),
        F.max_by("geometry", F.when(F.col("geometry").isNotNull(), F.col("change_id")))
        .alias("geometry"))
    known = base.select("entity_type", F.col("id").cast("string").alias("entity_id")).distinct(
        ).withColumn("_base", F.lit(True))
    state = last.join(known, ["entity_type", "entity_id"], "left").withColumn(
        "state", F.when(F.col("_op") == "add", F.lit("added"))
        .when(F.col("_op").isNull(), F.lit("modified"))
        .when(F.coalesce("_base", F.lit(False)), F.lit("deleted")))
    values = (applied.where(F.col("operation") != "delete")
              .select(*KEY, "change_id", F.explode("attributes").alias("attr", "value"))
              .join(last.select(*KEY, "_turn"), list(KEY))
              .where(F.col("change_id") >= F.coalesce("_turn", F.lit(-1)))
              .groupBy(*KEY, "attr").agg(F.max_by("value", "change_id").alias("value")))
    # One entry per distinct attribute name, so the map is as wide as the schema.
    maps = values.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("attr", "value")))).alias("attributes"))
    return state.where(F.col("state").isNotNull()).join(maps, list(KEY), "left").select(
        *KEY, "state", "attributes", "geometry")


def apply_to_base(base: DataFrame, resolved: DataFrame, entity_type: str,
                  scenario_ids: Sequence, patchable: dict[str, str], key: str = "id") -> DataFrame:
    """State of one layer in each of the given scenarios: deleted rows gone, patched
    columns replaced (``patchable``: column -> type), added rows appended."""
    mine = resolved.where((F.col("entity_type") == entity_type)
                          & F.col("scenario_id").isin(list(scenario_ids)))
    copies = base.withColumn("scenario_id", F.explode(F.array(
        *[F.lit(s) for s in scenario_ids]))).withColumn("_id", F.col(key).cast("string"))
    patch = mine.select("scenario_id", F.col("entity_id").alias("_id"), "state",
                        "attributes")
    joined = copies.join(patch, ["scenario_id", "_id"], "left").where(
        F.col("state").isNull() | (F.col("state") == "modified"))

    def value(c: str) -> Column:
        return F.try_element_at("attributes", F.lit(c)).cast(patchable[c])
    kept = joined.select("scenario_id", *[
        F.coalesce(value(c), F.col(c)).alias(c) if c in patchable else F.col(c)
        for c in base.columns])
    new = mine.where(F.col("state") == "added").select(
        "scenario_id", F.col("entity_id").cast(dict(base.dtypes)[key]).alias(key),
        *[value(c).alias(c) for c in patchable if c != key])
    return kept.unionByName(new, allowMissingColumns=True)


def change_summary(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts in total, by operation and by entity type, from one pass."""
    sets = [[*by], [*by, "operation"], [*by, "entity_type"]]
    out = changes.groupingSets(sets, *by, "operation", "entity_type").agg(
        F.count(F.lit(1)).alias("n"))
    part = (F.when(F.col("operation").isNotNull(), "operation")
            .when(F.col("entity_type").isNotNull(), "entity_type").otherwise("total"))
    return out.select(*by, part.alias("part"), F.coalesce(
        "operation", "entity_type", F.lit("total")).alias("value"), "n")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (entity_type, entity_id, operation) with ``side``: only_in_a, only_in_b or
    in_both."""
    cols = ["entity_type", "entity_id", "operation"]
    marks = (a.select(*cols, F.lit(1).alias("a"), F.lit(0).alias("b"))
             .unionByName(b.select(*cols, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    both = marks.groupBy(*cols).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select(*cols, F.when(F.col("a") + F.col("b") == 2, "in_both")
                       .when(F.col("a") == 1, "only_in_a").otherwise("only_in_b").alias("side"))


def with_changes(headers: DataFrame, changes: DataFrame) -> DataFrame:
    """Scenario headers with their deltas for listing, one row per delta (headers without
    any stay once). Logs can be long, so they are rows, not nested lists."""
    kind = F.lower("object_type")
    group = (F.when(kind.contains("facility"), "facility").when(kind.contains("road"), "road")
             .when(kind.contains("population") | kind.contains("zone"), "population")
             .otherwise("zoning"))
    items = changes.select("scenario_id", "change_id", group.alias("type"), F.concat_ws(
        " ", "operation", "object_type").alias("label"),
        F.col("parameters").alias("detail"))
    valid = F.lower("status").isin("draft", "review", "approved", "reopened", "baseline")
    return headers.withColumns({
        "status": F.when(valid, F.lower("status")).otherwise("draft"),
        "horizon": F.coalesce("horizon", F.lit(2035)),
        "population_growth_pct": F.coalesce(F.col("population_growth_pct").cast("double"),
                                            F.lit(2.5))}).join(items, "scenario_id", "left")
