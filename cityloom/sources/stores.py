"""Append-only stores on files: results, scenarios, dataset metadata, layer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parameter_hash

RESULT = ("result_id long, scenario_id long, analysis_type string, created_at timestamp, "
          "result_json string")


def provenance(dataset_version: Column, algorithm: Column, algorithm_version: Column,
               scenario_version: Column, parameters: Column, analysis_srid: Column,
               profile_version: Column | None = None,
               cost_version: Column | None = None) -> Column:
    """Reproducibility tuple with its hash. ``parameters`` is a map; its keys are sorted,
    fractions kept to ten digits, so equal inputs hash alike."""
    none = F.lit(None).cast("string")
    ordered = F.map_from_entries(F.array_sort(F.map_entries(parameters)))
    fields = {
        "algorithm": algorithm, "algorithm_version": algorithm_version,
        "analysis_srid": analysis_srid,
        "cost_profile_version": none if cost_version is None else cost_version,
        "dataset_version": dataset_version, "parameters": ordered,
        "scenario_version": scenario_version,
        "scoring_profile_version": none if profile_version is None else profile_version}
    cols = [v.alias(k) for k, v in fields.items()]
    return F.struct(*cols, parameter_hash(*cols).alias("parameter_hash"))


class ResultStore:
    """Result rows under one path; every save appends files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(RESULT).parquet(self.path)

    def save(self, results: DataFrame) -> None:
        (results.withColumn("analysis_type", F.upper("analysis_type"))
         .select(*[c.split()[0] for c in RESULT.split(", ")])
         .write.mode("append").parquet(self.path))

    def get(self, result_id: int) -> DataFrame:
        return self.rows().where(F.col("result_id") == result_id)

    def list_for_scenario(self, scenario_id: int, analysis_type: str | None = None,
                          limit: int | None = None) -> DataFrame:
        return newest(self.rows().where(F.col("scenario_id") == scenario_id), analysis_type, limit)

    def find_by_hash(self, digest: str) -> DataFrame:
        return newest(by_hash(self.rows(), digest), None, 1)


def newest(results: DataFrame, analysis_type: str | None, limit: int | None) -> DataFrame:
    if analysis_type:
        results = results.where(F.col("analysis_type") == analysis_type.upper())
    ordered = results.orderBy(F.col("created_at").desc(), F.col("result_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def by_hash(results: DataFrame, digest: Column | str) -> DataFrame:
    found = F.get_json_object("result_json", "$.provenance.parameter_hash")
    return results.where(found == digest)


def latest_versions(versions: DataFrame, key: str = "scenario_id",
                    order: str = "version") -> DataFrame:
    """Current header of each scenario from its append-only versions; an update holds only
    what changed, so every column takes its last non-NULL value."""
    cols = [c for c in versions.columns if c not in (key, order)]
    return versions.groupBy(key).agg(
        F.max(order).alias(order),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


class ScenarioStore:
    """Scenario headers (versioned rows) and changes (log), both append-only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put_headers(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/headers")

    def add_changes(self, rows: DataFrame) -> None:
        rows.withColumn("operation", F.upper("operation")).write.mode("append").parquet(
            f"{self.path}/changes")

    def headers(self) -> DataFrame:
        return latest_versions(self.spark.read.parquet(f"{self.path}/headers"))

    def changes(self, scenario_id: int | None = None) -> DataFrame:
        log = self.spark.read.parquet(f"{self.path}/changes")
        return log if scenario_id is None else log.where(F.col("scenario_id") == scenario_id)


def append_metadata(rows: DataFrame, path: str) -> None:
    rows.withColumn("download_date", F.coalesce("download_date", F.current_date())).write.mode(
        "append").parquet(path)


def write_layer(df: DataFrame, path: str, mode: str = "append",
                partitions: Sequence[str] = ("region", "layer")) -> None:
    """Append, or replace just the partitions present in ``df`` (idempotent reload)."""
    out = df.write.mode(mode)
    if mode == "overwrite":
        out = out.option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*partitions).parquet(path)


def decision_records(results: DataFrame, metrics: DataFrame, names: DataFrame) -> DataFrame:
    """What a stored result recommends: its first record and the people it concerns.

    ``results``: result_id, scenario_id, result_json; ``metrics``: result_id, metric, value;
    ``names``: scenario_id, name.
    """
    m = metrics.groupBy("result_id").agg(*[
        F.max(F.when(F.col("metric") == k, F.col("value"))).alias("_" + k)
        for k in ("population_served", "population_at_risk", "coverage_ratio",
                  "objective_weighted_cost")])
    top = F.coalesce(F.get_json_object("result_json", "$.records[0].parcel_id"),
                     F.get_json_object("result_json", "$.records[0].label"),
                     F.get_json_object("result_json", "$.title"),
                     F.lit("Site Suitability Analysis"))
    df = results.join(m, "result_id", "left").join(names, "scenario_id", "left")
    people = F.coalesce("_population_served", "_population_at_risk", F.lit(0.0)).cast("long")
    return df.select(
        "result_id", F.concat(top, F.lit(" under "), F.coalesce(
            "name", F.concat(F.lit("Scenario "), F.col("scenario_id").cast("string"))))
        .alias("recommendation"),
        F.bround(F.get_json_object("result_json", "$.records[0].score").cast("double"), 1)
        .alias("overall_score"), people.alias("affected_population"),
        F.when(F.col("_population_served").isNotNull(), "benefit")
        .when(F.col("_population_at_risk").isNotNull(), "risk").alias("population_role"),
        F.bround(F.col("_coverage_ratio") * 100, 1).alias("coverage_pct"),
        F.col("_objective_weighted_cost").alias("weighted_cost"))


def drop_undetermined(df: DataFrame) -> DataFrame:
    """Row as JSON without its NULL members; nested values become text."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c)
            for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json"))
