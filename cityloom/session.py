"""Session helpers: building a session, and cutting lineage on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cityloom", cpus: str | int = "*", partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks find
    it wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = f"{tempfile.mkdtemp(prefix='spark-')}/{name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = f"{folder}/{f}"
                    out.write(full, f"{name}/{os.path.relpath(full, root)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so that fails.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or context.getConf().get("spark.checkpoint.dir"))
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


@contextmanager
def _loop_settings(spark: SparkSession, **more: str):
    """Joins of tables written for later steps are broadcast by the size they turn out to have, not by an estimate from
    the files at their start: a table of a loop can be a thousand times as large as the layer it grew from."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get(key)
    wanted = {key: "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": limit, **more}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made.

    A checkpoint also keeps the constraints known of its columns. In a loop that joins a
    table with itself these double every round, so none are collected here.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _loop_settings(df.sparkSession, **{"spark.sql.constraintPropagation.enabled": "false"}):
        return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a table in the same folder. Reading it back starts from a bare
    scan: in loops that join a table with itself, a checkpoint's record of how the rows
    are laid out grows with every round."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with _loop_settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return len(df.head(1)) == 0
