"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The JVM interprets methods of more bytes than this for good, ten times as slowly. Generated code of a
# wide plan that has one gives way to code by operator, which is cut into small methods.
COMPILED_BYTES = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Settings that only shape plans; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **COMPILED_BYTES,
}


def local_session(cpus: int | str = "*", app: str = "boutline", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs more than building the plans themselves.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in `spark.checkpoint.dir`.

    Only a local-mode session without the setting gets a temporary folder of its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="boutline-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for `name` under the shared folder, private to this application."""
    return os.path.join(shared_dir(spark), "boutline", spark.sparkContext.applicationId, name)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A scratch path no earlier call has handed out, so plans still reading one stay valid."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def tasks_for(spark: SparkSession, rows: int, most: int) -> int | None:
    """How many tasks `rows` need so that none has over `most`; None where the session's number of
    shuffle partitions is enough. Spark joins small partitions but never makes more than that number."""
    needed = -(-rows // most)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` over that many tasks by `keys`; as it is if None."""
    return df if tasks is None else df.repartition(tasks, *keys)


@contextmanager
def shuffles_of(tasks: int | None, *sessions: SparkSession) -> Iterator[None]:
    """Shuffles that run inside are dealt to `tasks` partitions; as the sessions say if None."""
    key = "spark.sql.shuffle.partitions"
    before = [s.conf.get(key) for s in sessions]
    try:
        for s in sessions if tasks else ():
            s.conf.set(key, str(tasks))
        yield
    finally:
        for s, value in zip(sessions, before):
            s.conf.set(key, value)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later reads get column pruning,
    pushed filters and statistics, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
