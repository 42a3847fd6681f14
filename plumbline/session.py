"""Session defaults and the shared folder in which long jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# Calls that run side by side, at most.
AT_ONCE = 4


def build_session(app_name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, skew-join handling)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses below the shared folder."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table that later steps read several times, and return it as a fresh scan.

    The scan prunes columns and pushes filters down, and no later failure goes back
    beyond the written files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], T]], at_once: int = AT_ONCE) -> list[T]:
    """The results of calls that start jobs of their own, from a bounded pool of threads.

    Each call has a scheduler pool of its own, so that small jobs need not wait for large ones.
    """

    def in_pool(number: int, call: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"call-{number % at_once}")
            return call()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(in_pool(i, c)) for i, c in enumerate(calls)]]
