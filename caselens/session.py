"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", partitions: int = 8, app: str = "caselens") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")  # small test data
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SPREAD, "true")
        .getOrCreate()
    )


SPREAD = "spark.caselens.spreadSmallFiles"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir`` or ``setCheckpointDir``.

    Only a local session, where driver and executor are one process, may go
    without: it gets a temporary folder, deleted when Python ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="caselens-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal a small file out to all cores where the session asks for it, as the one of tests and bench does; else as it is."""
    session = df.sparkSession
    return df.repartition(session.sparkContext.defaultParallelism) if session.conf.get(SPREAD, "false") == "true" else df


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back.

    Cuts lineage, survives lost executors, and gives the planner true sizes, so
    a small table is broadcast only because it is known to be small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends in here are deleted at its end, and not when the driver collects its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
