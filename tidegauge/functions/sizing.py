"""Settling intermediate results and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000

# With this setting Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for settled results: `spark.checkpoint.dir` of the session.

    Only a local session without that setting gets a temporary folder; a cluster
    must name a folder that all executors reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="tidegauge-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def session_folder(spark: SparkSession) -> str:
    """Where this session writes what it settles."""
    return f"{checkpoint_root(spark)}/tidegauge/{spark.sparkContext.applicationId}"


def remove_settled(spark: SparkSession) -> bool:
    """Remove all that this session has settled; to be called when none of its tables is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: for tables that are settled, so that no plan runs again.

    Otherwise these files stay until the driver's JVM collects its garbage.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    The lineage is cut, a lost executor costs no recomputation, and later passes
    prune columns and push filters into the written files. The files stay until
    `remove_settled` is called.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted size allows it; else leave the join to Spark.

    `df` should be settled or cheap, because without `rows` it is counted here
    (never beyond `limit + 1` rows).
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df
