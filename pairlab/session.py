"""Session defaults, shipping of the package, and durable cut points for long plans."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders that ``durable`` made, by application, until they are released.
_MADE: dict[str, list[str]] = {}


def build_session(app: str = "pairlab", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, so that workers need no copy of their own."""
    here = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    # the driver serves this file to the executors; none of them reads the folder it lies in
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "pairlab.zip")
    with open(target, "wb") as out:
        out.write(held.getvalue())
    spark.sparkContext.addPyFile(target)


def durable_root(spark: SparkSession) -> str:
    """The shared folder for cut points, as ``spark.checkpoint.dir`` names it.

    A local master that names none, as in tests, gets a folder of its own; a cluster must name one.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike a row checkpoint the re-read keeps column pruning, filter pushdown and partition
    pruning, and a lost executor never forces the plan behind it to run again. The table lives
    until ``release`` or the end of the ``scratch`` block around it.
    """
    spark = df.sparkSession
    path = f"{durable_root(spark)}/pairlab-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, for a sink to write to; ``release`` deletes it like a table."""
    path = f"{durable_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``durable`` made in this application, from the ``since``-th on."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in made[since:]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    del made[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the tables made within the block; results must be read or written before it ends."""
    since = len(_MADE.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)
