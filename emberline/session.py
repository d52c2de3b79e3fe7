"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on, or that a skewed 100 TB run needs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods over 8000 bytes are never compiled by the JVM; splitting
    # them is faster than interpreting one big one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_folders: dict[str, str] = {}


def build_session(app: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` overrides or adds to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (a test on one machine) is a private folder made and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="emberline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="emberline-ship-")
    archive = os.path.join(folder, "emberline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    # Served to the executors by the driver; the folder is not read by them.
    spark.sparkContext.addPyFile(archive)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this session's own folder, which is deleted when the session's JVM ends."""
    folder = _folders.get(spark.sparkContext.applicationId)
    if folder is None:
        folder = f"{work_dir(spark)}/emberline-{uuid.uuid4().hex[:12]}"
        _folders[spark.sparkContext.applicationId] = folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, and not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The copy survives the loss of any executor, cuts the lineage, and gives
    later joins real size statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
