"""Session helpers: a tuned builder, and tables pinned in the shared checkpoint folder for as long as the session runs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each application's pinned tables, deleted when the driver ends.
_FOLDERS: dict[str, str] = {}


def build_session(app: str = "shelfcast", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC timestamps switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        # A local session has one process, so its heap is the driver's; a cluster sets its own.
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SHELFCAST_LOCAL_MEMORY", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch folder only for local sessions without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    key = f"scratch {context.applicationId}"
    if key not in _FOLDERS:
        _FOLDERS[key] = tempfile.mkdtemp(prefix="shelfcast-")
    return _FOLDERS[key]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def work_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted with all it holds when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = os.path.join(shared_folder(spark), "shelfcast", f"{app}-{uuid.uuid4().hex[:8]}")
    return _FOLDERS[app]


def release(spark: SparkSession) -> None:
    """Delete the application's pinned tables. Frames that read them can no longer be run."""
    app = spark.sparkContext.applicationId
    for key in (app, f"scratch {app}"):
        folder = _FOLDERS.pop(key, None)
        if folder:
            fs, at = file_system(spark, folder)
            fs.delete(at, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _FOLDERS else None
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Pinning cuts lineage, so later readers prune columns from Parquet and a lost executor never replays the plan.
    It also freezes values that must not change between two reads, such as a range-partition number.
    """
    spark = df.sparkSession
    path = os.path.join(work_folder(spark), f"{label}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.mode("error").parquet(path)
    return spark.read.schema(schema).parquet(path)
