"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A session on one machine (``local[n]``) without the setting gets a temporary folder, once. On a cluster no folder
    of the driver's machine would do, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="zeitband-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/zeitband-{what}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A folder that goes when the driver's Python ends, if the session still runs then."""
    path = new_folder(spark, what)

    @atexit.register
    def gone() -> None:
        with contextlib.suppress(Exception):
            delete_folder(spark, path)

    return path


#: What tables that are written in between run under: tasks of 16 MB as shuffled, some twenty times of which their sorts
#: hold in memory, and enough partitions for that. Larger tasks spill.
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000"}


@contextlib.contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Run a write with small tasks; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in SMALL_TASKS}
    for k, v in SMALL_TASKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once and read back, so that what refers to it several times doesn't compute it several times, and
    restarts from files when executors are lost."""
    path = scratch_folder(df.sparkSession, what)
    with small_tasks(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
