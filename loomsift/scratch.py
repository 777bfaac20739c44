"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage without doing the work twice, and survives the loss of
executors, as no executor's own disk holds it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset, as in local tests, a folder of our own is set."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"{_SETTING} is not set; a cluster needs a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomsift-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/loomsift/{spark.sparkContext.applicationId}"


class _Made(threading.local):
    """Folders of the tables that a thread has written and not freed, in order."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_made = _Made()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession) -> None:
    """Delete the tables that this application has written; frames that still read them fail after that."""
    _delete(spark, _own(spark))
    _made.folders.clear()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.folders.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; their successors must have been written."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_folder)
        if table.scratch_folder in _made.folders:
            _made.folders.remove(table.scratch_folder)


def mark() -> int:
    """How many tables this thread has written and not freed, for ``release_since``."""
    return len(_made.folders)


def release_since(spark: SparkSession, at: int, *keep: DataFrame) -> None:
    """Delete the tables that this thread has written since ``mark`` gave ``at``, but not those to keep, which alone may be read on."""
    kept = {table.scratch_folder for table in keep}
    for folder in _made.folders[at:]:
        if folder not in kept:
            _delete(spark, folder)
    _made.folders[at:] = [folder for folder in _made.folders[at:] if folder in kept]

