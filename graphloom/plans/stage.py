"""Cutting lineage: tables written to the folder that all executors share.

Writing a stage runs a job at once, while a query is still being put together: errors and costs of what is staged come
before any action on the result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: list[str] = []
_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder set on its context.

    Only where neither is set and all runs in one process (tests) a folder of our own is made and set; on a cluster
    that would be a machine-local folder, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphloom-stages-")
    _own_folders.append(own)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@atexit.register
def _remove() -> None:
    """What is still staged when the driver ends: no lazy result can read it any more."""
    for folder, spark in _left.items():
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001, S110 - the JVM may have gone first; the folder is the application's own
            pass
    for folder in _own_folders:
        shutil.rmtree(folder, ignore_errors=True)


def _folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    folder = f"{shared_folder(spark)}/graphloom/{spark.sparkContext.applicationId}"
    _left[folder] = spark
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_open: list[list[str]] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the application's part of the shared folder; it goes like a staged table."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _open:
        scope.append(path)
    return path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, and it survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def not_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for joins that must not broadcast it.

    Spark goes by the size of a staged table's files, and of what is made from it: packed names have a tenth of the
    size, or less, that they take in the driver's memory when they are broadcast.
    """
    return df.hint("merge")


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of :func:`staged` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/graphloom/" in folder:
                _delete(df.sparkSession, folder)


@contextmanager
def only_kept(spark: SparkSession, kept: Iterable[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """Delete what is staged inside the block at its end, but for the tables put into the list that it gives.

    Around an operator: its intermediate stages go as soon as its results are written. Around a query and its action:
    nothing of the query stays. Results that are lazy must not be read after the block.
    """
    made: list[str] = []
    keep: list[DataFrame] = list(kept or ())
    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        names = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
        for path in made:
            if path.rpartition("/")[2] not in names:
                _delete(spark, path)


def drop_all_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application; call it when no result is read any more."""
    _delete(spark, _folder(spark))
