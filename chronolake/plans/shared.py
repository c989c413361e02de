"""The folder that executors share, and cutting lineage through files in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a query when it ends, where this Spark knows the setting.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes after which a batch goes to a Python worker; Spark's own limit is 64 MB, of which a worker holds several copies.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, an own folder on one machine; on a cluster an error, as executors could not see that folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="chronolake-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], True)
    return _own[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freeing(spark: SparkSession):
    """Within it, a query's shuffle files go when it ends; what was set before is set again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on contents go to Python workers by BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def opened(uri: str):
    """(file system, path) of a path in the shared folder, whatever store it is in."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def drop(*frames: DataFrame) -> None:
    """Deletes the files of frames that cut made, and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        if "/cut-" in folder:
            store, path = opened(folder)
            store.delete_dir(path)
