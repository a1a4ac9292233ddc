"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths made by this process and not yet deleted, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    Only a local master may do without (tests): a folder of our own is then set
    for the session.  On a cluster each machine would write to its own disk, so
    a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideweave-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def made_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends.

    :func:`drop_made` deletes such paths earlier.
    """
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, store = _file_system(spark, folder)
    store.mkdirs(at)
    store.deleteOnExit(at)
    _MADE.append(f"{folder}/data")
    return f"{folder}/data"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Survives lost executors, unlike a local checkpoint, and gives the rest of
    the plan real sizes to plan with.
    """
    spark = df.sparkSession
    path = made_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stashed_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at, store = _file_system(spark, path.removesuffix("/data"))
    store.delete(at, True)
    store.cancelDeleteOnExit(at)
    if path in _MADE:
        _MADE.remove(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a table made by :func:`stash` that no later plan reads."""
    _delete(df.sparkSession, df._stashed_at)


def made_so_far() -> list[str]:
    """The paths that exist now; what is made later can be dropped by :func:`drop_made`."""
    return list(_MADE)


def drop_made(spark: SparkSession, before: list[str] = (), keep: DataFrame | None = None) -> None:
    """Delete all made paths but those in ``before`` and the table ``keep``.

    For callers who have read or written what they wanted: results that are
    still to be computed from a dropped table fail, also those that other
    threads of this process have begun since ``before``.
    """
    kept = {*before, getattr(keep, "_stashed_at", None)}
    for path in [p for p in _MADE if p not in kept]:
        _delete(spark, path)
