"""Tables that jobs write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder of an application on one machine that names no spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    A session on one machine that names none, as in tests, gets a new temporary folder; on a cluster
    that is an error, as executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{context.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables written by stored() that no one has dropped yet, in order.
_WRITTEN: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again, which cuts its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that stored() gave and that no later step reads."""
    drop_paths(table.sparkSession, [table.stored_at])


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no later step reads."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def drop_shared(spark: SparkSession) -> None:
    """Delete all tables of this application: for the end of a run, when its results are read."""
    drop_paths(spark, [shared_folder(spark)])
    _WRITTEN.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside are dropped at the end. Only what is written elsewhere, or by stored()
    before, may be read after."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        drop_paths(spark, _WRITTEN[before:])
