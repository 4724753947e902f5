"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Folders of local masters without a setting, by application; the context's own settings stay as they are.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or its context.

    Where both are unset, a local master (as in tests) gets a fresh folder of its own; a cluster is an error, for its
    executors wouldn't see the driver's folder.
    """
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if not (made := context._jsc.sc().getCheckpointDir()).isDefined():
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            if context.applicationId not in _LOCAL:
                _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
            return _LOCAL[context.applicationId]
        found = made.get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kairan/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that each ``settled`` in progress has seen stored.
_MADE: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: later steps see the same rows even if executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    for made in _MADE[-1:]:
        made.append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, ``stored``; all tables that ``make`` has stored on its way there are deleted."""
    _MADE.append([])
    try:
        out = make()
    finally:
        made = _MADE.pop()
    back = stored(out, name)
    for path in made:
        _delete(back.sparkSession, path)
    return back


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` made and that no later step reads."""
    for t in tables:
        if t is not None and (path := getattr(t, "_stored_at", None)):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this library has stored in the shared folder; results that read it must be written by then."""
    _delete(spark, f"{shared_dir(spark)}/kairan")
