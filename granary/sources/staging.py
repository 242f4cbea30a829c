"""Tables written between the steps of a plan, in the folder that driver and executors share.

A staged table is computed once and no lost executor can take it away. The folder is spark.checkpoint.dir; where that is unset only a
session that runs in one process may use a temporary one. Tables of an application lie together under its id: drop() deletes one that is
done with, scope() what was staged inside it, release() all, which also happens when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from granary.schema import ContractError

#: Folder of each application, with the file system it is on; and the paths staged in each open scope.
_ROOTS: dict[str, tuple[str, JavaObject]] = {}
_SCOPES: list[list[str]] = []
_PLACE = "_granary_place"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that driver and executors share."""
    context = spark.sparkContext
    own = context.applicationId
    if own not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ContractError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="granary-")  # one process: its disk is everybody's
        root = f"{base.rstrip('/')}/{own}"
        _ROOTS[own] = root, spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    return _ROOTS[own][0]


def _delete(spark: SparkSession, path: str) -> None:
    _ROOTS[spark.sparkContext.applicationId][1].delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What an execution inside shuffles is deleted with its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    setattr(back, _PLACE, path)
    return back


def drop(df: DataFrame) -> None:
    """Deletes a table as stage() returned it; nothing that still has to read it may be left. Other tables are left alone."""
    path = getattr(df, _PLACE, None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """What is staged inside is deleted at its end, but for the tables that `keep` holds then."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        kept = {getattr(df, _PLACE, None) for df in keep}
        for path in own:
            if path not in kept:
                _delete(spark, path)
        if _SCOPES:
            _SCOPES[-1].extend(p for p in own if p in kept)


def release() -> None:
    """Deletes everything that was staged."""
    for root, files in list(_ROOTS.values()):
        try:
            files.delete(files.makeQualified(_path(files, root)), True)
        except Exception:  # the gateway is gone: the folder stays under the application's id
            pass
    _ROOTS.clear()


def _path(files: JavaObject, name: str) -> JavaObject:
    from pyspark import SparkContext

    return SparkContext._jvm.org.apache.hadoop.fs.Path(name)


atexit.register(release)
