"""Files on any Hadoop file system: atomic JSON, write-once and replacing sinks, immutable sinks, locks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from granary.operators.audit import multiset_difference


class Files:
    """The file system that a path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read_json(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def first_line(self, name: str) -> str | None:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes of the data files of a folder, by name."""
        found = self.fs.listStatus(self.path(folder)) if self.exists(folder) else []
        return {s.getPath().getName(): s.getLen() for s in found if s.isFile() and s.getPath().getName()[0] not in "._"}

    def write_json(self, name: str, value: dict) -> None:
        self.write_text(name, json.dumps(value, sort_keys=True, indent=1))

    def write_text(self, name: str, value: str) -> None:
        """Whole or not at all: written beside its place and renamed; an existing file is an error."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(beside), False)
        try:
            stream.write(bytearray(value.encode()))
            stream.hsync()
        finally:
            stream.close()
        try:
            self.rename(beside, name)
        except FileExistsError:
            self.fs.delete(self.path(beside), False)
            raise

    def rename(self, old: str, new: str) -> None:
        """Refuses an existing target, in one step where the file system can."""
        jvm = self.spark._jvm
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(self.path(old)), self.fs.makeQualified(self.path(new)), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self.exists(new):
                raise FileExistsError(new) from e
            raise

    @contextmanager
    def lock(self, name: str = "_writer.lock") -> Iterator[None]:
        """One writer at a time; a lock that a dead writer left has to be looked at and removed by hand."""
        held = self.path(self.at(name))
        self.fs.mkdirs(self.path(self.root))
        if not self.fs.createNewFile(held):
            raise RuntimeError(f"{self.root} is locked")
        try:
            yield
        finally:
            self.fs.delete(held, False)


def separate(a: str, b: str) -> None:
    """Refuses paths of which one lies in the other."""
    one, two = a.rstrip("/") + "/", b.rstrip("/") + "/"
    if one.startswith(two) or two.startswith(one):
        raise ValueError(f"{a} and {b} overlap")


def write_once(df: DataFrame, path: str, *partitions: str) -> None:
    """Refuses an existing target, and a write that left no success marker."""
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)
    if not Files(df.sparkSession, path).exists(f"{path}/_SUCCESS"):
        raise OSError(f"{path}: no success marker")


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str = "run_date") -> None:
    """Replaces only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_immutable(df: DataFrame, path: str) -> bool:
    """Writes df; if the target is there with the same rows nothing happens, with others it is an error. True if it was written."""
    files = Files(df.sparkSession, path)
    if not files.exists(path):
        write_once(df, path)
        return True
    if not files.exists(f"{path}/_SUCCESS"):
        raise OSError(f"{path}: no success marker")
    old = df.sparkSession.read.parquet(path)
    if sorted(old.columns) != sorted(df.columns) or not multiset_difference(df, old.select(*df.columns)).isEmpty():
        raise FileExistsError(f"{path} holds other rows")
    return False
