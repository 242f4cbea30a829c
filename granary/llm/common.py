"""What the operators of this subpackage share: input, staging, connected components, streaming of sorted runs."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.staging import drop, stage

#: A word, as every contract here has it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and bytes, so that very long texts don't fill a Python worker.

    The limits are the session's, as plans are read later; they are only ever lowered.
    """
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None) or "0"
        if not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(name, str(value))


def id_text(column: str | Column) -> Column:
    """An id as text; a null one is the empty text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def fold(column: str | Column, n: int) -> Column:
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(n))


def arrow_table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): node, component (the smallest node that it reaches), for nodes of an edge.

    Alternating large-star and small-star steps: every edge moves to the smallest neighbour until only stars
    are left, in about log(n) rounds, chains too. Only minima by key and equi-joins are used, so a node that
    has very many neighbours is a partial aggregate and a skewed join that Spark splits, never a collected list.
    Loops and repeated edges are harmless; no edges give no rows.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, large.a == low.k).where("b != m").select("b", "m")
        old, now = now, stage(small.union(low.select("k", "m")).toDF("a", "b").distinct(), "cc")
        drop(old)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


# ---------------------------------------------------------------------------------------------- sorted runs


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of `least` rows or more, from batches in key order. Memory: `least` rows, a batch and a run."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = n - 1
        new = np.zeros(n, bool)
        for k in keys:
            column = table[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            held = table.to_batches()
            continue
        cut = int(starts[-1])
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def run_bounds(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        column = table[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of edges (a, b) among nodes 0..n-1 that form a spanning forest."""
    parent = list(range(n))
    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


# ---------------------------------------------------------------------------------------------- tokenizers


@functools.cache
def tokenizer_path(name: str) -> str:
    """Vocabulary files lie outside the repository, at the place their package gives."""
    import public_tokenizers

    return public_tokenizers.path(name)
