"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors fall in buckets of several tables: k random projections each, quantised at a width. k follows from
the number of vectors and the number of tables from the recall wanted at the threshold, so the work grows as
N^(1 + rho), rho about 0.22 at a cosine of 0.93. For each table a vector sends a key and its number, 16 bytes; only in buckets that
several share the vectors themselves follow, and k is chosen so that chance fills few of those. There they are compared by their exact
cosine in double precision. A pair counts in the first table that brings it together (the signatures of linked vectors are computed
again), so links are summed over buckets without a list of pairs; a bucket hands on each vector's number of links and a spanning forest
of them. Equal vectors are one node with a count. A bucket beyond a fixed size is cut in blocks, and each pair of blocks is a bucket of
its own: m vectors send m^2 / BLOCK copies, which only a bucket of so many different vectors needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, components, drop, forest, run_bounds, stage, whole_runs
from granary.llm.vectors import finite, matrix

#: Quantisation width of a projection, for vectors of length 1.
WIDTH = 2.0
#: Vectors of a bucket that are compared in one piece.
BLOCK = 2048
#: Projections beyond one chance companion for a vector and table: each halves, about, the vectors that are sent in vain, and adds tables.
SPARE = 4


def collision(distance: float, width: float) -> float:
    """Chance that a Gaussian projection quantised at `width` puts two points at that distance together."""
    c = width / max(distance, 1e-9)
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_shape(n: int, threshold: float, recall: float, width: float = WIDTH) -> tuple[int, int]:
    """Projections of a table and number of tables: few chance collisions, and the recall at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(4, round(math.log(max(n, 2)) / -math.log(far)) + SPARE)
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def pairs_in_run(x: np.ndarray, signatures: Callable[[np.ndarray], np.ndarray], tables: np.ndarray, apart: np.ndarray, starts: np.ndarray, lengths: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a run that are linked and that no earlier table has brought together.

    x: vectors of length 1. signatures: indices to a bucket of each table. apart: 0 in a run of one block; the block and one in a run of two,
    where only pairs across them count.
    """

    def across(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (apart[a] == 0) | (apart[a] != apart[b])
        return a[own], b[own]

    def fresh(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        new = np.ones(len(a), bool)
        if not len(a):
            return new
        nodes, at = np.unique(np.append(a, b), return_inverse=True)
        signs = np.concatenate([signatures(nodes[i : i + 1000]) for i in range(0, len(nodes), 1000)])
        at_a, at_b = at[: len(a)], at[len(a) :]
        for j in range(int(tables[a].max())):
            new &= (signs[at_a, j] != signs[at_b, j]) | (tables[a] <= j)
        return new

    def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 50_000]], x[b[i : i + 50_000]]) for i in range(0, len(a), 50_000)] or [np.zeros(0)]) >= threshold
        return a[near], b[near]

    found: list[tuple[np.ndarray, np.ndarray]] = []
    short = (lengths > 1) & (lengths <= 32)
    for d in range(1, int(lengths[short].max(initial=1))):
        own = short & (lengths > d)
        n = lengths[own] - d
        a = np.repeat(starts[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        found.append(linked(*across(a, a + d)))
    if found:
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        new = fresh(a, b)
        yield a[new], b[new]
    for s, n in zip(starts[lengths > 32].tolist(), lengths[lengths > 32].tolist(), strict=True):
        for i in range(s, s + n, 256):
            near = x[i : min(i + 256, s + n)] @ x[i : s + n].T >= threshold
            a, b = np.nonzero(near)
            a, b = across(a[b > a] + i, b[b > a] + i)
            new = fresh(a, b)
            yield a[new], b[new]


def shared(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in order of key those whose key comes more than once, with their block by place in the run. Memory: a batch."""
    key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last row, whose successor isn't known yet
    place, before = 0, False  # its place in its run, and whether one of its key came before it

    def some(own_key: np.ndarray, own_node: np.ndarray, at: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own_key[good]), pa.array(own_node[good]), pa.array((at[good] // block).astype(np.int32))], names=["key", "node", "block"])

    for batch in batches:
        key, node = np.append(key, batch.column(0).to_numpy()), np.append(node, batch.column(1).to_numpy())
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        like = np.append(before, same)  # of the same key as the row before
        first = np.where(like, np.iinfo(np.int64).min, np.arange(len(key)))  # where a run begins
        first[0] = -place
        at = np.arange(len(key)) - np.maximum.accumulate(first)
        yield some(key[:-1], node[:-1], at[:-1], like[:-1] | same)
        key, node, place, before = key[-1:], node[-1:], int(at[-1]), bool(like[-1])
    yield some(key, node, np.full(len(key), place), np.full(len(key), before))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.999, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors: links by cosine >= threshold within a label.

    No link: null label, null or zero vector, null or non-finite components. Shorter vectors count as filled up with zeros.
    Equal vectors of a label link however often they come. Rows that link with nothing are their own component; a null id takes part
    but names no component that has another. No rows give no rows; other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 4000)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    ok = F.col("label").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.coalesce(ok, F.lit(False)))
    nodes = valid.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest, width = nodes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).agg(F.max("n"), F.max("w")).first()
    alone = rows.where(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if largest is None:
        return alone
    k, tables = table_shape(largest, threshold, recall)

    random = np.random.default_rng(seed)
    directions, shifts = random.standard_normal((width, tables * k)), random.uniform(0, WIDTH, tables * k)
    mixers = random.integers(1, 2**62, tables * k, dtype=np.int64) * 2 + 1

    def signatures(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """A 32-bit bucket of each table."""
        cells = np.floor((x @ directions + shifts) / WIDTH).astype(np.int64)
        with np.errstate(over="ignore"):
            mixed = (cells * mixers).reshape(len(x), tables, k).sum(axis=2) + labels[:, None]
            mixed = (mixed ^ (mixed >> 29)) * np.int64(0x1F85D3B5A7C649E3)
        return (mixed >> 32).astype(np.int32)

    kind = np.float32 if nodes.schema["v"].dataType.elementType == T.FloatType() else np.float64
    long = lambda name: T.StructField(name, T.LongType())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                x = matrix(some.column(2), width)
                signs = signatures(x / np.linalg.norm(x, axis=1, keepdims=True), some.column(1).to_numpy())
                key = np.arange(tables)[None, :] << 32 | (signs.astype(np.int64) & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(some.column(0).to_numpy(), tables))], names=["key", "node"])

    hashed = nodes.select("node", F.xxhash64("label").alias("lab"), "v")
    keyed = hashed.mapInArrow(keys, T.StructType([long("key"), long("node")])).repartition("key").sortWithinPartitions("key", "node")
    members = stage(keyed.mapInArrow(lambda b: shared(b, block), "key long, node long, block int"), "members")
    crowded = stage(members.where("block > 0").groupBy("key").agg((F.max("block") + 1).alias("blocks")), "crowded")
    if crowded.isEmpty():
        parted = members.select("key", "node", "block", F.lit(0).alias("low"), F.lit(0).alias("high"))
    else:
        parted = members.join(crowded, "key", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        parted = parted.select("key", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "low", "high"]
        for table in whole_runs(batches, names, 20_000):
            starts, lengths = run_bounds(table, names)
            x = matrix(table["v"].combine_chunks(), width).astype(kind).astype(np.float64)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            node, n, lab = (table[c].to_numpy() for c in ("node", "n", "lab"))
            apart = np.where(table["low"].to_numpy() == table["high"].to_numpy(), 0, table["block"].to_numpy() + 1)
            counts = np.zeros(len(x), np.int64)
            edges = np.zeros((0, 2), np.int64)
            for a, b in pairs_in_run(x, lambda at, x=x, lab=lab: signatures(x[at], lab[at]), table["key"].to_numpy() >> 32, apart, starts, lengths, threshold):
                same = lab[a] == lab[b]
                a, b = a[same], b[same]
                np.add.at(counts, a, n[b])
                np.add.at(counts, b, n[a])
                edges = np.concatenate([edges, np.stack([a, b], axis=1)])
                if len(edges) > 200_000:
                    edges = edges[forest(len(x), edges[:, 0], edges[:, 1])]
            edges = node[edges[forest(len(x), edges[:, 0], edges[:, 1])]]
            some = counts > 0
            none = pa.nulls(len(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), none], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(counts[some])], names=["a", "b", "links"])

    carried = parted.join(nodes.select("node", "n", F.xxhash64("label").alias("lab"), "v"), "node")
    ordered = carried.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").select("key", "low", "high", "block", "node", "n", "lab", "v")
    found = stage(ordered.mapInArrow(linked, T.StructType([long("a"), long("b"), long("links")])), "vector-links")
    drop(members)
    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).toDF("node", "links")
    roots = components(found.where("links is null").select("a", "b")).toDF("node", "root")
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    lowest = named.groupBy("root").agg(F.min("first").cast("long").alias("component_id"))
    named = named.join(lowest, "root").select("label", "v", F.col("links").cast("long").alias("n_links"), "component_id")
    joined = valid.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return joined.unionByName(alone)
