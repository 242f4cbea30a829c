"""Exact top-k search by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components are integers, floor(scale * x), and scores exact. Vectors stand in partitions by descending length. A query's
threshold starts from the longest vectors and rises with what its task finds. A block of vectors is left out for a query if the
product of lengths can't reach the threshold; in other blocks the sum over the leading axes of the SVD plus the product of the
residual lengths is an upper bound, and only what passes it is scored. Bounds get a margin for rounding, so none of the best is lost.

Queries come in blocks bounded in bytes, each a pass over the index whose results are written before the next block is broadcast, so the
driver holds one block however many there are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, stage
from granary.llm.vectors import finite, matrix

#: Bytes of a pass's queries (vectors, as they are and rotated, and best so far), and longest vectors from which their thresholds start.
QUERY_BYTES, HEAD = 32 << 20, 2048
#: Vectors and queries of a block in a task.
ROWS, AT_ONCE = 2048, 1024


def exact_scores(a: np.ndarray, b: np.ndarray, large: bool) -> np.ndarray:
    """Inner products of rows with rows; with large components as Python's integers, held to the range of a long."""
    if not large:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    limit = 2**63 - 1
    return np.array([max(-limit - 1, min(limit, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))) for x, y in zip(a, b, strict=True)], np.int64)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    ordered = query[order]
    first = np.append(True, ordered[1:] != ordered[:-1])[: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[place < k]


class Search:
    """One task's search: thresholds and best so far of all queries of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int, large: bool):
        self.ids, self.vectors, self.axes, self.k, self.large = ids, vectors, axes, k, large
        self.lead = max(1, len(axes) // 2)
        self.turned = vectors @ axes
        self.norms = np.linalg.norm(vectors, axis=1)
        self.rest = np.linalg.norm(self.turned[:, self.lead :], axis=1)
        self.least = np.full(len(ids), -np.inf)  # a score below it is not among the best
        self.forget()

    def forget(self) -> None:
        """Drops what was found; thresholds stay."""
        self.own = {q: np.zeros((3, 0), np.int64) for q in range(0, len(self.ids), AT_ONCE)}  # of each slice of queries: query, id, score

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.linalg.norm(vectors, axis=1)
        turned = vectors @ self.axes
        rest = np.linalg.norm(turned[:, self.lead :], axis=1)
        for q in self.own:
            reach = self.norms[q : q + AT_ONCE] * norms.max()
            some = q + np.flatnonzero(reach * (1 + 1e-9) + 1e-6 >= self.least[q : q + AT_ONCE])
            if not len(some):
                continue
            bound = turned[:, : self.lead] @ self.turned[some, : self.lead].T + rest[:, None] * self.rest[some][None, :]
            bound += 1e-9 * norms[:, None] * self.norms[some][None, :] + 1e-6
            c, j = np.nonzero(bound >= self.least[some][None, :])
            for i in range(0, len(c), 400_000):
                at, own = c[i : i + 400_000], some[j[i : i + 400_000]]
                score = exact_scores(vectors[at], self.vectors[own], self.large)
                good = (score >= self.least[own]) & (ids[at] != self.ids[own])
                self.merge(q, np.stack([own[good], ids[at][good], score[good]]))

    def merge(self, q: int, found: np.ndarray) -> None:
        if not found.shape[1]:
            return
        every = np.concatenate([self.own[q], found], axis=1)
        every = self.own[q] = every[:, best(every[0], every[1], every[2], self.k)]
        query, n = np.unique(every[0], return_counts=True)
        last = np.cumsum(n) - 1
        full = n == self.k
        self.least[query[full]] = np.maximum(self.least[query[full]], every[2][last[full]])


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: float = 256.0, at_once: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with all rows of other ids.

    Ties go to the smaller id; fewer than k candidates give fewer rows. Vectors that are null or hold null or non-finite components, and rows
    of a null id, take no part. Shorter vectors count as filled up with zeros. A repeated query row has its results repeated; repeated
    candidates each take a rank. Scores beyond a long are held to its range, a departure from exact scores that needs components beyond
    10^16 or so. at_once: queries of a pass, as many as QUERY_BYTES hold unless given. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 4000)
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    slim = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & finite("v"))
    slim = slim.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52 / scale, F.floor(x * scale).cast("double")).otherwise(x * scale)))
    index = slim.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    index = stage(index.repartitionByRange(F.desc("norm"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm")), "index")
    width, n_queries, most = index.agg(F.max(F.size("v")), F.count_if("query"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n_queries or not width:
        return spark.createDataFrame([], out)
    large = most * most * width >= 2.0**53

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width) / max(most, 1e-300)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.reshape(-1))], names=["cell", "sum"])

    cells = index.select("v").mapInArrow(products, "cell long, sum double").groupBy("cell").agg(F.sum("sum")).collect()  # width x width
    gram = np.zeros(width * width)
    for cell, total in cells:
        gram[cell] = total
    axes = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()  # right singular vectors of all rows, the leading ones first
    head = index.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "v").toArrow().combine_chunks()
    head_ids, head_vectors = head["id"].to_numpy(), matrix(head["v"].combine_chunks(), width)

    passes = math.ceil(n_queries / (at_once or max(1, QUERY_BYTES // (16 * width + 24 * k + 64))))
    queries = index.where("query").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(passes)).cast("int").alias("pass"))
    if passes > 1:
        queries = stage(queries.repartition("pass").sortWithinPartitions("pass"), "queries")
    results = []
    for p in range(passes):
        mine = queries.where(F.col("pass") == p).select("id", "v").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        search = Search(mine["id"].to_numpy(), matrix(mine["v"].combine_chunks(), width), axes, k, large)
        del mine
        search.add(head_ids, head_vectors)
        search.forget()  # the head is found again in its partition
        shared = spark.sparkContext.broadcast(search)
        del search

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            own.least = own.least.copy()
            own.forget()
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    some = batch.slice(i, ROWS)
                    own.add(some.column(0).to_numpy(), matrix(some.column(1), width))
            for found in own.own.values():
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(own.ids[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["row", "query_id", "vec_id", "score"])

        found = index.select("id", "v").mapInArrow(searched, "row long, query_id long, vec_id long, score long").withColumn("row", F.col("row") * passes + p)
        results.append(stage(top(found, k), "top-k"))
        shared.destroy()
    return functools.reduce(DataFrame.unionAll, results).select("query_id", "rank", "vec_id", "score") if results else spark.createDataFrame([], out)


def top(found: DataFrame, k: int) -> DataFrame:
    """The best of each query over all tasks, ranked."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
