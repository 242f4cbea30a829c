"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at 4 or fewer differing bits. They are cut in three segments of 22, 21 and 21 bits, each
a word of the perfect binary Golay code [23, 12, 7]. Words at distance 2 or less have a codeword in common within
radius 4 (that of the word midway), and a word has one such codeword or six; words at distance 1 have each other's
nearest codeword within radius 4. Of 4 errors over three segments, the two segments with the fewest hold

* none and two at most: keys (one segment as it is, a codeword index of another within radius 4), or
* one each: keys (nearest codeword index of one, a codeword index of the other within radius 4), both ways round,

which is some 61 keys for a fingerprint. The second kind has 24 bits; from WIDE fingerprints on it also bears a codeword index of the
third segment within radius 4 (its errors are two at most), 36 bits and some 185 keys, and finds the same links. Fingerprints that share a key are compared; each bucket yields a spanning forest of
its links, never all pairs. In a bucket too large to compare, all fingerprints give every word within 2 bits of
them instead, and those that share a word (they are linked, with no need to compare) link to the smallest: linear and exact.
Texts are reduced to different fingerprints first, so copies, however many, are one node.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, components, forest, run_bounds, stage, whole_runs

SEED = 42
WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints of a bucket that are compared with each other; beyond it the words around them are joined.
LARGE_BUCKET = 4096
#: Different fingerprints from which keys are wide: buckets of 24 bits would hold a few hundred by chance.
WIDE = 1 << 27


# ---------------------------------------------------------------------------------------------- fingerprints


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit, lowest first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[i : i + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
            total += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str, width: int = 4) -> int:
    """A bit is set where it is in over half the XXH64 hashes of the text's shingles, repeats included; no words give 0."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    ends = list(accumulate([len(w) + 1 for w in words]))
    n = len(words) - width + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(chain((0,), ends), ends[width - 1 :], strict=False)), np.uint64, n)
    return int(np.packbits(2 * bit_counts(hashes) > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every row of docs."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return slim.mapInArrow(made, T.StructType([slim.schema["doc_id"], T.StructField("fp", T.LongType())]))


# ---------------------------------------------------------------------------------------------- keys


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and the lower 11 bits of a word; by syndrome, what turns a word's upper bits into the
    indices of the codewords within radius 4, nearest first, and how many there are (1 or 6)."""

    def rest(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    upper = np.array([rest(m << 11) for m in range(4096)], np.int64)
    lower = np.arange(2048, dtype=np.int64)
    codewords = [(m << 11) ^ int(upper[m]) for m in range(4096)]
    sevens = [c for c in codewords if c.bit_count() == 7]
    change, several = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            at = upper[error >> 11] ^ lower[error & 2047]
            near = [error, *(error ^ c for c in sevens if weight == 3 and c & error == error)]
            change[at, : len(near)], several[at] = [e >> 11 for e in near], len(near)
    return upper, lower, change, several


def keys_of(fps: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The keys of fingerprints (unsigned 64 bits), and which fingerprint each belongs to."""
    upper, lower, change, several = golay()
    segments = [(fps >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    lists, there = [], []
    for x in segments:
        syndrome = upper[x >> 11] ^ lower[x & 2047]
        lists.append((x >> 11)[:, None] ^ change[syndrome])
        there.append(np.arange(6)[None, :] < several[syndrome][:, None])
    keys, owners, kind = [], [], 0

    def add(first: np.ndarray, rest: np.ndarray, valid: np.ndarray) -> None:
        nonlocal kind
        all_keys = (kind << 40) | (first << 12) | rest
        keys.append(all_keys[valid])
        owners.append(np.nonzero(valid)[0])

    for i in range(3):
        for j in range(3):
            if i != j:
                add(segments[i][:, None], lists[j], there[j])
                kind += 1
    for i, j in combinations(range(3), 2):
        k = 3 - i - j
        for of_i, of_j, valid in ((lists[i][:, :1], lists[j], there[j]), (lists[i][:, 1:], lists[j][:, :1], there[i][:, 1:])):
            if wide:
                both = (of_i << 12) | of_j
                add(both[:, :, None], lists[k][:, None, :], valid[:, :, None] & there[k][:, None, :])
            else:
                add(of_i, of_j, valid)
        kind += 1
    return np.concatenate(keys), np.concatenate(owners)


KEYED = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def keyed(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for i in range(0, len(fps), 20_000):
            keys, owners = keys_of(fps[i : i + 20_000].view(np.uint64), wide)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[i : i + 20_000][owners])], names=["key", "fp"])


def links_in_runs(fps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within runs at `radius` bits or fewer: for long runs a spanning forest, for short ones all."""
    found_a, found_b = [], []
    short = (lengths > 1) & (lengths <= 32)
    for d in range(1, int(lengths[short].max(initial=1))):
        own = short & (lengths > d)
        n = lengths[own] - d
        at = np.repeat(starts[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        near = np.bitwise_count(fps[at] ^ fps[at + d]) <= radius
        found_a.append(at[near])
        found_b.append(at[near] + d)
    for s, n in zip(starts[lengths > 32].tolist(), lengths[lengths > 32].tolist(), strict=True):
        own = fps[s : s + n]
        a = b = np.zeros(0, np.int64)
        for i in range(0, n, 256):
            x, y = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= radius)
            a, b = np.append(a, x[x < y] + i), np.append(b, y[x < y] + i)
            kept = forest(n, a, b)
            a, b = a[kept], b[kept]
        found_a.append(a + s)
        found_b.append(b + s)
    return np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b])


def links(fps: DataFrame, radius: int = 4, large: int = LARGE_BUCKET, wide: int = WIDE) -> DataFrame:
    """fps: fp, all different. Edges a, b that connect whatever the links connect; each is itself a link."""
    many = fps.count() >= wide
    keys = fps.mapInArrow(lambda batches: keyed(batches, many), KEYED)
    crowded = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key"), "crowded")
    extra = None
    if not crowded.isEmpty():
        inside = keys.join(crowded, "key", "left_semi").select("fp").distinct()
        keys = keys.join(crowded, "key", "left_anti")
        extra = stage(around(inside, radius // 2), "around")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["key"]):
            starts, lengths = run_bounds(table, ["key"])
            own = table["fp"].to_numpy()
            a, b = links_in_runs(own.view(np.uint64), starts, lengths, radius)
            pairs = np.unique(np.stack([np.minimum(own[a], own[b]), np.maximum(own[a], own[b])], axis=1), axis=0)
            nodes, at = np.unique(pairs, return_inverse=True)
            at = at.reshape(pairs.shape)
            pairs = pairs[forest(len(nodes), at[:, 0], at[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    found = keys.repartition("key").sortWithinPartitions("key").mapInArrow(linked, EDGES)
    return found if extra is None else found.union(extra)


def around(fps: DataFrame, radius: int) -> DataFrame:
    """Edges from each fingerprint to the smallest of those that have a word within `radius` bits in common with it."""
    flips = np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)], np.uint64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for i in range(0, len(own), 64):
                some = own[i : i + 64]
                every = (some.view(np.uint64)[:, None] ^ flips[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(np.repeat(some, len(flips)))], names=["key", "fp"])

    every = fps.mapInArrow(words, KEYED)
    low = every.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return every.join(low, "key").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def roots(rows: DataFrame, radius: int = 4) -> DataFrame:
    """rows: doc_id, fp. fp, first (its smallest id), root (the same for all fingerprints of a group) of every different fingerprint."""
    first = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-first")
    found = components(links(first.select("fp"), radius)).toDF("fp", "root")
    return first.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    rows = stage(fingerprints(docs, text, doc_id, width), "fps")
    rooted = roots(rows, radius)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links) of every row of docs.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come back as often as they came. A null id takes
    part, but names a group only if the group has no other. No rows give no rows; other columns are left out, whatever their names.
    """
    return grouped(docs, text, doc_id, width, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def marked(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with a column __fp, the fingerprint; all their columns are kept."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    at = docs.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=schema.names)

    return docs.mapInArrow(made, schema)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates: the one with the group's smallest id (any one of those that share it and a fingerprint).

    Null and empty texts have fingerprint 0 and link like any other. An id that one row bears names that row. Rows of a null id or of an id
    that comes again are told apart by their fingerprints. No rows give no rows; other columns are kept as they are, whatever their names.
    """
    rows = stage(fingerprints(docs, text, doc_id, width), "fps")
    lowest = roots(rows, radius).groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("low"))
    # rows that bear a kept id and fingerprint: how many, and of how many that bear the id; one alone needs no second look at its text
    kept = lowest.select(F.col("low.first").alias("__id"), F.col("low.fp").alias("__fp"))
    borne = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("__same")).agg(F.count("*").alias("__n"))
    kept = stage(kept.join(borne, kept["__id"] == borne["__same"], "left").select("__id", "__fp", F.coalesce("__n", F.lit(2)).alias("__n")), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sole = kept.where("__n = 1").select("__id")
    once = docs.join(sole, docs[doc_id] == sole["__id"], "left_semi")
    unsure = kept.where("__n > 1").toDF("__kept", "__print", "__n")
    if unsure.isEmpty():
        return once
    named = unsure.select(F.col("__kept").alias("__id")).where("__id is not null").distinct()
    again = docs.where(F.col(doc_id).isNull()).unionAll(docs.join(named, docs[doc_id] == named["__id"], "left_semi"))
    own = marked(again, text, width)
    own = own.join(unsure, own[doc_id].eqNullSafe(F.col("__kept")) & (own["__fp"] == F.col("__print")))
    return once.unionAll(own.dropDuplicates([doc_id, "__fp"]).select(*columns))
