"""Best-fit packing of documents into token sequences by exact-complement hashing.

Pieces are described by their lengths alone, at most `size` different ones, so the histogram of lengths is a bounded
table and the whole packing is planned from it: sums of single lengths, pairs and triples are indexed, combinations
that fill a gap exactly are consumed as often as their counts allow, and what is left goes best-fit, longest first.
The plan is a list of runs ("these ranks of length L go to these sequences at this offset"): each step uses up a length
or a group of alike sequences, so its size follows the number of lengths, not of documents. Each piece finds its run by
its rank among pieces of its length; ranks come from hash parts, counted and offset, so one length may hold any
share of the rows.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, stage, tokenizer_path

#: Hash parts in which pieces of one length are ranked.
PARTS = 4096
RANK_BITS = 44


@functools.cache
def encoder(name: str):
    """text -> ids as tokenizers gives them with add_special_tokens=False, special strings in texts being special ids.

    The vocabulary's rank file, where there is one, gives the same ids several times faster; what it can't encode goes to tokenizers.
    """
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    except (ImportError, OSError):
        return plain

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the pattern's engine gives up on some inputs
            return plain(text)

    return encode


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else whole sequences after a first piece with the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenized(docs: DataFrame, text: str, doc_id: str, tokenizer: str, size: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows, at, ids = [], [], []
            for i, t in enumerate(batch.column(1)):
                own = np.append(encode(t.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(own), size)):
                    part = own[start : start + length]
                    at.append(i)
                    rows.append((k, start, length, crc32(part.tobytes())))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            if rows:
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=schema.names)

    return slim.mapInArrow(pieces, schema)


def plan(counts: np.ndarray, size: int) -> np.ndarray:
    """counts[L]: pieces of length L, 1 <= L <= size. Runs (length, first rank, how many, first sequence, offset), by length and rank."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, first, offset))
        used[length] += n
        left[length] -= n

    there = left > 0
    there[0] = False
    # the index: ordered pairs and triples of lengths that are there, by sum
    pairs = np.convolve(there.astype(np.int64), there.astype(np.int64))
    triples = np.convolve(pairs, there.astype(np.int64))

    def gone(length: int) -> None:
        triples[length : length + len(pairs)] -= 3 * pairs
        triples[2 * length : 2 * length + size + 1] += 3 * there
        triples[3 * length] -= 1
        there[length] = False
        pairs[length : length + size + 1] -= 2 * there
        pairs[2 * length] -= 1

    def fill(length: int) -> tuple[int, ...] | None:
        """The first combination that fills the gap exactly: one length, else two, else three, with large ones first."""
        gap = size - length

        def enough(*rest: int) -> bool:
            return all(left[x] >= n for x, n in Counter((length, *rest)).items())

        if gap == 0:
            return ()
        if there[gap] and enough(gap):
            return (gap,)
        half = np.arange(gap - 1, (gap + 1) // 2 - 1, -1) if pairs[gap] else np.zeros(0, np.int64)
        for a in half[there[half] & there[gap - half]].tolist():
            if enough(a, gap - a):
                return (a, gap - a)
        if not triples[gap]:
            return None
        third = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for a in third[there[third] & (pairs[gap - third] > 0)].tolist():
            rest = gap - a
            below = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)
            for b in below[there[below] & there[rest - below]].tolist():
                if enough(a, b, rest - b):
                    return (a, b, rest - b)
        return None

    for length in range(size, 0, -1):
        while left[length] > 0 and (rest := fill(length)) is not None:
            each = Counter((length, *rest))
            n = min(int(left[x]) // k for x, k in each.items())
            offset = 0
            for x in (length, *rest):
                put(x, n, sequences, offset)
                offset += x
            sequences += n
            for x in each:
                if left[x] == 0:
                    gone(x)

    # best fit of the rest: groups of alike sequences (first, how many) by gap
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        while left[length] > 0:
            gap = min((g for g, found in groups.items() if g >= length and found), default=None)
            if gap is None:
                each = size // length
                for k, n in ((each, int(left[length]) // each), (int(left[length]) % each, 1)):
                    if k and n:
                        for i in range(k):
                            put(length, n, sequences, i * length)
                        groups[size - k * length].append((sequences, n))
                        sequences += n
                continue
            first, n = groups[gap].pop()
            taken = min(n, int(left[length]))
            put(length, taken, first, size - gap)
            groups[gap - length].append((first, taken))
            if taken < n:
                groups[gap].append((first + taken, n - taken))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Each row's tokens, ended by end_id, packed into sequences of `size` at most: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null text is empty (one token, the end). Only rows of more than `size` tokens are cut. Repeated rows and ids are packed like others.
    No rows give no rows; other columns of docs are left out, whatever their names.
    """
    pieces = stage(tokenized(docs, text, doc_id, tokenizer, size, end_id, keep_ids).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS))), "pieces")
    sums = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for length, n in sums.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    runs = plan(counts, size)
    starts = (runs[:, 0] << RANK_BITS) + runs[:, 1]

    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long") - 1)
    ranked = ranked.join(sums.select("length", "part", ahead.alias("ahead")), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    names = [c for c in pieces.columns if c != "part"]
    schema = T.StructType([pieces.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(starts, (length << RANK_BITS) + rank, "right") - 1
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(runs[run, 3] + rank - runs[run, 1]), pa.array(runs[run, 4])], names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(placed, schema)
