"""Scoring texts with a word bigram model by deleted interpolation, and with its add-one unigram base.

    P(v | u) = a[b] c(uv) / c(u) + u[b] c(v) / N + z[b] / (V + 1),    b: bucket of the context's frequency c(u)

The weights of each bucket come from expectation-maximisation on held-out counts: training documents of every 16th hash (but for huge
ones), each judged by the counts of all the others (its own are deleted from them).

Counts cover all training documents and follow them in size; nothing of them goes to the driver or to all executors. Documents are
packed in chunks of tokens, written once; one that a chunk can't hold goes on in the next, led in by its last word, and its sums are added up
at the end. A chunk has its different words and word pairs once, as sorted hashes with counts, cut by
hash range into buckets; a bucket's task sums the counts over all chunks and answers each chunk with them, in its order, without
the hashes. A hot word is one entry of a chunk, so no bucket is hot, and a row of the shuffle is a bucket of a chunk: about
six bytes a pair out and one back. Words are told apart by 64-bit hashes, pairs by 56 bits of theirs, so pairs that collide share a count: the
model's score, not its base, is approximate by as much. There are as many buckets as a fixed number of entries asks for; in a corpus so large that a chunk
has fewer entries than there are buckets, the rows become single entries.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import bound_batches, fold, id_text, stage

#: Tokens of a chunk; entries of a bucket, about; bits of a pair's hash; every so many training documents one is held out for the weights.
CHUNK, BUCKET, PAIR_BITS, HELD_OUT = 1_000_000, 1_000_000, 56, 16
#: Steps of an octave in which probabilities are gathered for the weights.
STEPS = 4
#: Characters of a document that can be held out, at most: it stays in one piece, as its own counts are deleted from all others.
HELD_CHARS = 4_000_000
#: A word in bytes: a run of anything but ASCII white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END_HASH = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes, place by place, compressed; the kind of integer is known to the reader."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes(), 1)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - PAIR_BITS)


class Chunk:
    """Pieces of documents as local word numbers, each document ended by the number of the end; the last word number is the end's.

    A piece that goes on with a document is led in by the word before it, which is context and is neither counted nor scored.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, training: np.ndarray, led: np.ndarray, hashes: np.ndarray):
        self.hashes = np.append(hashes, END_HASH)
        self.order = np.argsort(hashes)
        starts = np.cumsum(sizes) - sizes
        before = np.append(len(hashes), tokens[:-1].astype(np.int64))
        before[starts[starts < len(tokens)]] = len(hashes)
        own = np.ones(len(tokens), bool)
        own[starts[led > 0]] = False
        self.tokens, self.context, self.training = tokens.astype(np.int64)[own], before[own], training
        self.sizes = sizes - (led > 0)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.pairs, self.pair = np.unique(self.context * len(self.hashes) + self.tokens, return_inverse=True)
        self.pair_hashes = mixed(self.hashes[self.pairs // len(self.hashes)], self.hashes[self.pairs % len(self.hashes)])
        self.pair_order = np.argsort(self.pair_hashes)

    def entries(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Kind, bits of a hash, sorted hashes, counts in training."""
        weight = self.training[self.doc]
        words = np.bincount(self.tokens, weight, len(self.hashes)).astype(np.uint32)
        yield 1, 64, self.hashes[self.order], words[self.order]
        pairs = np.bincount(self.pair, weight, len(self.pairs)).astype(np.uint32)
        yield 2, PAIR_BITS, self.pair_hashes[self.pair_order], pairs[self.pair_order]


CHUNKS = "chunk long, kind int, bucket int, rows array<long>, docs array<{}>, tokens binary, sizes binary, training binary, led binary, counts binary, n long, n_training long, ends long"


def pieces_of(text: str, room: Callable[[], int]) -> Iterator[tuple[list[bytes], bool]]:
    """Lower-cased words of a text in pieces of as many as there is room for, and whether the text ends with the piece."""
    data = text.encode().lower()
    if len(data) < 2 * room():
        yield data.split(), True
        return
    words = (m.group() for m in WORD.finditer(data))
    piece = list(islice(words, max(room(), 1)))
    while len(piece) == max(room(), 1):
        following = next(words, None)
        if following is None:
            break
        yield piece, False
        piece = [following, *islice(words, max(room(), 1) - 1)]
    yield piece, True


def chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """docs: doc_id, text, training, held (for the weights). Chunk ids are odd where the documents are held."""
    kind = docs.schema["doc_id"].dataType

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        names = [x.split()[0] for x in CHUNKS.split(", ")]
        task, n_chunks, n_rows = TaskContext.get().partitionId(), 0, 0
        fresh = lambda: ({}, [], [], [], [], [])  # noqa: E731  words, rows, ids, texts, training, led
        open_n, open_ones = {False: 0, True: 0}, {False: fresh(), True: fresh()}

        def closed(held: bool) -> pa.RecordBatch:
            nonlocal n_chunks
            words, rows, ids, texts, training, led = open_ones[held]
            open_ones[held], open_n[held] = fresh(), 0
            tokens = np.concatenate([np.where(t < 0, len(words), t) for t in texts]).astype(np.uint32)
            sizes, flags, leads = np.array([len(t) for t in texts], np.uint32), np.array(training, np.uint8), np.array(led, np.uint8)
            ends = np.array([t[-1] < 0 for t in texts])
            hashes = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
            row = [(task << 32 | n_chunks) << 1 | held, *(packed(x) for x in (tokens, sizes, flags, leads, hashes)), len(tokens), int((sizes.astype(int) - leads)[flags > 0].sum()), int((flags > 0)[ends].sum())]
            n_chunks += 1
            columns = [pa.array([row[0]], pa.int64()), *(pa.array([0], pa.int32()) for _ in range(2)), pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in row[1:6]), *(pa.array([x], pa.int64()) for x in row[6:])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text, training, held in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                last = None
                for piece, ended in pieces_of(text.as_py(), lambda held=held: 2 * HELD_CHARS if held else chunk - open_n[held]):
                    words, rows, ids, texts, flags, led = open_ones[held]
                    own = [words.setdefault(w, len(words)) for w in (piece if last is None else [last, *piece])]
                    if ended:
                        own.append(-1)
                    rows.append(task << 32 | n_rows)
                    ids.append(doc_id)
                    texts.append(np.array(own, np.int64))
                    flags.append(training)
                    led.append(last is not None)
                    last = piece[-1] if piece else None
                    open_n[held] += len(own)
                    if open_n[held] >= chunk or not ended:
                        yield closed(held)
                n_rows += 1
        for held in (False, True):
            if open_ones[held][1]:
                yield closed(held)

    return docs.mapInArrow(made, CHUNKS.format(kind.simpleString()))


def read_chunk(row: dict) -> Chunk:
    return Chunk(unpacked(row["tokens"], np.uint32), unpacked(row["sizes"], np.uint32).astype(np.int64), unpacked(row["training"], np.uint8), unpacked(row["led"], np.uint8), unpacked(row["counts"], np.uint64))


def asked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's sorted hashes and counts, bucket by bucket."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            for kind, width, hashes, counts in read_chunk(row).entries():
                bucket = (hashes >> np.uint64(width - bits)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
                    steps = np.diff(hashes[a:b], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row["chunk"], pa.int64()), (kind, pa.int32()), (int(bucket[a]), pa.int32()), (packed(steps), pa.binary()), (packed(counts[a:b]), pa.binary()))], names=["chunk", "kind", "bucket", "steps", "counts"])


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In order of bucket: the summed counts for each chunk; and how many different words of the bucket are in training (chunk -1)."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def row(chunk: int, kind: int, bucket: int, counts: bytes, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((chunk, pa.int64()), (kind, pa.int32()), (bucket, pa.int32()), (counts, pa.binary()), (n, pa.int64()))], names=["chunk", "kind", "bucket", "counts", "n"])

    for (kind, bucket), group in groupby(rows(), lambda r: (r["kind"], r["bucket"])):
        ids, hashes, counts = [], [], []
        for r in group:
            ids.append(r["chunk"])
            hashes.append(np.cumsum(unpacked(r["steps"], np.uint64), dtype=np.uint64))
            counts.append(unpacked(r["counts"], np.uint32))
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.uint64)
        if kind == 1:
            yield row(-1, kind, bucket, b"", int((total > 0).sum()))
        begin = 0
        for chunk, own in zip(ids, hashes, strict=True):
            yield row(chunk, kind, bucket, packed(total[at[begin : begin + len(own)]]), 0)
            begin += len(own)


class Counted(Chunk):
    """A chunk with the corpus's counts of its words and pairs."""

    def __init__(self, row: dict, words: list[bytes], pairs: list[bytes], ends: int):
        self.__dict__ = read_chunk(row).__dict__
        self.ids, self.rows = row["docs"], row["rows"]
        none = [np.zeros(0, np.uint64)]
        self.word_counts, self.pair_counts = np.zeros(len(self.hashes)), np.zeros(len(self.pairs))
        self.word_counts[self.order] = np.concatenate([unpacked(b, np.uint64) for b in words] or none)
        self.word_counts[-1] = ends
        self.pair_counts[self.pair_order] = np.concatenate([unpacked(b, np.uint64) for b in pairs] or none)


def counted(batches: Iterator[pa.RecordBatch], ends: int) -> Iterator[Counted]:
    """Chunks, each followed by its answers in order of kind and bucket."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    for _, group in groupby(rows(), lambda r: r["chunk"]):
        found: dict[int, list] = {0: [], 1: [], 2: []}
        for r in group:
            found[r["kind"]].append(r if r["kind"] == 0 else r["counts"])
        yield Counted(found[0][0], found[1], found[2], ends)


def frequency_bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def held_out_cells(chunk: Counted, total: int) -> np.ndarray:
    """Cells (bucket, step of the pair's estimate, step of the word's estimate) of tokens of a held-out chunk, each document's own counts deleted."""
    own_word = lambda values: np.unique(chunk.doc * len(chunk.hashes) + values, return_inverse=True, return_counts=True)
    _, at, n = own_word(chunk.tokens)
    word = chunk.word_counts[chunk.tokens] - n[at]
    _, at, n = np.unique(chunk.doc * len(chunk.pairs) + chunk.pair, return_inverse=True, return_counts=True)
    pair = chunk.pair_counts[chunk.pair] - n[at]
    # how often the context stands in the document: as often as it is a context there
    _, at, n = own_word(chunk.context)
    context = chunk.word_counts[chunk.context] - n[at]
    rest = np.maximum(total - chunk.sizes[chunk.doc], 1)
    step = lambda p: np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)  # noqa: E731  1: none
    return np.stack([frequency_bucket(context), step(np.where(context > 0, pair / np.maximum(context, 1), 0)), step(word / rest)], axis=1)


def weights(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (pair, word, uniform) of each frequency bucket up to 64, by expectation-maximisation; buckets without cells take those of all."""
    estimate = lambda step: np.where(step > 0, 0.0, 2.0 ** (np.minimum(step, 0) / STEPS))
    p = np.stack([estimate(cells[:, 1]), estimate(cells[:, 2]), np.full(len(cells), uniform)], axis=1)

    def fit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        w = np.maximum(w, [0.0, 1e-4, 1e-4])
        return w / w.sum()

    overall = fit(p, n) if len(n) else np.array([0.0, 0.5, 0.5])
    out = np.tile(overall, (65, 1))
    for b in np.unique(cells[:, 0]):
        own = cells[:, 0] == b
        out[b] = fit(p[own], n[own])
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]  # an unknown context has no pairs
    return out


def score(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs; training: which rows the counts come from.

    Null text is empty and has its end alone. Repeated rows count and come back as often as they are there. Without training rows every
    token has the probability 1 by the base and by the model. No rows give no rows; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    learn = F.coalesce(training, F.lit(False))
    held = learn & (F.pmod(F.xxhash64(F.lit("weights"), id_text(doc_id)), F.lit(HELD_OUT)) == 0) & (F.length(F.coalesce(F.col(text), F.lit(""))) <= HELD_CHARS)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), learn.alias("training"), held.alias("held"))
    packs = stage(chunks(slim, chunk), "lm-chunks")
    tokens, total, ends, n_chunks = (int(x or 0) for x in packs.agg(F.sum("n"), F.sum("n_training"), F.sum("ends"), F.count("*")).first())
    bits = max(3, (tokens // bucket).bit_length())
    # shuffles as wide as the corpus asks for, so that a task's share is some chunks or buckets however large it is
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for_buckets, for_chunks = max(usual, 1 << bits), max(usual, n_chunks // 2)

    asks = packs.select("chunk", "rows", "docs", "tokens", "sizes", "training", "led", "counts").mapInArrow(lambda b: asked(b, bits), "chunk long, kind int, bucket int, steps binary, counts binary")
    ordered = asks.repartition(for_buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk")
    answers = stage(ordered.mapInArrow(answered, "chunk long, kind int, bucket int, counts binary, n long"), "lm-answers")
    vocabulary = int(answers.where("chunk = -1").agg(F.sum("n")).first()[0] or 0) + (ends > 0)

    def together(condition: str) -> DataFrame:
        blank = ("rows", "docs", "tokens", "sizes", "training", "led")
        own = packs.where(condition).select("chunk", "kind", "bucket", *blank, "counts")
        empty = [F.lit(None).cast(packs.schema[c].dataType).alias(c) for c in blank]
        told = answers.where("chunk >= 0").where(condition).select("chunk", "kind", "bucket", *empty, "counts")
        return own.union(told).repartition(for_chunks, "chunk").sortWithinPartitions("chunk", "kind", "bucket")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in counted(batches, ends):
            found, n = np.unique(held_out_cells(one, total), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*found.T, n)], names=["b", "p", "w", "n"])

    # at most 65 buckets x steps x steps rows, however large the corpus
    gathered = np.array([list(r) for r in together("chunk % 2 = 1").mapInArrow(cells, "b long, p long, w long, n long").groupBy("b", "p", "w").agg(F.sum("n").alias("n")).collect()], np.int64).reshape(-1, 4)
    uniform = 1 / (vocabulary + 1)
    mix = weights(gathered[:, :3], gathered[:, 3].astype(float), uniform)
    id_type = to_arrow_type(slim.schema["doc_id"].dataType)
    numbers = ("n_tokens", T.LongType), ("n_known", T.LongType), ("base_score", T.DoubleType), ("score", T.DoubleType)
    schema = T.StructType([T.StructField("row", T.LongType()), slim.schema["doc_id"]] + [T.StructField(n, k()) for n, k in numbers])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in counted(batches, ends):
            word, pair, context = one.word_counts[one.tokens], one.pair_counts[one.pair], one.word_counts[one.context]
            base = np.log10((word + 1) / (total + vocabulary + 1))
            w = mix[frequency_bucket(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] * uniform
            model = np.log10(p) if total else np.zeros(len(p))
            n = len(one.sizes)
            sums = [np.bincount(one.doc, x, n) for x in ((word > 0).astype(float), base, model)]
            columns = [pa.array(one.sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays([pa.array(one.rows, pa.int64()), pa.array(one.ids, id_type), *columns], names=schema.names)

    pieces = together("true").mapInArrow(scored, schema)
    summed = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(n).alias(n) for n, _ in numbers])
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_folds(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 7, held_out: int = 2) -> DataFrame:
    """score() with the fold crc32(id) mod n = held_out left out of the training; adds held_out."""
    found = score(docs, fold(doc_id, n) != held_out, text, doc_id)
    return found.select("doc_id", (fold("doc_id", n) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
