"""Token counts of whole texts, huge ones by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets, and neighbours are spliced at a boundary inside their
overlap that is proven stable: the two characters that meet there stand together in no piece of the vocabulary, so no
merge can ever cross it and what lies on one side can't change the other. Both encodings must also show a token
boundary there. Where the overlap holds no such place it is widened, at last to the whole text. Memory and time
then follow the chunk, not the text, and the count equals that of the whole text exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, tokenizer_path

#: Characters: texts beyond HUGE go in chunks of CHUNK that overlap by OVERLAP at first.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256


class Counter:
    """Counts tokens with a sentencepiece (.model) or tokenizers (.json) file."""

    def __init__(self, name: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.together: set[str] | None = None  # pairs of characters in pieces; None: unknown, so nothing is proven
        path = tokenizer_path(name)
        if name.endswith(".json"):
            import tokenizers

            own = tokenizers.Tokenizer.from_file(path)
            self.counts = lambda texts: [len(x) for x in own.encode_batch(texts, add_special_tokens=False)]
            return
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.counts = lambda texts: [len(x) for x in self.own.encode(texts, num_threads=1)]
        plain = model.normalizer_spec
        if model.trainer_spec.model_type == model.trainer_spec.BPE and plain.name == "identity" and not plain.precompiled_charsmap and not plain.remove_extra_whitespaces and not plain.normalization_rule_tsv:
            usual = [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
            self.together = {p[i : i + 2] for p in usual for i in range(len(p) - 1)}

    def ends(self, text: str, start: int) -> list[int]:
        """Where the tokens of a chunk that starts at `start` end, in characters of the whole text."""
        found, at, held = [], start - 1, 0  # the encoder puts a space before the chunk
        for piece in self.own.encode(text, out_type=str):
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                held = held or self.byte_length(int(piece[3:5], 16))
                held -= 1
                at += held == 0
            else:
                at += len(piece)
            found.append(at)
        return found

    @staticmethod
    def byte_length(first: int) -> int:
        return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4

    def stable(self, text: str, at: int) -> bool:
        pair = text[at - 1 : at + 1].replace(" ", "▁")
        return pair not in self.together

    def count_huge(self, text: str) -> int:
        total, lo, done = 0, 0, -1  # done: the stable boundary up to which tokens are counted
        hi = self.chunk
        ends = self.ends(text[:hi], 0)
        while hi < len(text):
            overlap, spliced = self.overlap, False
            while not spliced:
                start = hi - overlap
                if start <= done:  # no stable boundary in all of the chunk: double it, so that all of this takes linear time
                    hi = min(len(text), lo + 2 * (hi - lo))
                    ends = self.ends(text[lo:hi], lo)
                    if hi == len(text):
                        break
                    overlap = self.overlap
                    continue
                places = [b for b in range(hi - 1, start, -1) if self.stable(text, b)]
                if places:  # else there is nothing to encode for
                    stop = min(len(text), start + self.chunk + overlap)
                    after = self.ends(text[start:stop], start)
                    common = set(ends).intersection(after)
                    b = next((b for b in places if b in common), None)
                    if b is not None:
                        total += sum(done < e <= b for e in ends)
                        lo, done, hi, ends, spliced = start, b, stop, after, True
                        continue
                overlap *= 2
        return total + sum(e > done for e in ends)

    def __call__(self, texts: list[str]) -> list[int]:
        found = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if self.together is None or len(t) <= self.huge]
        for i, n in zip(short, self.counts([texts[i] for i in short]), strict=True):
            found[i] = n
        for i in set(range(len(texts))).difference(short):
            found[i] = self.count_huge(texts[i])
        return found


@functools.cache
def counter(name: str) -> Counter:
    return Counter(name)


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, repeated ones too. Null text is empty: no bytes, no tokens.

    No begin, end or added special tokens, no truncation; special strings in a text are ordinary text where the library has it so.
    Other columns are left out, whatever their names; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            n = count(batch.column(1).to_pylist())
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return slim.mapInArrow(counted, schema)
