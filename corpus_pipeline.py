"""The corpus pipeline: toxic documents go, near copies go, personal data is masked, sources are mixed, and what is left is packed.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import mixing, packing, pii, simhash, toxicity
from granary.llm.common import read
from granary.sources.staging import drop, scope, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar of op6 scores below 0.7. Null and empty texts stay, repeated rows fare alike, no rows give none."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that SimHash links as in op3.

    Null and texts without words are one group; of rows that share id and text one stays; null ids are told apart by their texts.
    """
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that op8 finds, replaced by their type; n_chars follows the text, null for null text. Every row stays."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as op9 takes it; a null source is a source; texts without words come along once."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens at most, as in op1; null text is its end alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, tokenizing and learning have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's own intermediate tables go when it is written, its input when the next stage is."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, kept = docs, []
        with scope(spark, kept):
            docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
