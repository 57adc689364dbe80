"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame.

All but the last return the columns of docs, whatever they are and whatever their
names, and change no row that stays. What holds for every stage: an empty table
gives an empty table; texts are read whole, however long; nothing is an error that
can be in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, mixing, packing, simhash
from .common import materialise


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones, too), or whose language stays unclear, go.

    Rows without an id are learned from and judged like any other; rows repeated in full are judged alike; a score
    that equals the least one (a tie) is enough.
    """
    return language_id.keep_identified(docs, tokenizer_path("piece_bpe_32k.model"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest with its white space, on a tie the one with the smallest id.

    A null text equals an empty one. A row without an id stays only where none of its length has one; of rows that
    repeat id and text one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with the smallest id, on a tie the smallest SHA-256 of its text.

    Texts without a word are one component. Rows without an id come last; of rows that repeat id and text one stays.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source; rows that share an id, or have none, share their draw; documents without a word count
    nothing and are emitted at their source's rate.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the training sequences.

    A document that the mix repeats is packed as often; `row_key` tells its copies' pieces apart. Null and empty texts
    are one end token.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and token ids have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
