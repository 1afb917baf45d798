"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, SentencePiece encoding.

Each stage works on all rows its predecessor kept and writes its result as Parquet into the shared folder; the next reads it back, and what it has read is dropped.

Defined results: a null or empty text is an ordinary document to the first stage, of all such texts the one with the largest id stays, and it is encoded to no ids; repeated rows and ids
are copies where their texts are; an empty table goes through to an empty result; documents keep extra columns, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filewright.llm import decontamination, exact_dedup, near_dedup, sentencepieces, toxicity
from filewright.llm.common import drop_staged, staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels (outside the held-out part) train the models on these documents."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest id."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (the ids decode to the text) and ids."""
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: Trained scores, sampled signatures and BPE ids can't be expressed in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents on."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if read is not None:
            drop_staged(read)
        read = docs
    return docs
