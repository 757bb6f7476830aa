"""A document table made into packed training sequences; each stage applies one operator of dayline.llm to what its predecessor kept.

toxicity drops the documents scored 0.5 or more; near_dedup keeps the first document of each group
of near copies; substring_dedup cuts repeated passages out and drops documents left without words;
decontamination drops documents that hold benchmark passages; packing cuts and packs what is left.
Every stage before the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayline.llm import decontam, packing, simhash, substring, toxicity
from dayline.llm.common import stored, table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, n_words=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs, window=35)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), kind="word", end_id=1, size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The stages hash and train, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
