"""Corpus preparation from end to end.

Each stage takes all documents that its predecessor kept and returns the columns of documents,
the last one the encoded form of each text: its token ids, the text decoded from them, their
number and the digests of both.

Defined cases, stage by stage: a null text counts as empty; empty texts are not toxic, are copies of
one another, of which one stays, and are never near copies; a null doc_id is an id like others for
copies and takes no part in near copies, so such rows stay; rows that are alike stay once; ties are
settled by the smallest doc_id, and in mixing by a seeded order; texts of any length are taken
whole; columns beyond those of documents pass through all stages but the last; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import quarryflow
from quarryflow.llm import bpe_lexicon, exact_dedup, mixing, ngram_join, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    quarryflow.ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    quarryflow.ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    quarryflow.ship(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    quarryflow.ship(spark)
    return mixing.keep_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # its files are needed here alone

    quarryflow.ship(spark)
    return bpe_lexicon.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, carry=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("encode", encode)]
#: The toxicity model and the encoder have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    from quarryflow.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
