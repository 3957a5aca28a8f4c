"""Corpus preparation: toxic documents go, one document of each near-duplicate group stays, the sources are
mixed to their target weights (documents of scarce sources repeat), and the mix is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a frame that is written as Parquet and read again.  All stages but the last
return the columns of ``documents``.  Null texts count as empty, rows without an id
stay in the near-duplicate stage, and an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import bpe, mixing, simhash, toxicity
from statloom.llm.common import materialize, read_table
from statloom.llm.queries import TOKENIZERS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The network is trained on the labelled rows of these documents that are not held out."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.train(*toxicity.training_sample(docs, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, one row per document of the mix."""
    return bpe.digests(bpe.encode_decode(docs, f"{TOKENIZERS}/byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: The network and the merges cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
