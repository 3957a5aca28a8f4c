"""The registered queries of the training-data operators: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import (ann, bpe, hard_negatives, html_extract, lattice_lm, licenses, mixing, packing, periodic, simhash,
                          toxicity, urlfilter, vecdedup)
from statloom.llm.common import read_table

#: Where the public tokenizers' files lie on the driver.
TOKENIZERS = "/opt/tokenizers"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return bpe.digests(coded)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


#: The rules of op3.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.train(urlfilter.labelled(spark))
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), URL_RULES, model)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes(read_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs, toxicity.train(*toxicity.training_sample(docs, labels)))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read_table(spark, sf_dir, "documents")))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op10_vecdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.digests(packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.detect(periodic.planted(read_table(spark, sf_dir, "documents"))))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(read_table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op4_html": op4_html, "op9_lattice_lm": op9_lattice_lm, "op8_licenses": op8_licenses, "op7_toxicity": op7_toxicity, "op3_urlfilter": op3_urlfilter, "op2_ann": op2_ann, "op10_vecdedup": op10_vecdedup, "op1_bpe": op1_bpe, "op5_simhash": op5_simhash, "op6_mixing": op6_mixing,
           "op11_packing": op11_packing, "op12_periodic": op12_periodic, "op13_negatives": op13_negatives}

SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op10_vecdedup": vecdedup.SQL, "op13_negatives": hard_negatives.SQL}
