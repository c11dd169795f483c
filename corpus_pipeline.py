"""A corpus from raw documents: toxic ones go, repeated lines and near copies go, benchmark leaks go, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphwarden.functions.storage import cut
from graphwarden.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from graphwarden.llm.streams import apart, prepared, table
from graphwarden.plans.registry import Registry

query = Registry()

#: near copies: word n-grams of so many words, and NEAR_DEN * overlap >= NEAR_NUM * union
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model is learned from this stage's documents and ``labels``."""
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text").cast("string")) < toxicity.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that equal or nearly equal a line kept elsewhere."""
    prepared(spark)
    return line_dedup.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word n-grams (five words, 0.8) the one with the smallest id, and every document without links.

    Rows with equal ids count as one document; rows with a null id are kept.
    """
    prepared(spark)
    classes = ngram_join.join(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)
    extra = cut(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__extra")).distinct(), "extra")
    some, rest = apart(docs, "doc_id", extra, "__extra")
    return some.join(extra, some["doc_id"] == F.col("__extra"), "leftanti").unionByName(rest)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents left."""
    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks), ("best-fit packing", pack),
]
#: training a classifier and fuzzy links are beyond SQL; the stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "_"))
    return docs


query("pipeline", ORACLE_SQL)(run)
