"""The training-data pipeline: five stages over ``documents``, each one operator of ``pacelens.llm``.

Each stage takes the documents its predecessor kept and returns documents with the
same columns (the last: their tokens); between stages the rows are stored as Parquet
and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pacelens.functions.storage import materialise
from pacelens.llm import bpe, langid, mix, near_dup, toxicity
from pacelens.llm.common import remainder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labelled documents teach; texts without letters or between languages go."""
    return langid.known_language(docs, langid.train(docs.where(remainder("doc_id", 4) != 2)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection score of the toxicity model."""
    return toxicity.not_toxic(docs, toxicity.learn(docs, spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.one_per_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document appears once per time it is taken."""
    return mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document of the mix."""
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The classifier, the alignment and the tokenizer are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
