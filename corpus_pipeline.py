"""A training-data pipeline over ``documents``: language ID, one text per near-duplicate group, repeats out, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages
the documents are written as Parquet and read again, so a lost executor never
costs more than the stage in hand. Rows are known by themselves, not by doc_id, so
null and repeated ids lose nothing; an empty table gives no rows. All stages but the last return the columns of
their input; what a stage drops or cuts is gone for those behind it. Stages run after they
return, so the bound that they set on batches for Python stays in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revscope.llm import jaccard, language_id, packing, suffix_dedup
from revscope.llm._common import bound_batches, documents, staged


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, that is without a letter, go."""
    bound_batches(spark)
    return language_id.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    bound_batches(spark)
    return jaccard.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out."""
    bound_batches(spark)
    return suffix_dedup.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, and their places in sequences of 2048 tokens."""
    bound_batches(spark)
    return packing.pack(packing.pieces(docs, with_ids=True))


STAGES = [("language_id", identified), ("jaccard_join", distinct), ("substring_dedup", unrepeated), ("best_fit_packing", packed)]

#: Language models and tokenizers have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
