"""Cleaning and packing of a corpus: toxicity, quality, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor
kept; all but the last return the columns of ``documents``.  Nulls in any column, empty texts,
repeated rows and empty tables pass through: a null text is an empty one, and a null id is in no
label's fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, quality, toxicity
from tidemark.llm.common import fold, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject; without labels of both kinds all of them."""
    chain = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score_toxicity(docs, chain).where(F.col("predicted") == 0).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality operator doesn't reject.  Labels of one kind alone decide for all
    documents; without labels all stay."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.score_quality(docs, rules).where(F.col("predicted") == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest id; all texts without words count
    as copies only if they are equal, and repeated rows of one id and text as one."""
    return neardup.one_of_each(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; an empty text has one id, and no documents have no pieces."""
    return packing.digest(packing.pack(docs, added_tokens=True))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: A model, a sketch and a tokenizer stand between documents and rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
