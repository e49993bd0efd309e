"""A training-data pipeline of five of the operators: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet. All but the last return the columns of documents.
The language and packing stages are models and packings that SQL can't express,
so there is no SQL for the whole; tests/llm hold each stage against brute force.

Defined cases, in every stage: null and empty texts, repeated rows and ids, null
ids, extra columns and empty tables are those of the operator that it calls; an
empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folium.llm import langid, mixing, neardup, packing, quality
from folium.llm.common import checkpoint_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for quality; without usable labels all score 0.5 and stay."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language's model accepts; those without a letter go, and all where no row names a language."""
    return langid.keep_identified(docs, langid.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the least id and text; different texts of one id are as many documents."""
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; documents without words are not taken."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in the packed sequences; an empty text has one piece, its end."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        schema = docs.schema
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return docs
