"""The operators' registered queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import fingerprint, langid, licenses, mixing, neardup, packing, quality, runindex, search, shards, toxicity, veccodes
from folium.llm.common import checkpoint_dir, table
from folium.llm.oracles import FINGERPRINT_SQL, MIX_SQL, REPEATS_SQL, clusters_sql, codes_sql


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sequence as written: shard, slot, doc_id, start, length, ids_crc32."""
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    return shards.write_shards(table(spark, sf_dir, "documents"), path).drop("ids")


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pack_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of documents whose id is divisible by 50, against all documents."""
    documents = table(spark, sf_dir, "documents")
    return search.search(documents, documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_language_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict_languages(documents, langid.train(documents))


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_screened_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.vector_clusters(table(spark, sf_dir, "embeddings"))


def op13_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_gam, op2_training_order, op3_weighted_minhash, op4_source_mix, op5_pack_ffd, op6_toxicity_mil, op7_merkle_fingerprint, op8_bm25_topk, op9_license_templates, op10_language_kn,
            op11_yinyang_codes, op12_screened_clusters, op13_run_length_repeats,
        )
    }


def oracle_sql() -> dict[str, str]:
    """The others are fitted models, hashes or packings that SQL has no words for; tests/llm compare them with brute force."""
    return {"op4_source_mix": MIX_SQL, "op7_merkle_fingerprint": FINGERPRINT_SQL, "op9_license_templates": licenses.oracle_sql(), "op11_yinyang_codes": codes_sql(), "op12_screened_clusters": clusters_sql(), "op13_run_length_repeats": REPEATS_SQL}
