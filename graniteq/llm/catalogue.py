"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graniteq.llm import embedding_dedup, fingerprint, html_extract, language_id, licenses, packing, piece_codec, secrets, simhash_dedup, url_filter
from graniteq.sources import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip_digests(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.invariants(op2_packing(spark, sf_dir))


def piece_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_sentencepiece(spark, sf_dir).select("doc_id", "decoded_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_simhash_dedup": op10_simhash_dedup,
    "packing_invariants": packing_invariants,
    "piece_decoding": piece_decoding,
    "edited_texts": edited_texts,
}

ORACLES = {
    "op1_secret_scan": secrets.digests_sql(),
    "op3_embedding_dedup": embedding_dedup.link_vectors_sql(),
    "op5_license_scan": licenses.digests_sql(),
    "op8_url_filter": url_filter.judge_urls_sql(),
    "op9_language_id": language_id.identify_sql(),
    "packing_invariants": packing.invariants_sql(),
    "piece_decoding": piece_codec.decoded_sql(),
    "edited_texts": fingerprint.edited_sql(),
}
