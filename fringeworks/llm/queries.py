"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language_id, licenses, media, minhash, packing, pii, sentencepieces, token_counts, toxicity
from .common import read


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(read(spark, sf_dir, "documents")))


def op5_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_curve_packing": op1_curve_packing,
    "op2_output_codes": op2_output_codes,
    "op3_one_bit_codes": op3_one_bit_codes,
    "op4_media_columns": op4_media_columns,
    "op5_keyed_surrogates": op5_keyed_surrogates,
    "op6_circulant_minhash": op6_circulant_minhash,
    "op7_ordinal_toxicity": op7_ordinal_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_license_sentences": op9_license_sentences,
    "op10_sentence_pieces": op10_sentence_pieces,
}

ORACLE_SQL: dict[str, str] = {"op9_license_sentences": licenses.oracle_sql()}
