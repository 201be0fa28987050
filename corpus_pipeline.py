"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.llm import language_id, minhash, packing, pii, toxicity
from fringeworks.llm.common import drop_scratch, materialize


def _wrapped(docs: DataFrame) -> DataFrame:
    """(doc, text): the whole row as one struct, so that no column of documents, however
    named, meets a column that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null and empty ones too, and texts between two languages
    go.  Without any row with text and language all stay."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    if not model.langs:  # no labelled row, so no language to tell
        return docs
    found = language_id.identify(_wrapped(docs), model, keep=("doc",))
    return found.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("doc.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts more likely toxic than not go; without labels of both kinds all stay, and
    so do null and empty texts."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.grade(_wrapped(docs), model, keep=("doc",)).filter(~F.col("toxic")).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or
    more) one document stays, that with the smallest id.

    Rows are told apart by id and text: of an id that repeats with several texts each
    text is judged by itself, and of rows that repeat both one stays.  Null and empty
    texts and rows without an id stay; an empty table gives an empty result.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("doc"), F.col("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("row_key"))
    found = minhash.near_duplicates(keyed, key_col="row_key").filter("doc_id is not null")
    # One row for each id and text; those of repeated rows come back once, below.
    rows = materialize(found.groupBy("doc_id", "row_key").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "dedup-rows")
    drop_scratch(found)
    out = keyed.join(rows.select("doc_id", "row_key").hint("shuffle_hash"), ["doc_id", "row_key"], "left_anti")
    again = rows.filter("kept").select("doc_id", "row_key")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return out.select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get keyed surrogates; n_chars follows the new text.  Null and empty texts
    stay as they are."""
    count = "n_entities"
    while count.lower() in {c.lower() for c in docs.columns}:
        count += "_"
    new = pii.pseudonymize(docs, count_col=count)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens along the curve; a null or empty text is its
    end id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: The model stages and the tokenizer are beyond SQL; tests/llm compare each
#: stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, made = docs, stage(spark, docs, sf_dir)
        docs = materialize(made, f"stage-{name}")
        # What the stage read is written anew; files outside the scratch folder stay.
        drop_scratch(made, before)
    return STAGES[-1][1](spark, docs, sf_dir)
