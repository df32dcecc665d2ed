"""A cleaning pipeline for training text: one operator of ``citegraph.llm`` per stage.

Every stage takes the documents that the one before it kept and returns their columns; the
last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import decontaminate, importance, jaccard, linededup, packing
from citegraph.llm.shipping import ship

WORD = r"[^\x20\x09-\x0D]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by importance resampling against the texts labelled good."""
    ship(spark)
    return importance.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do texts of which no word is left.

    ``n_chars`` follows the text where lines went, if the table has that column.
    """
    ship(spark)
    cut = linededup.without_repeats(docs)
    changed = F.col("n_deleted") > 0
    left = cut.where(~changed | F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, that with the smallest id.

    Texts without a word are in no group and stay.
    """
    ship(spark)
    found = jaccard.jaccard_components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    kept = found.where("n_shingles > 0").groupBy("group_key").agg(first.alias("first")).select(
        F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key"))
    # In a struct the columns of ``docs`` cannot clash with the keys of the join.
    keyed = docs.where(F.col("text").rlike(WORD)).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"), jaccard.text_key().alias("key")).alias("l")
    same = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.key") == F.col("r.key"))
    # Rows that repeat id and text are one document.
    chosen = keyed.join(kept.hint("merge").alias("r"), same, "left_semi").dropDuplicates(["id", "key"])
    wordless = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return chosen.select("row.*").unionAll(wordless)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text with their place in a sequence."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the tokenizer nor the resampling; tests compare the last three stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
