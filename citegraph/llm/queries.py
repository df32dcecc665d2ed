"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citegraph.llm import (
    bitslice,
    decontaminate,
    importance,
    jaccard,
    langid,
    licenses,
    linededup,
    oracles,
    packing,
    rules,
    sharding,
    tiers,
    vectorcode,
    warc,
)
from citegraph.llm.shipping import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Tokenizer and ranks, read on the executors, where the package is installed as well."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_warc_bundles", oracles.WARC)
def op1(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op2_qgram_decontamination")
def op2(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_ngram_jaccard_join", oracles.JACCARD)
def op3(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query("op4_risk_controlled_rules", oracles.RULES)
def op4(spark, sf_dir):
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_bigru_language_id")
def op5(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), *tokenizer())


@query("op7_license_scan")
def op7(spark, sf_dir):
    return licenses.license_spans(table(spark, sf_dir, "documents"))


@query("op8_minimax_shards")
def op8(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query("op9_line_dedup", oracles.LINES)
def op9(spark, sf_dir):
    return linededup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_deleted", "text")


@query("op10_importance_resampling")
def op10(spark, sf_dir):
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_vector_codes", oracles.VECTOR_CODES)
def op11(spark, sf_dir):
    return vectorcode.compressed(table(spark, sf_dir, "embeddings"))


@query("op12_bit_sliced_resampling", oracles.BIT_SLICES)
def op12(spark, sf_dir):
    return bitslice.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_tiered_packing")
def op13(spark, sf_dir):
    return tiers.tiered(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
