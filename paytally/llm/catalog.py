"""Queries over the operators, by their contracts; SQL counterparts where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paytally.llm import (
    collocations, context_tree, decontaminate, fill_middle, hash_tree, imatch, lyndon_repeats, packing,
    quality_rules, simhash_pivots, surrogates, transcripts, warc,
)
from paytally.llm.common import documents
from paytally.llm.sqltext import ORACLE

SURROGATE_KEY = "spark.paytally.surrogateKey"


def surrogate_key(spark: SparkSession) -> str:
    """The secret named by the configuration; without one, a random key that holds for the session."""
    key = spark.conf.get(SURROGATE_KEY, None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set(SURROGATE_KEY, key)
    return key


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(documents(spark, sf_dir), surrogate_key(spark))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(documents(spark, sf_dir))


def op4_lyndon_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_repeats.remove_repeats(documents(spark, sf_dir), length=400).drop("spans")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(documents(spark, sf_dir))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from raw transcripts of all conversations; conversations with crc32(conv_id) mod 4 = 2 are
    not learned from. One style in seven uses words the model does not know, one turn in eight has no label."""
    lines = transcripts.raw_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"),
                                  transcripts.STYLES + transcripts.UNSEEN, unlabelled=8)
    return transcripts.recover(lines)


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(documents(spark, sf_dir), shards=40)


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contaminated_words(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10))


def op10_bound_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), capacity=1024, end_id=2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir), threshold=30, order=4, top=2_000, cover=80)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(documents(spark, sf_dir), plain_from=90, spm_below=20))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_rule_ensemble, op2_surrogates, op3_context_tree, op4_lyndon_repeats, op5_imatch, op6_simhash_pivots,
        op7_transcripts, op8_hash_tree, op9_prefix_join, op10_bound_packing, op11_collocations, op12_warc,
        op13_fill_middle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
