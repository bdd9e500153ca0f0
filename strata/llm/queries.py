"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    curve_packing,
    decontam,
    dialogue,
    hash_tree,
    minhash,
    phrases,
    pii,
    poisson_mix,
    redirects,
    substring_dedup,
    toxicity,
    warc_index,
    winnowing,
)
from strata.llm.common import load

SHARDS = 24


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"))


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), k=4, percent=80)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(load(spark, sf_dir, "documents"), winnowing.of_characters)


def op4_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc_index.captures(load(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return hash_tree.place(documents, SHARDS, grown=True).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(load(spark, sf_dir, "documents"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(load(spark, sf_dir, "documents"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.judge(load(spark, sf_dir, "pages"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


def op12_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(load(spark, sf_dir, "documents"))


def op13_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_damaged(load(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_substring_dedup,
        op2_circulant_minhash,
        op3_winnowing,
        op4_warc_merge,
        op5_hash_tree,
        op6_poisson_mix,
        op7_weak_supervision,
        op8_spaced_seeds,
        op9_redirects,
        op10_subword_toxicity,
        op11_phrase_tries,
        op12_hilbert_packing,
        op13_checkpointed_repair,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op4_warc_merge": warc_index.ORACLE,
        "op9_redirects": redirects.ORACLE,
        "op11_phrase_tries": phrases.ORACLE,
    }
