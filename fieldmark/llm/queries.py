"""The thin opN_<name> queries: each applies its operator to its whole table and shapes the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import cross_parsing, filter_audit, masked_scores, media_sequences, pattern_packing, pii_surrogates, rule_quality, seed_leaks, simhash_blocks, source_mixing, style_tree, token_alignment, virtual_slots
from fieldmark.llm.shared import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = rule_quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = rule_quality.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_blocks.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_blocks.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_scores.score_documents(table(spark, sf_dir, "documents"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = virtual_slots.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(table(spark, sf_dir, "documents"))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    told = documents.select("doc_id", cross_parsing.predict(documents, cross_parsing.fit(documents)).alias("p"))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def op8_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = media_sequences.document_media(table(spark, sf_dir, "documents"))
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "before", "caption", "after")


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_byte_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.take(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "dealt")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_seed_leaks": op2_seed_leaks,
        "op3_masked_scores": op3_masked_scores,
        "op4_rule_quality": op4_rule_quality,
        "op5_virtual_slots": op5_virtual_slots,
        "op6_pattern_packing": op6_pattern_packing,
        "op7_cross_parsing": op7_cross_parsing,
        "op8_media_sequences": op8_media_sequences,
        "op9_simhash_blocks": op9_simhash_blocks,
        "op10_style_tree": op10_style_tree,
        "op11_byte_alignment": op11_byte_alignment,
        "op12_source_mixing": op12_source_mixing,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op13_filter_audit": filter_audit.ORACLE}
