"""Registered queries of the operators: thin digests of their outputs, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.llm import (conversation_repair, fingerprints, hard_negatives, hmm_scoring, html_extract, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash,
                         token_scan)
from tagflow.llm.oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("quality", 4).alias("quality"), "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(_documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = mixing.mix(_documents(spark, sf_dir))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.join(mixing.places(pieces), ["_none", "_src", "_doc"], "left").select(
        "doc_id", "size", "source_size", "target", none("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"), none("n_slots"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_documents(spark, sf_dir))
    name = F.array(*[F.lit(k) for k in [*pii.KINDS, "term"]])
    line = lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(pii.KINDS)).alias("kind"), t["end"].alias("end")))
    of = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
                        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(F.array_sort(F.concat(base, terms)), line), ",").alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_documents(spark, sf_dir))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20; ``kind`` 0 marks the rows that it drops."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                                (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind",
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turn = F.when(F.col("kind") != 0, F.col("turn"))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    found = conversation_repair.digests(conversation_repair.edit_rows(rows.where("kind <> 0")))
    found = found.select(F.when(~F.col("_none"), F.col("_conv")).alias("_id"), *found.columns[2:])
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return gaps.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", "gaps", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved), lambda i: i % 100 == 0)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.score(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_document_fingerprints, op2_quality_rules, op3_token_counts, op4_quality_classifier, op5_sharding, op6_mixing_sources, op7_pii,
    op8_best_fit_packing, op9_simhash_near_dedup, op10_html_extraction, op11_conversation_repair, op12_hard_negatives, op13_lm_scoring)}

__all__ = ["QUERIES", "ORACLES"]
