"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from sourceworks.llm import (
    bpe,
    collocations,
    hosts,
    line_dedup,
    mixing,
    near,
    oracles,
    periodic_runs,
    repeats,
    rules,
    shards,
    sketches,
    token_files,
    transducer,
)
from sourceworks.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from sourceworks.session import scratch_path


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_checksums(token_files.read_tokens(spark, path))


@query("op2_interleaved_shards")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.interleaved_shards(table(spark, folder, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_similarity_sketches")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_copies(table(spark, folder, "documents"), width=4, percent=80)


@query("op4_transducer_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return transducer.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@query("op5_host_reputation", oracles.OP5)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    judged = hosts.filter_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_bottom_k")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = sketches.fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op7_previous_factors")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, folder, "documents"))


@query("op8_line_frequency", oracles.OP8)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, folder, "documents"), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_systematic_mix", oracles.OP9)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.systematic_mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_byte_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op11_collocations", oracles.OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), longest=4, least=30, covered_percent=80, top=2000)


@query("op12_line_dedup", oracles.OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"), least_documents=3, least_chars=20)


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    planted = table(spark, folder, "documents").select("doc_id", periodic_runs.planted_text().alias("text"))
    return periodic_runs.run_digests(planted, least=12)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
