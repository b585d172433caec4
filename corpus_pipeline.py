"""Documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and
returns them again (the last one: with ids and n_tokens besides). ``run``
writes what a stage returns as Parquet and reads it as the next one's input.

Null texts count as empty: the quality rules reject them. Null sources are a source
of their own. Columns of ``docs`` beyond those of ``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.llm import bpe, mixing, near, repeats, rules
from sourceworks.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages look at full shingle sets, suffixes and ranks, for which there is no usable SQL; tests compare with brute force.
ORACLE_SQL = None


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents``, n_chars anew."""
    named = df.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return named.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their source share."""
    return _documents(rules.quality_rules(docs.select(*COLUMNS)).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that of the smallest id."""
    found = near.near_copies(docs.select("doc_id", "text"), width=5, percent=80)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document of which nothing is left goes.

    A cut may fall inside a character; what is left of such a character goes too.
    """
    found = repeats.remove_repeats(docs.select(*COLUMNS), characters=True)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    text = F.when(F.col("n_removed") == 0, F.decode("kept", "UTF-8")).otherwise(F.expr("make_valid_utf8(cast(kept as string))"))
    return _documents(left.select("_given.*", text.alias("text")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that sources come near their targets.

    Rows that agree in id, source and number of words are taken alike.
    """
    key = ("doc_id", "source", "size")
    mixed = mixing.systematic_mix(docs).where("copies > 0").groupBy(*key).agg(F.max("copies").alias("copies"))
    chosen = mixed.select(*[F.col(c).alias(f"_{c}") for c in key], "copies")
    sized = docs.select(*COLUMNS, mixing.size_in_words().alias("size"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    joined = sized.join(chosen, same[0] & same[1] & same[2])
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts; the text is the one decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trips(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.decode("bytes", "UTF-8").alias("text"),
        "lang",
        "source",
        "n_chars",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
    )


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_stage),
    ("repeated passages", repeats_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
