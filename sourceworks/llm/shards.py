"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.llm.ranking import ranked
from sourceworks.llm.text import fraction, seeded, whole


def interleaved_shards(docs: DataFrame, shards: int = 24, seed: str = "shards") -> DataFrame:
    """Place every document in one of ``shards`` shards, each with the mixture of sources of the whole.

    Rows of a source are shuffled by a seeded digest of their id and ranked; a row
    of rank r among n has the fractional rank (r - u) / n, with an offset u in
    [0, 1) of its source, so that many small sources do not meet at one point.
    Sorted by fractional rank and cut into equal runs, every shard gets its share
    of every source, and counts of shards differ by one at most. ``slot`` is the
    place in the shard, from 0.

    Columns: doc_id, source, size (UTF-8 bytes of the text plus 8), text_crc32,
    shard, slot. A null text counts as empty, a null source is a source of its
    own, rows with equal ids are placed separately, and an empty table gives no
    rows. Columns of ``docs`` other than doc_id, text, source are not read.
    """
    content = F.encode(whole("text"), "UTF-8")
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(content) + 8).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        seeded(seed, F.col("doc_id")).alias("_order"),
    )
    inside = ranked(rows, ["source"], ["_order", "doc_id", "text_crc32", "size"], "_rank", "_rows")
    start = fraction(seeded(seed + "-offset", F.col("source")))
    spread = inside.withColumn("_place", (F.col("_rank") - start) / F.col("_rows")).drop("_rank", "_rows")
    mixed = ranked(
        spread, [], ["_place", "source", "_order", "doc_id", "text_crc32", "size"], "_position", "_all"
    )
    position, total = F.col("_position") - 1, F.col("_all")
    shard = F.expr(f"((_position - 1) * {shards}) div _all")
    first = F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    return (
        mixed.withColumn("_shard", shard)
        .withColumn("_slot", position - first)
        .select("doc_id", "source", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))
    )
