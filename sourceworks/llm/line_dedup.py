"""Lines that many documents share, found with two Bloom filters and confirmed on the lines themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceworks.llm.memo import small_batches
from sourceworks.llm.text import whole
from sourceworks.session import cut_lineage, ship_package

SLOTS = 22  # log2 of the places in one filter of a segment, a byte each
SEGMENT_LINES = 1 << 18  # lines expected in a segment: 16 places each
PLACES = 4  # places a hash takes in a filter
SUSPECT_BITS = (16, 28)  # log2 of the least and the greatest size of the broadcast filter, in bits
BLOCK_BITS = 16  # log2 of the bits of that filter made at a time


def line_key(line: bytes) -> bytes:
    """A line as it is compared: without white space at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long(key: bytes, least_chars: int) -> bool:
    if len(key) < least_chars or len(key) >= 4 * least_chars or key.isascii():
        return len(key) >= least_chars
    return len(key.decode("utf-8", "replace")) >= least_chars


def _keys(text: bytes, least_chars: int) -> dict[bytes, list[int]]:
    """Keys of a text that are long enough, with the numbers of their lines."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if _long(key, least_chars):
            found.setdefault(key, []).append(at)
    return found


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of each hash in a filter of 2**bits, by double hashing."""
    mask = np.uint64((1 << bits) - 1)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & mask).astype(np.int64) for k in range(PLACES)]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in small_batches(batches):
        yield batch, batch.column("text").cast(pa.binary()).to_pylist()


def _line_hashes(segments: int, least_chars: int):
    """Hashes of the distinct keys of each document, packed by segment of the hash."""

    def run(batches):
        for _, texts in _texts(batches):
            hashes = np.array(
                [h for t in texts for h in map(xxhash.xxh3_64_intdigest, _keys(t, least_chars))], dtype=np.uint64
            )
            segment = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            order = np.argsort(segment, kind="stable")
            numbers, first = np.unique(segment[order], return_index=True)
            parts = np.split(hashes[order], first[1:]) if len(numbers) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["segment", "hashes"],
            )

    return run


def _suspects(least_documents: int):
    """Hashes of a segment that were seen often enough, as far as its two filters can tell; never one too few."""

    def run(batches):
        current, once, twice = None, None, None
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != current:
                    current, once, twice = segment, np.zeros(1 << SLOTS, dtype=bool), np.zeros(1 << SLOTS, dtype=bool)
                hashes, here = np.unique(np.frombuffer(packed, dtype=np.uint64), return_counts=True)
                places = _places(hashes, SLOTS)
                before = sum(np.logical_and.reduce([seen[p] for p in places]).astype(np.int64) for seen in (once, twice))
                for place in places:
                    once[place] = True
                    twice[place[before + here >= 2]] = True
                found = hashes[before + here >= min(least_documents, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["hash"])

    return run


def _filter_blocks(bits: int):
    """Blocks of the filter of all suspects: a hash has all its places in the block its highest bits name."""

    def run(batches):
        current, block = None, None
        for batch in batches:
            numbers, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for number in np.unique(numbers):
                if number != current:
                    if current is not None:
                        yield _packed_block(current, block)
                    current, block = number, np.zeros(1 << BLOCK_BITS, dtype=bool)
                for place in _places(hashes[numbers == number], BLOCK_BITS):
                    block[place] = True
        if current is not None:
            yield _packed_block(current, block)

    return run


def _packed_block(number: int, block: np.ndarray) -> pa.RecordBatch:
    packed = np.packbits(block, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([int(number)]), pa.array([packed], pa.binary())], names=["block", "bits"])


def _suspect_filter(suspects: DataFrame) -> np.ndarray:
    """One filter of all suspects, of 12 bits each within the bounds of ``SUSPECT_BITS``, whatever their number."""
    least, most = SUSPECT_BITS
    bits = min(max(least, (12 * suspects.count()).bit_length()), most)
    numbered = suspects.select(
        F.shiftrightunsigned("hash", 64 - (bits - BLOCK_BITS)).alias("block") if bits > BLOCK_BITS else F.lit(0).cast("bigint").alias("block"),
        "hash",
    )
    sorted_ = numbered.repartition("block").sortWithinPartitions("block")
    blocks = sorted_.mapInArrow(_filter_blocks(bits), "block bigint, bits binary").collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for row in blocks:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _in_filter(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    blocks = len(filter_) >> (BLOCK_BITS - 3)
    shift = 64 - (blocks.bit_length() - 1)
    base = (hashes >> np.uint64(shift)).astype(np.int64) << BLOCK_BITS if blocks > 1 else np.zeros(len(hashes), dtype=np.int64)
    found = np.ones(len(hashes), dtype=bool)
    for place in _places(hashes, BLOCK_BITS):
        at = base + place
        found &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def _suspected_lines(filter_, least_chars: int):
    """A row for each document and suspected key, with the numbers of its lines."""

    def run(batches):
        for batch, texts in _texts(batches):
            rows, keys, lines, hashes = [], [], [], []
            for row, text in enumerate(texts):
                found = _keys(text, least_chars)
                rows += [row] * len(found)
                keys += found
                lines += found.values()
                hashes += map(xxhash.xxh3_64_intdigest, found)
            chosen = np.flatnonzero(_in_filter(np.array(hashes, dtype=np.uint64), filter_.value))
            at = pa.array(np.array(rows, dtype=np.int64)[chosen])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("_print").take(at),
                    pa.array([keys[k] for k in chosen], pa.binary()),
                    pa.array([lines[k] for k in chosen], pa.list_(pa.int32())),
                ],
                names=["doc_id", "_print", "key", "lines"],
            )

    return run


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
            n_lines.append(text.count("\n") + 1)
            dropped = set(gone or ())
            n_dropped.append(len(dropped))
            kept.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in dropped]) if dropped else text)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_given"),
                pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64()),
                pa.array(kept, pa.string()),
            ],
            names=["_given", "n_lines", "n_dropped", "kept_text"],
        )


def shared_lines(docs: DataFrame, least_documents: int = 3, least_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """(suspected lines, confirmed keys) of ``docs`` (doc_id, text, _print).

    The first has a row for each document and suspected key: doc_id, _print, key,
    lines. The second has key and last, the largest doc_id that holds it, for
    keys that at least ``least_documents`` documents hold.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = size // (least_chars + 1) // SEGMENT_LINES + 1  # a line has a key and a line end
    texts = docs.select("doc_id", "text", "_print")
    hashes = texts.select("text").mapInArrow(_line_hashes(segments, least_chars), "segment bigint, hashes binary")
    by_segment = hashes.repartition("segment").sortWithinPartitions("segment")
    suspects = cut_lineage(by_segment.mapInArrow(_suspects(least_documents), "hash bigint").distinct())
    filter_ = spark.sparkContext.broadcast(_suspect_filter(suspects))
    schema = "doc_id bigint, _print bigint, key binary, lines array<int>"
    lines = cut_lineage(texts.mapInArrow(_suspected_lines(filter_, least_chars), schema))
    held = lines.groupBy("key").agg(F.count(F.lit(1)).alias("_held"), F.max("doc_id").alias("last"))
    # Written, so that the join with it is either a broadcast of a known size or one whose hot keys are split.
    return lines, cut_lineage(held.where(F.col("_held") >= least_documents).select("key", "last"))


def drop_shared_lines(docs: DataFrame, least_documents: int = 3, least_chars: int = 20) -> DataFrame:
    """Texts without the lines that several documents share; the document with the largest id keeps its own.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least ``least_chars`` code points that at least ``least_documents``
    (2 or more) documents hold lose all their lines, except in the largest doc_id
    among them. Other lines stay, joined by line ends.

    Hashes of the keys go, eight bytes each and packed, to segments of the hash
    space, whose number follows the bytes of text. A segment has a filter of hashes
    seen once and one of those seen twice: a hash found in the second is a
    suspect (for two documents: in the first). A filter of all suspects, of at
    most 2**28 bits (32 MB) whatever the table's size, goes to all tasks; only
    lines it holds are shuffled with their keys, counted and compared whole. Where it
    is too small for the suspects of a table, more lines are shuffled; the result is the same.
    Counts are combined before the shuffle, so a line of any number of documents is no hot spot.

    Columns: the columns of ``docs`` in the struct ``_given``, n_lines (before dropping),
    n_dropped and kept_text. Null and empty texts are one empty line. Every row
    is a document: rows with equal ids count apart, and keep a line together if theirs is
    the largest id. Null ids are below all others; a line that only documents without
    id hold stays. An empty table gives no rows.
    """
    if least_documents < 2:
        raise ValueError("a shared line needs two documents or more")
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("_given"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        whole("text").alias("text"),
        F.xxhash64(whole("text")).alias("_print"),
    )
    lines, keys = shared_lines(rows, least_documents, least_chars)
    # Rows that repeat have the same lines. Dealt anew after the join, so that its hot keys can be split.
    once = lines.groupBy("doc_id", "_print", "key").agg(F.first("lines").alias("lines"))
    gone = (
        once.join(keys, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .repartition("doc_id", "_print")
        .groupBy("doc_id", "_print")
        .agg(F.flatten(F.collect_list("lines")).alias("_gone"))
        .select(F.col("doc_id").alias("_id"), F.col("_print").alias("_same"), "_gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_same"))
    joined = rows.join(gone, same, "left").select("_given", "text", "_gone")
    out = StructType([rows.schema["_given"], *StructType.fromDDL("n_lines bigint, n_dropped bigint, kept_text string")])
    return joined.mapInArrow(_without, out)


def line_digests(docs: DataFrame, least_documents: int = 3, least_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of the remaining lines."""
    found = drop_shared_lines(docs.select("doc_id", "text"), least_documents, least_chars)
    return found.select(
        F.col("_given.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
