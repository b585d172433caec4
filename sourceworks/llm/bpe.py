"""Byte-level BPE: encoding by ranked merges, decoding by joining pieces."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceworks.llm.memo import Memo, broadcast_bytes, read_vocabulary, small_batches
from sourceworks.llm.text import whole
from sourceworks.session import ship_package


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Rank (and id) of every piece, from the lines of a rank file."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, content.splitlines()) if piece}


def fold_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the neighbours of least rank join first, the leftmost of equals, until none makes a piece.

    A heap holds the neighbours that make a piece, so a word of n bytes takes
    n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    end = list(range(1, size + 1))  # of the part that starts here; 0: no part starts here
    before = list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not middle or middle >= size or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[start], end[middle] = stop, 0
        if stop < size:
            before[stop] = start
            if (r := ranks.get(piece[start : end[stop]])) is not None:
                heapq.heappush(heap, (r, start, end[stop]))
        if (left := before[start]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Codec:
    """Encodes and decodes whole texts; ids of chunks seen before are remembered.

    A chunk starts at a space that follows no white space, where no match of the
    pattern begins earlier and goes on; so the matches inside chunks are those of
    the whole text. Texts with other spacing are matched whole, and each match is
    remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, {i: p for p, i in ranks.items()}
        self._matches = regex.compile(pattern).findall
        self._spaced = regex.compile(r"\s ").search
        self._words = Memo(self._encode_chunk)

    def _encode_chunk(self, chunk: str) -> bytes:
        ids = [i for word in self._matches(chunk) for i in fold_merges(word.encode("utf-8"), self.ranks)]
        return np.array(ids, dtype="<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<i4")
        if self._spaced(text):
            chunks = self._matches(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]
        return np.frombuffer(b"".join(map(self._words.__getitem__, chunks)), dtype="<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces, joined."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


_codecs = Memo(lambda key: Codec(parse_ranks(key[0]), key[1]), 4)


def _digests(ranks, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs[ranks.value, pattern]
        for batch in small_batches(batches):
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(ranks, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs[ranks.value, pattern]
        for batch in small_batches(batches):
            found = _lists([codec.encode(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_given"), found], names=["_given", "ids"])

    return run


def _texts(ranks, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs[ranks.value, pattern]
        for batch in small_batches(batches):
            decoded = [codec.decode(np.array(i, dtype="<i4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_given"), pa.array(decoded, pa.binary())], names=["_given", "bytes"])

    return run


def _round_trips(ranks, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs[ranks.value, pattern]
        for batch in small_batches(batches):
            found = [codec.encode(t) for t in batch.column("text").to_pylist()]
            decoded = pa.array([codec.decode(ids) for ids in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_given"), _lists(found), decoded], names=["_given", "ids", "bytes"])

    return run


def _schema(df: DataFrame, column: str) -> StructType:
    return StructType([df.schema["_given"], *StructType.fromDDL(column)])


def encode_texts(docs: DataFrame, ranks: str, pattern: str, out: str = "ids") -> DataFrame:
    """``docs`` with the ids of its ``text`` as a list column; null and empty texts have no ids.

    Each match of ``pattern`` is encoded separately by the ranks in the file
    ``ranks``; special tokens are not looked for. A column already named ``out``
    gives way. Rows are encoded where they are read: nothing is shuffled, and
    words that occur again in a task's process are looked up.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    packed = docs.select(F.struct(*kept).alias("_given"), whole("text").alias("text"))
    run = _ids(broadcast_bytes(docs.sparkSession, ranks), pattern)
    return packed.mapInArrow(run, _schema(packed, "ids array<int>")).select("_given.*", F.col("ids").alias(out))


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of an id column: the pieces of its ids, joined; null lists give no bytes, an id that no piece has is an error."""
    ship_package(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != out]
    none = F.array().cast("array<int>")
    packed = encoded.select(F.struct(*kept).alias("_given"), F.coalesce(ids, none).alias("ids"))
    run = _texts(broadcast_bytes(encoded.sparkSession, ranks), pattern)
    return packed.mapInArrow(run, _schema(packed, "bytes binary")).select("_given.*", F.col("bytes").alias(out))


def round_trips(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs`` without its text, with the ids of the text and the bytes decoded from them, in one pass.

    As ``encode_texts`` and then ``decode_ids``; columns named ids or bytes give way.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "ids", "bytes")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("_given"), whole("text").alias("text"))
    run = _round_trips(broadcast_bytes(docs.sparkSession, ranks), pattern)
    out = packed.mapInArrow(run, _schema(packed, "ids array<int>, bytes binary"))
    return out.select(*[F.col(f"_given.`{c}`").alias(c) for c in kept], "ids", "bytes")


def token_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids (decimal, joined by commas) and of the bytes decoded from them.

    Every row of ``docs`` gives a row; a null text counts as empty, which has no
    ids. Columns other than doc_id and text are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    run = _digests(broadcast_bytes(docs.sparkSession, ranks), pattern)
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


# The fold in Spark itself: no Python code, but slow (see README).

BUCKETS = 1 << 16


def rank_table(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as one literal: an array of buckets of (piece in hex, rank), by the crc32 of the hex digits."""
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        digits = piece.hex().upper()
        table[zlib.crc32(digits.encode()) % buckets].append({"p": digits, "r": rank})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<p: string, r: int>>>")


def folded_ids(word: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """Ids of a word: a fold over its bytes that joins the neighbours of least rank, the leftmost of equals, while any make a piece."""

    def rank(piece: Column) -> Column:
        bucket = F.get(table, (F.crc32(piece.cast("binary")) % buckets).cast("int"))
        return F.get(F.filter(bucket, lambda x: x["p"] == piece), 0)["r"]

    def join_best(parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(parts) - 2)
        found = F.transform(places, lambda i: F.struct(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(found, lambda x: x["r"].isNotNull()))

        def joined(at: Column) -> Column:
            middle = F.array(F.concat(F.get(parts, at), F.get(parts, at + 1)))
            return F.concat(F.slice(parts, F.lit(1), at), middle, F.slice(parts, at + 3, F.size(parts)))

        # let best = ... in
        return F.get(F.transform(F.array(best), lambda b: F.when(b.isNull(), parts).otherwise(joined(b["i"]))), 0)

    digits = F.hex(word.cast("binary"))
    count = (F.length(digits) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(digits, 2 * i + 1, F.lit(2)))
    parts = F.aggregate(
        F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>")),
        pairs,
        lambda held, _: F.when(F.size(held) > 1, join_best(held)).otherwise(held),
    )
    return F.transform(parts, rank)


def fold_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids of every document by Spark's higher-order functions alone.

    The distinct words of a document are folded, and its words take their ids from a map of these. ``pattern`` is matched
    by Java with Unicode classes. Same ids as ``encode_texts`` where both regex engines know the same characters.
    """
    table = rank_table(parse_ranks(read_vocabulary(ranks)))
    words = docs.select("doc_id", F.regexp_extract_all(whole("text"), F.lit("(?U)" + pattern), F.lit(0)).alias("_words"))
    known = words.withColumn("_distinct", F.array_distinct("_words")).withColumn(
        "_known", F.map_from_arrays("_distinct", F.transform("_distinct", lambda w: folded_ids(w, table)))
    )
    return known.select("doc_id", F.flatten(F.transform("_words", lambda w: F.element_at("_known", w))).alias("ids"))
