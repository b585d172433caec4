"""Token files: ids of documents in Parquet list columns, for reads of chosen documents or of the metadata alone."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceworks.llm.memo import Memo, broadcast_bytes, small_batches, small_exchanges
from sourceworks.llm.text import whole
from sourceworks.session import ship_package

END_ID = 1
#: The writer's settings: small row groups and pages, so that page indexes (which the writer always adds)
#: lead a read to the pages of the wanted documents; a dictionary for ids, delta encoding for the sorted numbers.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
FILE_SCHEMA = "doc_id bigint, part int, before bigint, n_tokens bigint, ids array<int>"


#: The steps before the merges of the one kind of tokenizer for which texts are cut into chunks.
CUT_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
CUT_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ALNUM, _SIGNS, _APOSTROPHE, _SPACE = 1, 2, 3, 4
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = _ALNUM
_KINDS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _SIGNS
_KINDS[ord("'")] = _APOSTROPHE
_KINDS[list(b" \t\n\x0b\x0c\r")] = _SPACE
#: Small letters that composing and lower-casing leave alone and that never part: a to z, and those of the Latin-1 alphabet.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: The character by which byte-level tokenizers write a byte: itself where it is printable, else the next one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


class ChunkNumbers:
    """Numbers of chunks of at most 16 bytes, looked up for many at a time; a chunk is its bytes as two numbers of 64 bits.

    An open table of at least twice as many places as chunks; a chunk lies at the place of its hash or the next free one.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray, limit: int):
        self._size(max(limit, len(first)))
        self.add(first, second, numbers)

    def _size(self, chunks: int) -> None:
        self._bits, self._held = (2 * chunks).bit_length(), 0
        self._first, self._second = (np.zeros(1 << self._bits, dtype=np.uint64) for _ in range(2))
        self._number = np.full(1 << self._bits, -1, dtype=np.int32)

    def _place(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ (first >> np.uint64(31))) * _A + (second ^ (second >> np.uint64(29))) * _B
        return ((mixed ^ (mixed >> np.uint64(32))) * _A >> np.uint64(64 - self._bits)).astype(np.int64)

    def add(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        """Add chunks that are not in the table and differ from each other."""
        if 2 * (self._held + len(first)) > len(self._number):
            held = self._number >= 0
            old = self._first[held], self._second[held], self._number[held]
            self._size(2 * (self._held + len(first)))
            self.add(*old)
        self._held += len(first)
        place, left = self._place(first, second), np.arange(len(first))
        while len(left):
            at, one = np.unique(place[left], return_index=True)
            free = self._number[at] < 0
            at, one = at[free], left[one[free]]
            self._first[at], self._second[at], self._number[at] = first[one], second[one], numbers[one]
            placed = np.zeros(len(first), dtype=bool)
            placed[one] = True
            left = left[~placed[left]]
            place[left] = (place[left] + 1) & ((1 << self._bits) - 1)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The numbers of chunks, -1 for those that are not known."""
        place = self._place(first, second)
        found = self._number[place].astype(np.int64)
        left = np.flatnonzero((found >= 0) & ((self._first[place] != first) | (self._second[place] != second)))
        while len(left):
            place[left] = at = (place[left] + 1) & ((1 << self._bits) - 1)
            found[left] = self._number[at]
            left = left[(found[left] >= 0) & ((self._first[at] != first[left]) | (self._second[at] != second[left]))]
        return found


class ChunkEncoder:
    """Ids of texts, put together from the ids of their chunks.

    Chunks end at ASCII white space, and between a letter or digit and a sign, both ASCII (before the sign also after a small
    Latin-1 letter; not between an apostrophe and a letter). That holds for
    tokenizers that compose and lower-case a text and then split it as ``CUT_NORMALIZER`` and ``CUT_SPLIT`` say, since
    nothing composes with an ASCII character behind it, no part has white space, and none
    has a letter or digit together with a sign but the contractions, which start with an apostrophe. Letters of ASCII and
    Latin-1 are lower-cased beforehand where an ASCII character follows, with which
    they can't compose. Texts with ``<|`` may hold special tokens, and are cut at white space only;
    any other tokenizer gets whole texts.

    A chunk has a number; ids of a batch are taken from one array by the numbers of its
    chunks. Chunks not seen before go to the library: words of small Latin letters, which normalization and splitting leave as
    they are, to its merges, others together with a sign between them that has one id of its own.
    When ``limit`` chunks are known, those met once only are forgotten.
    """

    SIGN, TOGETHER = "\x01", 100
    BETWEEN = b" \xff "  # no byte of a text

    def __init__(self, vocabulary: bytes, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        text = vocabulary.decode("utf-8")
        plan = json.loads(text)
        self._tokenizer = Tokenizer.from_str(text)
        self._limit = limit
        steps = (plan.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        tokens = [t["content"] for t in plan.get("added_tokens", ())]
        special = all(t.startswith("<|") and not re.search(r"\s", t) for t in tokens)
        sign = self._ids(f" {self.SIGN} ")
        self._sign = sign[0] if len(sign) == 1 else None
        known = plan.get("normalizer") == CUT_NORMALIZER and [steps[0], *[t.get("type") for t in steps[1:]]] == [CUT_SPLIT, "ByteLevel"]
        self.cuts = bool(known and special and self._sign is not None)
        self._merged = self._tokenizer.model.tokenize
        self._clear()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")

    def _clear(self) -> None:
        """Nothing is known but the sign between texts, number 0, which has no ids."""
        none = np.zeros(1, dtype=np.uint64)
        self._keys = [np.full(1, self.BETWEEN.strip()[0], dtype=np.uint64), none]
        self._table = ChunkNumbers(*self._keys, np.zeros(1, dtype=np.int64), self._limit)
        self._odd: dict[bytes, int] = {}
        self._pool = np.empty(0, dtype="<i4")
        self._length = np.zeros(1, dtype=np.int64)
        self._start, self._met = self._length.copy(), self._length.copy()

    def _forget(self) -> None:
        """Keep the chunks met more than once."""
        kept = self._met > 1
        kept[0] = True
        if 2 * int(kept.sum()) > self._limit:
            return self._clear()
        numbers = np.flatnonzero(kept)
        new = np.cumsum(kept) - 1
        self._pool, self._length = self._taken(numbers)
        self._start = np.cumsum(self._length) - self._length
        self._met = np.zeros(len(numbers), dtype=np.int64)
        odd = np.zeros(len(kept), dtype=bool)
        odd[list(self._odd.values())] = True
        self._keys = [k[numbers] for k in self._keys]
        short = ~odd[numbers]
        self._table = ChunkNumbers(*[k[short] for k in self._keys], np.flatnonzero(short), self._limit)
        self._odd = {c: int(new[n]) for c, n in self._odd.items() if kept[n]}

    def _taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks with these numbers one after another, and how many each has."""
        lengths = self._length[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(self._start[numbers] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self._pool[places], lengths

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, lengths = [np.empty(0, dtype="<i4")], [np.empty(0, dtype=np.int64)]
        between = f" {self.SIGN} "
        for start in range(0, len(chunks), self.TOGETHER):
            some = chunks[start : start + self.TOGETHER]
            ids = self._ids(between.join(some) + between)
            ends = np.flatnonzero(ids == self._sign)
            if len(ends) != len(some):
                raise ValueError("the sign between chunks is among their ids")
            found.append(ids[ids != self._sign])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(found), np.concatenate(lengths)

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of chunks that have the next numbers in turn."""
        kinds = np.array([0 if _SMALL(c) else 2 if b"\x01" in c or b"<|" in c else 1 for c in chunks], dtype=np.int64)
        by_kind = [[chunks[i].decode("utf-8") for i in np.flatnonzero(kinds == kind).tolist()] for kind in range(3)]
        words = [self._merged(t if t.isascii() else t.encode("utf-8").decode("latin-1").translate(_BYTE_LEVEL)) for t in by_kind[0]]
        alone = [self._ids(t) for t in by_kind[2]]
        ids = [
            np.array([token.id for word in words for token in word], dtype="<i4"),
            (joint := self._together(by_kind[1]))[0],
            np.concatenate([np.empty(0, dtype="<i4"), *alone]),
        ]
        counts = [np.array(list(map(len, words)), dtype=np.int64), joint[1], np.array(list(map(len, alone)), dtype=np.int64)]
        lengths, starts = np.empty(len(chunks), dtype=np.int64), np.empty(len(chunks), dtype=np.int64)
        base = len(self._pool)
        for kind in range(3):
            lengths[kinds == kind] = counts[kind]
            starts[kinds == kind] = base + np.cumsum(counts[kind]) - counts[kind]
            base += len(ids[kind])
        self._pool = np.concatenate([self._pool, *ids])
        self._length, self._start = np.concatenate([self._length, lengths]), np.concatenate([self._start, starts])
        self._met = np.concatenate([self._met, np.zeros(len(chunks), dtype=np.int64)])

    @staticmethod
    def _prepared(data: bytes) -> np.ndarray:
        """Bytes in small letters, where the next byte is an ASCII character, with a space where a chunk ends without one."""
        raw, low = np.frombuffer(data, dtype=np.uint8), np.frombuffer(data.lower(), dtype=np.uint8)
        kinds = _KINDS[low]
        before, after = kinds[:-1], kinds[1:]
        ends = (before == _ALNUM) & ((after == _SIGNS) | (after == _APOSTROPHE)) | (before == _SIGNS) & (after == _ALNUM)
        if not data.isascii():
            low = low.copy()
            upper = np.flatnonzero(raw[1:] >= 0x80)
            upper = upper[(raw[upper] >= 65) & (raw[upper] <= 90)]
            low[upper] = raw[upper]
            second = np.flatnonzero(raw[:-2] == 0xC3) + 1  # of a Latin-1 letter; a space ends the data
            second = second[raw[second + 1] < 0x80]
            upper = second[(raw[second] <= 0x9E) & (raw[second] != 0x97)]
            low[upper] += 0x20
            second = second[(low[second] >= 0x9F) & (low[second] != 0xB7)]
            ends[second[(kinds[second + 1] == _SIGNS) | (kinds[second + 1] == _APOSTROPHE)]] = True
        return np.insert(low, np.flatnonzero(ends) + 1, 32)

    def _numbered(self, raw: np.ndarray) -> np.ndarray:
        """The number of every chunk in order; chunks not known become so."""
        data = raw.tobytes()
        space = np.concatenate([[True], _KINDS[raw] == _SPACE, [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, stops = edges[::2], edges[1::2]
        size = stops - starts
        padded = np.concatenate([raw, np.zeros(24, dtype=np.uint8)])
        words = np.empty(len(raw) + 9, dtype=np.uint64)
        for shift in range(8):
            part = words[shift::8]
            part[:] = np.frombuffer(padded, dtype="<u8", offset=shift, count=len(part))
        first = words[starts] & _MASKS[np.minimum(size, 8)]
        second = words[np.minimum(starts + 8, len(words) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
        odd = size > 16
        zero = np.flatnonzero(raw == 0)
        if len(zero):
            odd[np.searchsorted(starts, zero, side="right") - 1] = True
        numbers = self._table.find(first, second)
        new: list[bytes] = []
        known = len(self._length)
        for i in np.flatnonzero(odd).tolist():
            chunk = data[starts[i] : stops[i]]
            number = self._odd.get(chunk)
            if number is None:
                number = self._odd[chunk] = known + len(new)
                new.append(chunk)
            numbers[i] = number
        odd_new = len(new)
        fresh = np.flatnonzero((numbers < 0) & ~odd)
        if len(fresh):
            order = fresh[np.lexsort((second[fresh], first[fresh]))]
            differs = np.concatenate([[True], (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])])
            numbers[order] = known + odd_new + np.cumsum(differs) - 1
            one = order[differs]
            new += [data[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)]
            self._table.add(first[one], second[one], numbers[one])
            own = [first[one], second[one]]
        else:
            own = [np.empty(0, dtype=np.uint64)] * 2
        if new:
            self._keys = [np.concatenate([k, np.zeros(odd_new, dtype=np.uint64), o]) for k, o in zip(self._keys, own, strict=True)]
            self._learn(new)
        return numbers

    def _encode_cut(self, texts: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(self._length) > self._limit:
            self._forget()
        data = self.BETWEEN.join(texts) + b" "
        numbers = self._numbered(self._prepared(data) if plain else np.frombuffer(data, dtype=np.uint8))
        self._met += np.bincount(numbers, minlength=len(self._met))
        ids, lengths = self._taken(numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = ends[np.concatenate([[0], np.flatnonzero(numbers == 0) + 1, [len(numbers)]])]
        return ids, np.diff(edges)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if not self.cuts:
            encoded = self._tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
            parts = [np.array(e.ids, dtype="<i4") for e in encoded]
            return np.concatenate([np.empty(0, "<i4"), *parts]), np.array([len(p) for p in parts], dtype=np.int64)
        odd = np.array([b"<|" in t for t in texts], dtype=bool)
        if not odd.any():
            return self._encode_cut(texts, True)
        kinds = [self._encode_cut([t for t, o in zip(texts, odd, strict=True) if o == kind], not kind) for kind in (False, True) if (odd == kind).any()]
        counts = np.empty(len(texts), dtype=np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        lengths = np.concatenate([n for _, n in kinds])
        counts[order] = lengths
        starts = np.empty(len(texts), dtype=np.int64)
        starts[order] = np.cumsum(lengths) - lengths
        ends = np.cumsum(counts)
        places = np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]))
        return np.concatenate([ids for ids, _ in kinds])[places], counts


_encoders = Memo(lambda content: ChunkEncoder(content), 4)


def _encoded(vocabulary, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders[vocabulary.value]
        part, before = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, 1_000_000):
            ids, counts = encoder.encode(batch.column("text").cast(pa.binary()).to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.full(len(counts), part, dtype=np.int32)),
                    pa.array(before + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                ],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode every document and write the ids to ``path`` in ascending order of doc_id.

    Each file holds a range of ids in order; the files' names follow the ranges.
    ``part`` is the file's number and ``before`` the number of ids earlier in it,
    so ids of a document can be addressed without reading any other. Null and
    empty texts have the end id alone. Null doc_ids come first; documents with
    equal ids follow each other by a hash of the text. An empty table gives a
    folder without rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(_encoded(broadcast_bytes(spark, vocabulary), end_id), FILE_SCHEMA)
    with small_exchanges(spark):
        encoded.write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens; no ids are read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "part", "before", "n_tokens")
    return _with_start(rows, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids; filters on doc_id reach the page index."""
    return _with_start(spark.read.schema(FILE_SCHEMA).parquet(path), path).select("doc_id", "start", "n_tokens", "ids")


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``start`` from the sums of the files, a table of one row per file."""
    files = rows.sparkSession.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_start") + F.col("before"))


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4")).cast("B")
        ends = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def token_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    ship_package(tokens.sparkSession)
    rows = tokens.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
