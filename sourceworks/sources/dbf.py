"""DBF tables as all-text tables, read in parallel byte ranges."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.names import table_header
from sourceworks.functions.values import SOURCE_TYPE
from sourceworks.session import ship_package
from sourceworks.sources.files import open_file

RANGE_BYTES = 8 * 1024 * 1024
# Names of the field types.
FIELD_TYPES = {
    "C": "CHARACTER", "N": "NUMERIC", "F": "FLOATING_POINT", "D": "DATE", "L": "LOGICAL", "I": "LONG", "+": "AUTOINCREMENT",
    "O": "DOUBLE", "B": "DOUBLE", "Y": "CURRENCY", "T": "TIMESTAMP", "@": "TIMESTAMP", "M": "MEMO", "G": "GENERAL_OLE", "P": "PICTURE",
}
#: Fields whose bytes are numbers, not text.
BINARY_FIELDS = "I+OBYT@"
#: Fields that name a text in the memo file beside the table.
MEMO_FIELDS = "M"
#: Fields that name an object in the memo file; their columns are blank and marked as unsupported.
OBJECT_FIELDS = "GP"
UNSUPPORTED = "unsupported"
# Versions of tables whose memo file is of the first, second and third kind. Tables of other versions have none.
DBASE3_VERSIONS = (0x83,)
DBASE4_VERSIONS = (0x8B, 0xCB, 0x7B)
FOXPRO_VERSIONS = (0x30, 0x31, 0x32, 0xF5, 0xFB)
_JULIAN_1970 = 2_440_588


@dataclass(frozen=True)
class DbfLayout:
    """Where records and fields are."""

    version: int
    records: int
    start: int
    record_bytes: int
    fields: tuple[tuple[str, str, int, int], ...]  # name, type letter, offset, width


def dbf_layout(path: str) -> DbfLayout:
    """Header of a file; only the header bytes are read."""
    with open_file(path) as stream:
        version, records, start, width = struct.unpack("<B3xIHH", stream.read(12))
        stream.seek(32)
        descriptors = stream.read(start - 32)
    fields, offset = [], 1
    for at in range(0, len(descriptors) - 31, 32):
        entry = descriptors[at : at + 32]
        if entry[0] == 0x0D:
            break
        name = entry[:11].split(b"\0")[0].decode("latin-1")
        letter, size = chr(entry[11]), entry[16]
        if letter not in FIELD_TYPES:
            raise ValueError(f"field {name} has the unsupported type {letter!r}")
        fields.append((name, letter, offset, size))
        offset += size
    return DbfLayout(version, records, start, width, tuple(fields))


def binary_text(letter: str, raw: np.ndarray) -> np.ndarray:
    """The values of a binary field (rows of bytes) as text; zero bytes of a date-time are blank."""
    if letter in "I+":
        return raw[:, :4].copy().view("<i4").ravel().astype(str)
    if letter in "OB":
        return np.array([repr(v) for v in raw[:, :8].copy().view("<f8").ravel().tolist()])
    if letter == "Y":
        cents = raw[:, :8].copy().view("<i8").ravel().tolist()
        return np.array([f"{'-' if c < 0 else ''}{abs(c) // 10_000}.{abs(c) % 10_000:04d}" for c in cents])
    days, millis = raw[:, :8].copy().view("<i4").T
    stamps = (days.astype("i8") - _JULIAN_1970).astype("M8[D]").astype("M8[ms]") + millis.astype("m8[ms]")
    text = np.datetime_as_string(stamps, unit="s")
    return np.where(days == 0, "", np.char.add(text, "Z"))


def _memo_file(path: str) -> str:
    """The memo file beside a table: its name with another ending."""
    stem = path.rsplit(".", 1)[0]
    for ending in ("dbt", "fpt", "DBT", "FPT"):
        try:
            with open_file(f"{stem}.{ending}"):
                return f"{stem}.{ending}"
        except FileNotFoundError:
            continue
    raise ValueError(f"{path} has memo fields, but there is no memo file beside it")


class MemoFile:
    """Texts of a memo file, each read from its block on.

    Kinds differ in the size of blocks and in how a text's length is told: by an end
    mark in blocks of 512 bytes, which follow each other; or by a length in front of the text, after a
    mark (second kind) or a type, of which 1 is text (third kind).
    """

    def __init__(self, stream, version: int):
        self.stream, self.foxpro, self.marked = stream, version in FOXPRO_VERSIONS, version in DBASE4_VERSIONS
        head = stream.read(24)
        self.block = struct.unpack(">H", head[6:8])[0] if self.foxpro else struct.unpack("<H", head[20:22])[0] if self.marked else 512
        self.block = self.block or 512

    def text(self, number: int) -> bytes:
        if number <= 0:
            return b""
        self.stream.seek(number * self.block)
        if self.foxpro:
            kind, length = struct.unpack(">II", self.stream.read(8))
            return self.stream.read(length) if kind == 1 else b""
        if self.marked:
            mark, length = struct.unpack("<4sI", self.stream.read(8))
            if mark == b"\xff\xff\x08\x00":
                return self.stream.read(length - 8)
            self.stream.seek(number * self.block)
        parts = []
        while part := self.stream.read(self.block):
            end = part.find(b"\x1a")
            parts.append(part if end < 0 else part[:end])
            if end >= 0:
                break
        return b"".join(parts)


def memo_texts(path: str, version: int, raw: np.ndarray, encoding: str = "latin-1") -> list[str]:
    """The texts that a memo field (rows of bytes) names; blank where it names none, or the table's version has no memo file."""
    if version not in (*DBASE3_VERSIONS, *DBASE4_VERSIONS, *FOXPRO_VERSIONS):
        return [""] * len(raw)
    if raw.shape[1] == 4:
        numbers = raw.copy().view("<i4").ravel().tolist()
    else:
        digits = np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel().tolist()
        numbers = [int(d) if d.strip().isdigit() else 0 for d in digits]
    if not any(numbers):
        return [""] * len(numbers)
    with open_file(_memo_file(path)) as stream:
        memos = MemoFile(stream, version)
        return [memos.text(n).decode(encoding, "replace") for n in numbers]


def plain_text(letter: str, raw: str) -> str:
    """``field_text`` for one value, for decoders that hand out rows."""
    trimmed = raw.strip(" ")
    if letter in BINARY_FIELDS or letter in MEMO_FIELDS:
        return raw
    if letter == "C":
        return raw.rstrip(" ")
    if letter in "NF":
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", trimmed, re.ASCII):
            return ""
        plain = re.sub(r"^(-?)0+(?=\d)", r"\1", re.sub(r"^\+", "", trimmed), flags=re.ASCII)
        return re.sub(r"(?<!\d)(?=\.)", "0", plain, flags=re.ASCII)
    if letter == "D":
        try:
            return datetime.strptime(trimmed, "%Y%m%d").strftime("%Y-%m-%dT00:00:00Z") if re.fullmatch(r"\d{8}", trimmed, re.ASCII) else ""
        except ValueError:
            return ""
    return {"T": "TRUE", "Y": "TRUE", "F": "FALSE", "N": "FALSE"}.get(trimmed.upper(), "") if letter == "L" else ""


def field_text(letter: str, raw: Column) -> Column:
    """Fixed-width field as text; a date is its midnight in UTC, like a typed value (F2)."""
    trimmed = F.trim(raw)
    if letter in BINARY_FIELDS or letter in MEMO_FIELDS:
        text = raw
    elif letter in OBJECT_FIELDS:
        text = F.lit("")
    elif letter == "C":
        text = F.rtrim(raw)
    elif letter in "NF":
        plain = F.regexp_replace(trimmed, r"^\+", "")
        plain = F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")
        plain = F.regexp_replace(plain, r"(?<!\d)(?=\.)", "0")
        text = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain)
    elif letter == "D":
        day = F.try_to_date(trimmed, "yyyyMMdd")
        text = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    else:
        text = F.when(trimmed.isin("T", "t", "Y", "y"), "TRUE").when(trimmed.isin("F", "f", "N", "n"), "FALSE")
    return F.coalesce(text, F.lit(""))


def read_dbf(spark: SparkSession, path: str, encoding: str = "latin-1", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A DBF file as text columns that carry the declared field type.

    Records have a fixed width, so each task reads its own byte range of the
    file. Deleted records are left out. Texts of memo fields come from the memo file beside the table; columns
    of objects (types G and P) are blank, and their metadata say ``unsupported``.
    """
    ship_package(spark)
    layout = dbf_layout(path)
    width, start, total, version = layout.record_bytes, layout.start, layout.records, layout.version
    per_range = max(1, range_bytes // max(1, width))
    slices = [(letter, offset, size) for _, letter, offset, size in layout.fields]
    shape = pa.schema([(f"_f{i}", pa.string()) for i in range(len(slices))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(path) as stream:
            for batch in batches:
                for first in batch["id"].to_pylist():
                    stream.seek(start + first * width)
                    block = stream.read(min(per_range, total - first) * width)
                    whole = len(block) // width
                    records = np.frombuffer(block, np.uint8, whole * width).reshape(whole, width)
                    kept = records[records[:, 0] != ord("*")]
                    columns = [
                        binary_text(letter, kept[:, o : o + n])
                        if letter in BINARY_FIELDS
                        else memo_texts(path, version, kept[:, o : o + n], encoding)
                        if letter in MEMO_FIELDS
                        else np.char.decode(np.ascontiguousarray(kept[:, o : o + n]).view(f"S{n}").ravel(), encoding)
                        for letter, o, n in slices
                    ]
                    yield pa.record_batch([pa.array(c, pa.string()) for c in columns], schema=shape)

    ranges = -(-total // per_range)
    plan = spark.range(0, total, per_range, numPartitions=max(1, min(ranges, 10_000)))
    raw = plan.mapInArrow(decode, ", ".join(f"_f{i} string" for i in range(len(slices))))
    names = table_header([name for name, *_ in layout.fields])
    return raw.select(
        *[
            field_text(letter, F.col(f"_f{i}")).alias(name, metadata=_metadata(letter))
            for i, (name, (_, letter, _, _)) in enumerate(zip(names, layout.fields, strict=True))
        ]
    )


def _metadata(letter: str) -> dict:
    return {SOURCE_TYPE: FIELD_TYPES[letter]} | ({UNSUPPORTED: True} if letter in OBJECT_FIELDS else {})
