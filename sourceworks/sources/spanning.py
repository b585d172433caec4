"""Records of delimited files, each file cut into blocks that many tasks read.

One rule holds for every file, whatever its size and blocks. A record ends at a
line end (LF, CR LF or CR) outside quotes. A quote opens a field where a field
starts; the field goes on to the next quote that is not doubled, over line ends
too, which are kept as they are. What follows a closing quote belongs to the
field up to the delimiter or the line end. Lines of no characters are no
records; a byte order mark is no text; a field that is never closed is an error.

Whether a block starts inside a quoted field depends on all blocks before it. So
a first pass sees each block as a function of that one bit, windows over the
blocks of a file (one row each) combine them, and a second pass cuts each block
from its known start and reads over its end to finish the last record. No text is shuffled.

The first pass also says of each block whether Spark's own CSV reader finds the same records in it, so that
the second one is needed only for files in which it does not (see ``FileShapes``).
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceworks.session import cut_lineage, dealt, ship_package
from sourceworks.sources.files import open_file

BLOCK_BYTES = 64 * 1024 * 1024
_FIRST, _READ = 8 * 1024, 1024 * 1024  # lines and records mostly end soon: steps start small and double
_BOM = b"\xef\xbb\xbf"
_LINE_END = re.compile(rb"\r\n|\n|\r")


def _line_start(stream, size: int, at: int) -> int:
    """The first place from ``at`` on where a line starts: after LF, or after CR that no LF follows."""
    if at == 0:
        return 0
    stream.seek(at - 1)
    data, base, step = b"", at - 1, _FIRST
    while base + len(data) < size:
        data += stream.read(step)
        step = min(2 * step, _READ)
        found = _LINE_END.search(data)
        if found and (found.end() < len(data) or base + len(data) >= size):
            return base + found.end()
        if found is None:
            base, data = base + len(data), b""
    return size


def _read(stream, start: int, stop: int) -> bytes:
    stream.seek(start)
    return stream.read(stop - start)


class RecordRule:
    """The record rule for one delimiter, as searches over bytes that start where a line starts."""

    def __init__(self, delimiter: str, qualified: bool):
        self.delimiter, self.qualified = delimiter.encode(), qualified
        sep = re.escape(self.delimiter)
        self.rest = re.compile(rb'(?:[^"]|"")*+"')
        field = rb'(?:\A|(?<=[\r\n])|(?<=' + sep + rb'))"(?:[^"]|"")*+(?:"|(?P<open>\Z))|'
        self.token = re.compile((field if qualified else b"(?P<open>(?!))|") + rb"(?P<end>\r\n|\n|\r)")
        mark = re.escape(delimiter)
        tail = rf"(?:(?!{mark}).)*"
        quoted = rf'"((?:[^"]|"")*)"(?={mark}|\Z)|"(?:[^"]|"")*"{tail}|' if qualified else "((?!))|"
        self.field, self.text = re.compile(quoted + tail, re.DOTALL), delimiter

    def cells(self, record: str) -> list[str | None]:
        """The fields of a record: a bare empty one is null, ``""`` the empty text; what follows a closing quote makes a field bare."""
        if not self.qualified or '"' not in record:
            return [c or None for c in record.split(self.text)]
        found, at = [], 0
        while True:
            field = self.field.match(record, at)
            found.append(field[1].replace('""', '"') if field[1] is not None else field[0] or None)
            if field.end() >= len(record):
                return found
            at = field.end() + len(self.text)

    def records(self, data: bytes, inside: bool) -> tuple[list[tuple[int, int, int]], bool]:
        """(start, end of text, start of the next) of the records that start here, and whether the data end inside quotes.

        With ``inside`` the data start in a quoted field of an earlier record. The last
        record may lack its line end.
        """
        at, found = 0, []
        start = None if inside else 0
        if inside:
            closed = self.rest.match(data)
            if closed is None:
                return [], True
            at = closed.end()
        for token in self.token.finditer(data, at):
            if token["end"] is not None:
                if start is not None and token.start() > start:
                    found.append((start, token.start(), token.end()))
                start = token.end()
            elif token["open"] is not None:
                if start is not None:
                    found.append((start, len(data), len(data)))
                return found, True
        if start is not None and start < len(data):
            found.append((start, len(data), len(data)))
        return found, False


@lru_cache(maxsize=256)
def rule_of(delimiter: str, qualified: bool) -> RecordRule:
    return RecordRule(delimiter, qualified)


def blocks_of(files: DataFrame) -> DataFrame:
    """Files (path, length, encoding, ...) with ``start`` and ``stop`` of each of their blocks; empty files have none.

    Files in encodings whose ASCII characters take several bytes are one block.
    """
    size = int(files.sparkSession.conf.get("spark.sourceworks.flatBlockBytes", str(BLOCK_BYTES)))
    step = F.when(F.lower("encoding").rlike("^utf[-_]?(16|32)"), F.col("length")).otherwise(F.lit(size).cast("bigint"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step))
    listed = files.where("length > 0").select("*", starts.alias("start"))
    return listed.withColumn("stop", F.least(F.col("start") + step, "length"))


def files_at(spark: SparkSession, path: str, delimiter: str, qualified: bool, encoding: str) -> DataFrame:
    """The files of a path, as those of one table."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    return listed.select(
        F.lit(0).cast("bigint").alias("st_oid"),
        "path",
        "length",
        F.lit(delimiter).alias("delimiter"),
        F.lit(qualified).alias("qualified"),
        F.lit(encoding).alias("encoding"),
    )


def _block_data(stream, start: int, stop: int, encoding: str) -> tuple[int, bytes]:
    """Where the lines that start in a block begin, and their bytes (in UTF-8 where ASCII characters take several)."""
    if wide_characters(encoding):
        return 0, stream.read().decode(encoding).removeprefix("\ufeff").encode()
    size = stream.size()
    base = _line_start(stream, size, start)
    data = _read(stream, base, _line_start(stream, size, stop))
    skip = len(_BOM) if start == 0 and data.startswith(_BOM) else 0
    return base + skip, data[skip:]


@dataclass(frozen=True)
class BlockShape:
    """What one start of a block (outside or inside quotes) leads to.

    ``odd``: there are quotes that neither enclose a field nor are doubled in one. ``spans``: a
    line end stands inside quotes. ``first``: where the first record starts that does so in the block.
    """

    end: bool
    first: int | None
    odd: bool
    spans: bool


def _line_kinds(data: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """Places of line ends (of CR LF the second character), their kinds as bits (LF, CR LF, CR), and whether a line has nothing but blanks."""
    line_feed, returns = np.flatnonzero(data == 10), np.flatnonzero(data == 13)
    paired = np.zeros(len(returns), dtype=bool)
    inside = returns + 1 < len(data)
    paired[inside] = data[returns[inside] + 1] == 10
    alone, pairs = returns[~paired], int(paired.sum())
    ends = np.sort(np.concatenate([line_feed, alone])) if len(alone) else line_feed
    kinds = (len(line_feed) > pairs) | (pairs > 0) << 1 | (len(alone) > 0) << 2
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(data)]
    if not len(starts):
        return ends, kinds, False
    # a line's bytes and those among them that are no blanks: a line of line ends alone is no record
    some = np.logical_or.reduceat(data > 32, starts)
    bare = ~np.logical_or.reduceat((data != 10) & (data != 13), starts)
    return ends, kinds, bool((~some & ~bare).any())


def block_shapes(rule: RecordRule, data: bytes) -> tuple[tuple[BlockShape, BlockShape], int, bool]:
    """The shape of a block for both its starts, the kinds of its line ends, and whether it has a line of blanks.

    Where all quotes are as they should be, their number tells inside from outside; else the rule
    is followed token by token.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    ends, kinds, blanks = _line_kinds(raw)
    quotes = np.flatnonzero(raw == 34) if rule.qualified else np.empty(0, dtype=np.int64)
    edge = np.zeros(256, dtype=bool)
    edge[[10, 13, *rule.delimiter[:1]]] = True
    before, after = np.ones(len(quotes), dtype=bool), np.ones(len(quotes), dtype=bool)
    beside, beyond = quotes > 0, quotes + 1 < len(raw)
    before[beside] = edge[raw[quotes[beside] - 1]] | (raw[quotes[beside] - 1] == 34)
    after[beyond] = edge[raw[quotes[beyond] + 1]] | (raw[quotes[beyond] + 1] == 34)
    turns = np.searchsorted(quotes, ends) % 2 == 1
    nothing = (raw != 10) & (raw != 13) if len(raw) else np.empty(0, dtype=bool)

    def shape(inside: bool) -> BlockShape:
        opens = (np.arange(len(quotes)) % 2 == 0) ^ inside
        odd = len(rule.delimiter) != 1 or not np.where(opens, before, after).all()
        if odd and rule.qualified:
            found, end = rule.records(data, inside)
            return BlockShape(end, found[0][0] if found else None, True, True)
        within = turns ^ inside
        starts = np.concatenate([[] if inside else [0], ends[~within] + 1]).astype(np.int64)
        starts = starts[starts < len(raw)]
        starts = starts[nothing[starts]]
        end = bool((len(quotes) % 2 == 1) ^ inside)
        return BlockShape(end, int(starts[0]) if len(starts) else None, False, bool(within.any()))

    return (shape(False), shape(True)), int(kinds), blanks


BLOCK_SIZE = "stop - start"
FILE_KEYS = "st_oid long, delimiter string, qualified boolean, encoding string"
ENDS = (
    "path string, start long, stop long, length long, out_end boolean, in_end boolean, first_0 long, first_1 long, "
    "odd_0 boolean, odd_1 boolean, spans_0 boolean, spans_1 boolean, kinds int, blanks boolean"
)


def block_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First pass: the shape of every block for both its starts."""
    names = [part.split()[0] for part in f"{FILE_KEYS}, {ENDS}".split(", ")]
    for batch in batches:
        rows = []
        for block in batch.itertuples(index=False):
            with open_file(block.path) as stream:
                base, data = _block_data(stream, block.start, block.stop, block.encoding)
            (out, within), kinds, blanks = block_shapes(rule_of(block.delimiter, bool(block.qualified)), data)
            first = [None if s.first is None else base + s.first for s in (out, within)]
            keys = (block.st_oid, block.delimiter, block.qualified, block.encoding, block.path, block.start, block.stop, block.length)
            rows.append((*keys, out.end, within.end, *first, out.odd, within.odd, out.spans, within.spans, kinds, blanks))
        yield pd.DataFrame(rows, columns=names).astype({"first_0": "Int64", "first_1": "Int64"})


def record_texts(block: dict) -> Iterator[tuple[int, str]]:
    """Second pass: place and text of the records that start in a block (st_oid, path, start, stop, rule, encoding, inside)."""
    rule, encoding = rule_of(block["delimiter"], bool(block["qualified"])), block["encoding"]
    with open_file(block["path"]) as stream:
        base, data = _block_data(stream, block["start"], block["stop"], encoding)
        found, open_end = rule.records(data, bool(block["inside"]))
        last = None
        if wide_characters(encoding):
            encoding = "utf-8"
            if open_end:
                raise ValueError(f"a quoted field of {block['path']} is never closed")
        elif open_end and found:  # the last one goes on behind the block
            size, at = stream.size(), base + found.pop()[0]
            last = at, _finished(stream, rule, at, _line_start(stream, size, block["stop"]), size)
    for start, end, _ in found:
        yield base + start, data[start:end].decode(encoding, "replace")
    if last:
        yield last[0], last[1].decode(encoding, "replace")


def record_cells(block: dict) -> Iterator[tuple[int, list[str | None]]]:
    """Place and fields of the records that start in a block."""
    rule = rule_of(block["delimiter"], bool(block["qualified"]))
    for at, text in record_texts(block):
        yield at, rule.cells(text)


def _finished(stream, rule: RecordRule, start: int, stop: int, size: int) -> bytes:
    """The text of the record at ``start``, read on from ``stop`` by ever larger steps."""
    step = _FIRST
    while stop < size:
        stop = _line_start(stream, size, min(stop + step, size))
        data = _read(stream, start, stop)
        found, open_end = rule.records(data, False)
        if len(found) > 1 or not open_end:
            return data[found[0][0] : found[0][1]]
        step *= 2
    raise ValueError(f"a quoted field is never closed, from byte {start}")


def _started(blocks: DataFrame, file: list[str]) -> DataFrame:
    """Adds ``inside``: whether a block starts inside a quoted field, from the blocks before it.

    A block either sets the state (both its ends agree), keeps it or turns it over. The state
    before a block is the last set one, turned over as often as blocks since then do so.
    """
    upto = Window.partitionBy(*file).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*file).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("out_end") & ~F.col("in_end")).cast("int")
    setting = F.when(F.col("out_end") == F.col("in_end"), F.struct(F.col("out_end").cast("int").alias("to"), F.col("_turns").alias("at")))
    counted = blocks.withColumn("_turns", F.sum(turns).over(upto))
    known = counted.withColumn("_set", setting).withColumn("_set", F.last("_set", ignorenulls=True).over(earlier))
    since = F.col("_turns") - turns - F.coalesce("_set.at", F.lit(0))
    return known.withColumn("inside", (F.coalesce("_set.to", F.lit(0)) + since) % 2 == 1).drop("_turns", "_set")


def started_blocks(ends: DataFrame, file: list[str]) -> DataFrame:
    """Blocks with ``inside``, ``header_at`` (where the file's first record starts, else -1) and ``heads``: whether its file is the table's first."""
    first = F.when(F.col("inside"), F.col("first_1")).otherwise(F.col("first_0"))
    headed = _started(cut_lineage(ends), file).withColumn("header_at", F.min(first).over(Window.partitionBy(*file)))
    least = F.min(F.when(F.col("header_at").isNotNull(), F.col("path"))).over(Window.partitionBy("st_oid"))
    return headed.withColumn("heads", F.col("path") == least).fillna(-1, ["header_at"])


@dataclass(frozen=True)
class FileShapes:
    """The blocks of some files, and by which of Spark's readers they can be read under the record rule.

    ``by_line``: every line is a record. ``whole``: records go over lines, but each
    file is one block and has one kind of line end. Neither holds where a quote is out of place, a
    quoted field is not closed, or a line has nothing but blanks.
    """

    blocks: DataFrame
    by_line: bool
    whole: bool


def file_shapes(files: DataFrame) -> FileShapes:
    """First pass over the files of a table (see ``files_at``)."""
    ship_package(files.sparkSession)
    ends = dealt(blocks_of(files), "path", "start", size=BLOCK_SIZE).mapInPandas(block_ends, f"{FILE_KEYS}, {ENDS}")
    started = started_blocks(ends, ["path"])
    mine = lambda name: F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    closed = (F.col("stop") < F.col("length")) | ~F.when(F.col("inside"), F.col("in_end")).otherwise(F.col("out_end"))
    good = ~mine("odd") & ~F.col("blanks") & closed
    single = (F.col("start") == 0) & (F.col("stop") == F.col("length")) & F.col("kinds").isin(0, 1, 2, 4)
    by_line, whole = started.agg(F.every(good & ~mine("spans") & ~F.col("inside")), F.every(good & single)).first()
    return FileShapes(started, by_line is not False, whole is not False)


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rule = rule_of(block["delimiter"], bool(block["qualified"]))
                rows = ((text, rule.cells(text)) for at, text in record_texts(block) if at != block["header_at"])
                while some := list(islice(rows, _ROWS)):
                    cells = pa.array([c for _, c in some], pa.list_(pa.string()))
                    ragged = pa.array([t if len(c) != width else None for t, c in some], pa.string())
                    yield pa.RecordBatch.from_arrays([cells, ragged], names=["cells", "ragged"])

    return run


_ROWS = 20_000


def file_cells(shapes: FileShapes, width: int) -> DataFrame:
    """Second pass: cells (array) of every record but the headers, and its text (``ragged``) if they are not ``width``."""
    asked = shapes.blocks.select("path", "start", "stop", "delimiter", "qualified", "encoding", "inside", "header_at")
    return dealt(asked, "path", "start", size=BLOCK_SIZE).mapInArrow(_cut(width), "cells array<string>, ragged string")


def wide_characters(encoding: str) -> bool:
    """Whether ASCII characters take several bytes."""
    return codecs.lookup(encoding).name.startswith(("utf-16", "utf-32"))


def first_record(path: str, delimiter: str, qualified: bool, encoding: str) -> str | None:
    """The first record of one file, reading no more of it than needed."""
    wide = wide_characters(encoding)
    rule, step = RecordRule(delimiter, qualified), 64 * 1024
    with open_file(path) as stream:
        size = stream.size()
        while True:
            data = _read(stream, 0, size if wide else min(step, size))
            whole = len(data) == size
            if wide:
                data = data.decode(encoding).removeprefix("\ufeff").encode()
            data = data[len(_BOM) :] if data.startswith(_BOM) else data
            found, open_end = rule.records(data, False)
            if len(found) > 1 or (whole and found and not open_end):
                return data[found[0][0] : found[0][1]].decode("utf-8" if wide else encoding, "replace")
            if whole:
                if open_end:
                    raise ValueError(f"a quoted field of {path} is never closed")
                return None
            step *= 4
