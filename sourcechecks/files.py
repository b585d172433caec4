"""Files in foreign formats, written by Spark from the given tables for the readers to read.

A file holds a range of key values, so its size has a bound whatever the data.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.session import ship_package
from sourceworks.sources.files import write_file

_RESULT = "path string, rows long"
WORKBOOK_ROWS = 5_000


def _per_range(df: DataFrame, key: str, span: int, build, name: str, folder: str) -> list[str]:
    """Write one file per key range with ``build(rows, number) -> bytes``; returns the folder."""
    ship_package(df.sparkSession)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["_file"].iloc[0])
        ordered = rows.sort_values(key).drop(columns="_file")
        path = f"{folder}/{name.format(number)}"
        write_file(path, [build(ordered, number)])
        return pd.DataFrame({"path": [path], "rows": [len(ordered)]})

    ranged = df.withColumn("_file", F.expr(f"`{key}` div {span}"))
    written = ranged.groupBy("_file").applyInPandas(write, _RESULT)
    written.write.mode("overwrite").parquet(f"{folder}_written")
    return folder


def write_workbooks(orders: DataFrame, folder: str) -> str:
    """Workbooks with the sheets ``Orders`` (all cell kinds) and ``Keys``."""

    def build(rows: pd.DataFrame, number: int) -> bytes:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        strings: dict[str, int] = {}

        def shared(text):
            return f'<c t="s"><v>{strings.setdefault(text, len(strings))}</v></c>'

        def inline(text):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

        lines = ["<row>" + "".join(map(shared, ["Order #", "Status", "Price", "Order  Date", "Urgent", "Note"])) + "</row>"]
        keys = ["<row>" + inline("key") + "</row>"]
        for r in rows.itertuples(index=False):
            note = "" if r.note is None else f'<c r="F{len(lines) + 1}" t="str"><v>{escape(r.note)}</v></c>'
            lines.append(
                f"<row><c><v>{r.o_orderkey}</v></c>{shared(r.o_orderstatus)}<c><v>{r.price}</v></c>"
                f'<c s="1"><v>{r.serial}</v></c><c t="b"><v>{int(r.urgent)}</v></c>{note}</row>'
            )
            keys.append(f"<row><c><v>{r.o_orderkey}.0</v></c></row>")
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        parts = {
            "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Orders" sheetId="1" r:id="rId1"/>'
            f'<sheet name="Keys" sheetId="2" r:id="rId2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" '
            f'Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>",
            "xl/worksheets/sheet2.xml": f"<worksheet {main}><sheetData>{''.join(keys)}</sheetData></worksheet>",
            "xl/sharedStrings.xml": f"<sst {main}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in parts.items():
                book.writestr(name, text)
        return out.getvalue()

    rows = orders.select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).alias("serial"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("  "), "o_orderpriority", F.lit(" & more "))).alias("note"),
    )
    return _per_range(rows, "o_orderkey", WORKBOOK_ROWS, build, "book{}.xlsx", folder)


def write_dbf_files(orders: DataFrame, folder: str, span: int = 1_000_000) -> str:
    """DBF files with the four common field types; every tenth record is marked as deleted."""

    def build(rows: pd.DataFrame, number: int) -> bytes:
        import struct

        fields = [("ORDER KEY", "N", 12), ("STATUS", "C", 4), ("PRICE", "N", 12), ("PLACED", "D", 8), ("URGENT", "L", 1)]
        width = 1 + sum(size for *_, size in fields)
        head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(fields), width)
        for name, letter, size in fields:
            head += struct.pack("<11sc4xBB14x", name.encode(), letter.encode(), size, 2 if name == "PRICE" else 0)
        body = [
            f"{'*' if r.deleted else ' '}{r.o_orderkey:>12}{r.o_orderstatus:<4}{r.price:>12}{r.day:8}{'T' if r.urgent else '?'}"
            for r in rows.itertuples(index=False)
        ]
        return head + b"\r" + "".join(body).encode("latin-1") + b"\x1a"

    rows = orders.select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" " * 8)).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        (F.col("o_orderkey") % 10 == 3).alias("deleted"),
    )
    return _per_range(rows, "o_orderkey", span, build, "orders{}.dbf", folder)


def write_archives(customers: DataFrame, folder: str) -> str:
    """Zip archives with two CSV entries for every 200 customers."""

    def build(rows: pd.DataFrame, number: int) -> bytes:
        import io
        import zipfile

        names = "c_custkey,c_name\n" + "".join(f"{r.c_custkey},{r.c_name}\n" for r in rows.itertuples(index=False))
        segments = "c_custkey,c_mktsegment\n" + "".join(
            f"{r.c_custkey},{r.c_mktsegment}\n" for r in rows.itertuples(index=False)
        )
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"names_{number}.csv", names)
            archive.writestr(f"sub/segments_{number}.csv", segments)
        return out.getvalue()

    return _per_range(
        customers.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 200, build, "bundle{}.zip", folder
    )


def write_small_files(orders: DataFrame, folder: str, count: int) -> str:
    """Flat files by the remainder of the order number, with line ends in quoted fields.

    A file may be of any size: its lines come to the task that writes it in batches, in order.
    """
    ship_package(orders.sparkSession)

    def write(batches):
        pieces = (
            (number, part["_line"])
            for batch in batches
            for number, part in batch.groupby("_file", sort=True)
        )
        for number, own in groupby(pieces, key=lambda piece: int(piece[0])):
            path, rows = f"{folder}/part{number}.txt", 0

            def chunks(own=own):
                nonlocal rows
                yield b"order key;status;note\r\n"
                for _, lines in own:
                    rows += len(lines)
                    yield "".join(lines).encode()

            write_file(path, chunks())
            yield pd.DataFrame({"path": [path], "rows": [rows]})

    missing = F.lit("None")
    note = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit('"'), F.coalesce("o_orderpriority", missing), F.lit(';\n"')))
    line = F.concat("o_orderkey", F.lit(";"), F.coalesce("o_orderstatus", missing), F.lit(";"), note, F.lit("\r\n"))
    lines = orders.select((F.col("o_orderkey") % count).alias("_file"), "o_orderkey", line.alias("_line"))
    placed = lines.repartition("_file").sortWithinPartitions("_file", "o_orderkey").select("_file", "_line")
    placed.mapInPandas(write, _RESULT).write.mode("overwrite").parquet(f"{folder}_written")
    return folder


def write_dbf_memos(documents: DataFrame, folder: str, span: int = 500) -> str:
    """Tables of documents whose texts lie in a memo file beside them, of each kind in turn."""
    ship_package(documents.sparkSession)

    def memo_file(texts: list[bytes], kind: int) -> tuple[bytes, list[int]]:
        import struct

        block = 64 if kind == 2 else 512
        parts, at, numbers = [], 1 if kind < 2 else 8, []
        for text in texts:
            if not text:
                numbers.append(0)
                continue
            numbers.append(at)
            if kind == 0:
                entry = text + b"\x1a\x1a"
            elif kind == 1:
                entry = struct.pack("<4sI", b"\xff\xff\x08\x00", len(text) + 8) + text
            else:
                entry = struct.pack(">II", 1, len(text)) + text
            padded = entry + bytes(-len(entry) % block)
            parts.append(padded)
            at += len(padded) // block
        if kind == 2:
            head = struct.pack(">IHH", at, 0, block) + bytes(504)
        else:
            head = struct.pack("<I16xH", at, block if kind else 0) + bytes(490)
        return head + b"".join(parts), numbers

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        import struct

        number = int(rows["_file"].iloc[0])
        ordered = rows.sort_values("doc_id")
        texts = [(t or "").encode() for t in ordered["text"]]
        kind = number % 3
        if kind == 0 and any(b"\x1a" in t for t in texts):
            kind = 1  # the first kind ends a text there
        memo, blocks = memo_file(texts, kind)
        fields = [("DOC ID", "N", 12), ("LANG", "C", 4), ("TEXT", "M", 4 if kind == 2 else 10)]
        width = 1 + sum(size for *_, size in fields)
        version = (0x83, 0x8B, 0x30)[kind]
        head = struct.pack("<B3BIHH20x", version, 24, 1, 1, len(ordered), 33 + 32 * len(fields), width)
        for name, letter, size in fields:
            head += struct.pack("<11sc4xBB14x", name.encode(), letter.encode(), size, 0)
        body = []
        for doc_id, lang, at in zip(ordered["doc_id"], ordered["lang"], blocks, strict=True):
            place = struct.pack("<i", at) if kind == 2 else f"{at or '':>10}".encode()
            body.append(f" {doc_id:>12}{lang or '':<4}".encode() + place)
        path = f"{folder}/documents{number}.dbf"
        write_file(path.replace(".dbf", ".fpt" if kind == 2 else ".dbt"), [memo])
        write_file(path, [head + b"\r" + b"".join(body) + b"\x1a"])
        return pd.DataFrame({"path": [path], "rows": [len(ordered)]})

    ranged = documents.select("doc_id", "lang", "text", F.expr(f"doc_id div {span}").alias("_file"))
    ranged.groupBy("_file").applyInPandas(write, _RESULT).write.mode("overwrite").parquet(f"{folder}_written")
    return folder


def write_texts(texts: DataFrame) -> None:
    """Write every row (path, body) to a file of its own."""
    ship_package(texts.sparkSession)

    def write(batches):
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"], strict=True):
                write_file(path, [body.encode()])
            yield pd.DataFrame({"path": batch["path"], "rows": 1})

    texts.select("path", "body").mapInPandas(write, _RESULT).write.format("noop").mode("overwrite").save()
