"""Spreadsheet sheets as all-text tables.

A sheet is one task: its rows are a compressed stream that cannot be entered in
the middle, and the format ends at 1,048,576 rows. Tasks open only the parts they
need and hand rows on in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.names import table_header
from sourceworks.functions.values import SOURCE_TYPE, UNTYPED
from sourceworks.session import cut_lineage, dealt, ship_package
from sourceworks.sources.files import open_file

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BATCH = 2_000
_SHEET_BYTES = 1024 * 1024  # taken for the size of a sheet when sheets are dealt over tasks
# Built-in number formats that show a date or time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, *range(27, 37), 45, 46, 47, *range(50, 59)}


def _is_date_code(code: str) -> bool:
    import re

    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0])
    bare = re.sub(r"\[(?!h+\]|m+\]|s+\])[^\]]*\]", "", bare, flags=re.IGNORECASE)
    return re.search(r"[dmyhs]", bare, re.IGNORECASE) is not None and "General" not in bare


def _text_of(item) -> str:
    runs = [item.find(f"{_MAIN}t")] + [run.find(f"{_MAIN}t") for run in item.findall(f"{_MAIN}r")]
    return "".join(t.text or "" for t in runs if t is not None)


class Workbook:
    """Reads the parts of one ``.xlsx`` file, streaming the rows."""

    def __init__(self, stream):
        import zipfile

        self.parts = zipfile.ZipFile(stream)
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {
            s.get("name"): links[s.get(_LINK)].lstrip("/").removeprefix("xl/")
            for s in book.find(f"{_MAIN}sheets")
        }
        settings = book.find(f"{_MAIN}workbookPr")
        self.epoch_1904 = settings is not None and settings.get("date1904") in ("1", "true")

    def _xml(self, name: str):
        import xml.etree.ElementTree as ET

        with self.parts.open(name) as part:
            return ET.parse(part).getroot()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.parts.namelist():
            return []
        return [_text_of(item) for item in self._xml("xl/sharedStrings.xml")]

    def _date_styles(self) -> list[bool]:
        if "xl/styles.xml" not in self.parts.namelist():
            return []
        root = self._xml("xl/styles.xml")
        codes = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_MAIN}numFmt")}
        formats = root.find(f"{_MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
        return [_is_date_code(codes[i]) if i in codes else i in _DATE_FORMATS for i in ids]

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, tuple[str, str | None]]]]:
        """(row number, column index -> (kind, raw text)) of the rows a sheet holds.

        Kinds are those of the format (n, b, e, str), ``date`` and ``date1904``
        for numbers shown as dates, and ``blank``.
        """
        import xml.etree.ElementTree as ET

        if sheet not in self.sheets:
            raise ValueError(f"no sheet named {sheet!r}")
        strings, dates = self._strings(), self._date_styles()
        with self.parts.open(f"xl/{self.sheets[sheet]}") as part:
            number = 0
            for _, node in ET.iterparse(part):
                if node.tag != f"{_MAIN}row":
                    continue
                number = int(node.get("r", number + 1))
                cells: dict[int, tuple[str, str | None]] = {}
                for cell in node.findall(f"{_MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells[at] = self._cell(cell, strings, dates)
                yield number, cells
                node.clear()

    def _cell(self, cell, strings: list[str], dates: list[bool]) -> tuple[str, str | None]:
        kind, style = cell.get("t", "n"), int(cell.get("s", 0))
        if kind == "inlineStr":
            inline = cell.find(f"{_MAIN}is")
            return "str", _text_of(inline) if inline is not None else ""
        value = cell.find(f"{_MAIN}v")
        if value is None or value.text is None:
            return "blank", None
        if kind == "s":
            return "str", strings[int(value.text)]
        if kind == "n" and style < len(dates) and dates[style]:
            return ("date1904" if self.epoch_1904 else "date"), value.text
        return kind, value.text


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - 64
    return index - 1


def cell_text(kind: Column, raw: Column) -> Column:
    """Text of a cell: ISO date, whole number without fraction, TRUE/FALSE, trimmed."""
    number = raw.try_cast("double")
    days = F.floor(number).cast("int")
    day_one = (
        F.when(kind == "date1904", F.lit("1904-01-01"))
        .when(days < 61, F.lit("1899-12-31"))
        .otherwise(F.lit("1899-12-30"))
    )
    plain = F.when(
        (F.floor(number) == number) & (F.abs(number) < 9.0e18), number.try_cast("bigint").cast("string")
    ).otherwise(number.cast("string"))
    text = (
        F.when(kind == "str", raw)
        .when(kind == "n", plain)
        .when(
            kind.startswith("date"),
            F.when(number >= 0, F.date_add(day_one.cast("date"), days).cast("string")).otherwise(plain),
        )
        .when(kind == "b", F.when(raw.isin("1", "true"), "TRUE").otherwise("FALSE"))
        .when(kind != "blank", raw)
    )
    return F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


_TEXTS = pa.list_(pa.string())
_SHAPE = pa.schema(
    [
        ("st_oid", pa.int64()), ("path", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("header", pa.bool_()),
        ("kinds", _TEXTS), ("raws", _TEXTS), ("names", _TEXTS),
    ]
)


def cells_of_sheet(stream, sheet: str) -> Iterator[tuple[int, bool, list[str], list[str | None]]]:
    """(row number, whether it is the header, kinds, raw texts) of the rows of a sheet.

    The first row is the header; all rows reach to its last cell.
    """
    width = None
    for number, cells in Workbook(stream).rows(sheet):
        header = width is None
        width = max(cells, default=-1) + 1 if header else width
        row = [cells.get(i, ("blank", None)) for i in range(width)]
        yield number, header, [kind for kind, _ in row], [raw for _, raw in row]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for st_oid, path, sheet in zip(*[batch[c].to_pylist() for c in ("st_oid", "path", "sheet")], strict=True):
            if not (sheet or "").strip():
                raise ValueError(f"Excel file {path} cannot have a null sub table")
            if path.lower().endswith(".xls"):
                raise ValueError(f"{path}: legacy binary workbooks must be saved as .xlsx first")
            with open_file(path) as stream:
                rows = []
                for number, header, kinds, raws in cells_of_sheet(stream, sheet):
                    rows.append((st_oid, path, sheet, number, header, kinds, raws, table_header(raws) if header else None))
                    if len(rows) == _BATCH:
                        yield _block(rows)
                        rows = []
                yield _block(rows)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _SHAPE]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SHAPE, strict=True)], schema=_SHAPE)


def sheet_cells(sheets: DataFrame) -> DataFrame:
    """Raw cells of the listed sheets (st_oid, path, sheet): adds row_no, header, kinds, raws, and in header rows the column names."""
    ship_package(sheets.sparkSession)
    spread = dealt(sheets.select("st_oid", "path", "sheet"), "path", "sheet", size=f"{_SHEET_BYTES}")
    return spread.mapInArrow(
        _decode,
        "st_oid bigint, path string, sheet string, row_no int, header boolean, kinds array<string>, raws array<string>, names array<string>",
    )


def sheet_rows(sheets: DataFrame) -> DataFrame:
    """S3: rows of the listed sheets as (path, sheet, row_no, cells array<string>).

    ``sheets`` has (path, sheet). Rows reach to the last cell of the header row of
    their sheet; missing cells are blank, also in the header. The header is the row with the least number.
    """
    decoded = sheet_cells(sheets.select(F.lit(None).cast("bigint").alias("st_oid"), "path", "sheet"))
    return decoded.select("path", "sheet", "row_no", F.zip_with("kinds", "raws", cell_text).alias("cells"))


def read_sheets(sheets: DataFrame, with_path: bool = False) -> DataFrame:
    """S3: the rows of sheets (path, sheet) with one and the same header, as text columns named by it.

    ``with_path`` adds the path of a row's workbook.

    Every sheet is decoded once, by one task, which also makes out its header; what was decoded is written, so that
    names and rows come from one reading. Sheets with different headers are refused.
    """
    decoded = cut_lineage(sheet_cells(sheets.select(F.lit(None).cast("bigint").alias("st_oid"), "path", "sheet")))
    headers = [r.names for r in decoded.where("header").select("names").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"sheets have different headers, among them {headers[0]} and {headers[1]}")
    texts = decoded.where("not header").select("path", F.zip_with("kinds", "raws", cell_text).alias("cells"))
    return texts.select(
        *(["path"] if with_path else []),
        *[F.get("cells", F.lit(i)).alias(name, metadata={SOURCE_TYPE: UNTYPED}) for i, name in enumerate(headers[0] if headers else [])],
    )


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """S3: one sheet as text columns named by its first row."""
    return read_sheets(spark.createDataFrame([(path, sheet)], "path string, sheet string"))
