"""Expressions over names: columns, files, ids, labels and locations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceworks.schemas import LOADER_BY_EXTENSION

MAX_COLUMN_NAME = 60
DEFAULT_DELIMITER = ","
_EDGE_SPACE = r"^\s+|\s+$"


def column_name(raw: Column) -> Column:
    """a source header as a warehouse column name."""
    name = F.replace(F.regexp_replace(raw, _EDGE_SPACE, ""), F.lit("#"), F.lit("NUM"))
    name = F.upper(F.regexp_replace(name, r"\s+", "_"))
    name = F.regexp_replace(F.regexp_replace(name, r"\W", ""), r"^(\d)", "_$1")
    return F.substring(name, 1, MAX_COLUMN_NAME)


def header_name(raw: str | None, index: int) -> str:
    """F1 for one header cell on the driver; a name without letters gets its position."""
    name = re.sub(_EDGE_SPACE, "", raw or "", flags=re.ASCII).replace("#", "NUM")
    name = re.sub(r"\s+", "_", name, flags=re.ASCII).upper()
    name = re.sub(r"\W", "", name, flags=re.ASCII)
    if name[:1].isdigit():
        name = "_" + name
    return name[:MAX_COLUMN_NAME] or f"COLUMN_{index}"


def number_repeats(names: Sequence[str]) -> list[str]:
    """W5 for one header: repeated names get a suffix that counts down."""
    left = Counter(names)
    repeated = {name for name, count in left.items() if count > 1}
    numbered = []
    for name in names:
        numbered.append(f"{name}_{left[name]}" if name in repeated else name)
        left[name] -= 1
    return numbered


def table_header(raw: Sequence[str | None]) -> list[str]:
    """Normalized, distinct column names of one file."""
    names = number_repeats([header_name(cell, i) for i, cell in enumerate(raw)])
    clashes = sorted(name for name, count in Counter(names).items() if count > 1)
    if clashes:
        raise ValueError(f"column names collide after numbering repeats: {', '.join(clashes)}")
    return names


def file_extension(file_name: Column) -> Column:
    """lower-case extension without its dot, '' when there is none."""
    return F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))


def loader_type(file_name: Column) -> Column:
    """loader of a file by its extension, null when unsupported."""
    lookup = F.create_map(*[F.lit(x) for pair in LOADER_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(lookup, file_extension(file_name))


def loader_of(file_name: str) -> str:
    """F3 on the driver; raises when there is no supported extension."""
    found = re.search(r"\.([^.]+)$", file_name)
    if found is None:
        raise ValueError(f"no file extension in {file_name!r}")
    try:
        return LOADER_BY_EXTENSION[found.group(1).lower()]
    except KeyError:
        raise ValueError(f"extension of {file_name!r} is not supported") from None


def run_files_location(base: Column, record_date: Column) -> Column:
    """folder with the files of a run."""
    return F.concat_ws("/", base, F.date_format(record_date, "yyyy-MM-dd"), F.lit("files"))


def run_zip_location(base: Column, record_date: Column) -> Column:
    """folder with the backups of a run."""
    return F.concat_ws("/", base, F.date_format(record_date, "yyyy-MM-dd"), F.lit("zip"))


def backup_name(code: Column, record_date: Column) -> Column:
    """name of a run's backup."""
    return F.concat_ws("_", code, F.date_format(record_date, "yyyy-MM-dd"))


def snake_case(name: Column) -> Column:
    """CamelCase to snake_case."""
    return F.ltrim(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), F.lit("_"))


def display_label(name: Column) -> Column:
    """snake_case to words that start with a capital, the rest unchanged."""
    words = F.transform(
        F.split(F.replace(name, F.lit("_"), F.lit(" ")), " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
    )
    return F.array_join(words, " ")


def id_number(text_id: Column) -> Column:
    """first run of digits of an id as a number, null when there is none."""
    return F.regexp_extract(text_id, r"\d+", 0).try_cast("bigint")


def file_id(number: Column) -> Column:
    """number to file id."""
    return F.concat(F.lit("F"), number.cast("string"))


def url_file_name(url: Column) -> Column:
    """text after the last slash."""
    return F.substring_index(url, "/", -1)


def contains_ignore_case(text: Column, part: str) -> Column:
    """case-insensitive contains."""
    return F.lower(text).contains(part.lower())


def delimiter_char(delimiter: Column) -> Column:
    """one character, a comma when there is none."""
    return F.coalesce(F.nullif(F.substring(delimiter, 1, 1), F.lit("")), F.lit(DEFAULT_DELIMITER))


def delimiter_of(delimiter: str | None) -> str:
    """F21 on the driver."""
    return (delimiter or DEFAULT_DELIMITER)[0]


def id_sort_key(text_id: Column) -> Column:
    """T5: the digits of an id as a number (0 when there are none)."""
    digits = F.regexp_replace(text_id, r"[^0-9]", "")
    return F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
