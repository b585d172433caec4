"""Expanding archives into files."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.session import dealt, ship_package
from sourceworks.sources.files import open_file, write_file

_CHUNK = 4 * 1024 * 1024


def archive_entries(archives: DataFrame) -> DataFrame:
    """(path, entry, length) of the files in each archive of (path); only directories are read."""
    ship_package(archives.sparkSession)

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open_file(path) as stream, zipfile.ZipFile(stream) as archive:
                    rows = [(path, e.filename, e.file_size) for e in archive.infolist() if not e.is_dir()]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "entry", "length"])

    spread = dealt(archives.select("path"), "path", size="0")
    return spread.mapInPandas(listing, "path string, entry string, length long")


def expand_archives(archives: DataFrame, target: str) -> DataFrame:
    """Write every archive entry to a file below ``target``.

    Entries are spread over tasks one by one, so a big archive does not end up in
    one task, and are copied in chunks. The result (path, entry, file, length)
    describes the written files; it is lazy, and running it again rewrites the
    same files. Entries go to a folder named like their archive, so equal names
    in several archives stay apart; archives of one name in several folders are
    refused, and so are entries that would leave ``target``.
    """
    named = archives.select("path").distinct().groupBy(F.substring_index("path", "/", -1).alias("name"))
    clash = named.agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if clash:
        raise ValueError(f"several archives are named {clash.name}")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, entry in zip(batch["path"], batch["entry"], strict=True):
                if entry.startswith("/") or ".." in entry.split("/"):
                    raise ValueError(f"entry {entry!r} of {path} points outside the target folder")
                with open_file(path) as stream, zipfile.ZipFile(stream) as archive, archive.open(entry) as source:
                    file = f"{target}/{path.rpartition('/')[2]}/{entry}"
                    length = write_file(file, iter(lambda s=source: s.read(_CHUNK), b""))
                rows.append((path, entry, file, length))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "entry", "file", "length"])

    entries = dealt(archive_entries(archives), "path", "entry", size="length").select("path", "entry")
    return entries.mapInPandas(expand, "path string, entry string, file string, length long")
