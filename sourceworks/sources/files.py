"""Folder listings, byte access to files inside tasks, backups."""

from __future__ import annotations

import hashlib
import re
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceworks.functions.names import loader_type
from sourceworks.session import dealt, ship_package

_CHUNK = 4 * 1024 * 1024


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder, keyed by base name; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = reader.load(folder).select("path", "length", "modificationTime")
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    return listed.withColumn("file_name", name).withColumn("loader_type", loader_type(F.col("file_name")))


def open_file(path: str):
    """Random-access input on any storage that pyarrow knows; meant for use inside tasks.

    Path forms that Spark hands out (``file:/a``) are accepted.
    """
    filesystem, inner = _locate(path)
    return filesystem.open_input_file(inner)


@contextmanager
def written_whole(path: str):
    """An output stream to a path; the file appears whole when the block ends without an error, or not at all.

    Attempts of the same task write to different names, so a retried or
    speculative task cannot leave a mixed file behind.
    """
    filesystem, inner = _locate(path)
    folder, _, base = inner.rpartition("/")
    filesystem.create_dir(folder, recursive=True)
    part = f"{folder}/_{base}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(part) as out:
        yield out
    filesystem.move(part, inner)


def write_file(path: str, chunks) -> int:
    """Write byte chunks to a path; the file appears whole or not at all. Returns the length."""
    length = 0
    with written_whole(path) as out:
        for chunk in chunks:
            out.write(chunk)
            length += len(chunk)
    return length


def _locate(path: str):
    from urllib.parse import unquote

    from pyarrow import fs

    if re.match(r"^file:/+", path):
        return fs.LocalFileSystem(), "/" + unquote(re.sub(r"^file:/+", "", path))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _digests(batches, target: str | None):
    """Length and checksum of listed files, read in chunks; copies them below ``target`` if there is one."""
    for batch in batches:
        rows = []
        for path, name in zip(batch["path"], batch["file_name"], strict=True):
            digest, length = hashlib.sha256(), 0
            with open_file(path) as source:

                def chunks(source=source, digest=digest):
                    while chunk := source.read(_CHUNK):
                        digest.update(chunk)
                        yield chunk

                if target:
                    length = write_file(f"{target}/{name}", chunks())
                else:
                    length = sum(map(len, chunks()))
            rows.append((name, length, digest.hexdigest()))
        if rows:
            yield pd.DataFrame(rows, columns=["file_name", "length", "checksum"])


def _per_file(spark: SparkSession, folder: str, target: str | None) -> DataFrame:
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # The name below the folder, so that equal names in several of its folders stay apart.
    base = re.sub(r"^[a-z0-9]+:/*", "/", folder.rstrip("/"))
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    listed = files.select("path", "length", F.substring_index(plain, f"{base}/", -1).alias("file_name"))
    schema = "file_name string, length long, checksum string"
    return dealt(listed, "path", size="length").select("path", "file_name").mapInPandas(lambda batches: _digests(batches, target), schema)


def backup_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Name below the folder, length and checksum of every file of a run; files of any size are read in chunks."""
    return _per_file(spark, folder, None)


def backup_files(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Byte-exact copy of a run's files below ``target/files``; returns the manifest stored beside it.

    A file is copied in chunks by one task and appears whole or not at all; its
    length and checksum are those of the bytes that were written.
    """
    _per_file(spark, folder, f"{target.rstrip('/')}/files").write.mode("overwrite").parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")
