"""Column expressions over texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order; no words in an empty one."""
    return F.array_remove(F.split(text, SPACE), "")


def window_hashes(hashes: str, width: int) -> Column:
    """A 64-bit hash of every run of ``width`` entries of the array column ``hashes``; needs that many entries."""
    items = F.col(hashes)
    return F.transform(
        F.sequence(F.lit(0), F.size(items) - width),
        lambda i: F.xxhash64(*[F.get(items, i + step) for step in range(width)]),
    )


def seeded(seed: str, *parts: Column) -> Column:
    """A hex digest that orders rows at random, alike in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def fraction(digest: Column) -> Column:
    """A number in [0, 1) from the first eight digits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
