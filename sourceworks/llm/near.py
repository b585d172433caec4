"""Near copies: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceworks.llm.components import components
from sourceworks.llm.memo import Memo, small_batches
from sourceworks.llm.text import whole
from sourceworks.session import cut_lineage, ship_package

BANDS, ROWS = 32, 4
_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(2**48 - 1)
_word_hash = Memo(xxhash.xxh3_64_intdigest, 400_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache
def _constants(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers that depend on nothing but the arguments."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}") | 1 for i in range(count)], dtype=np.uint64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased.

    A text with fewer words is one shingle; one without words has none.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_word_hash.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(hashes))
    factors = _constants(size, size)
    count = len(hashes) - size + 1
    total = hashes[:count] * factors[0]
    for step in range(1, size):
        total = total + hashes[step : step + count] * factors[step]
    return np.unique(_mixed(total))


def similarity_sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set.

    In round i (from 0) every item is placed in a hashed bin with the value (i,
    hash); a bin keeps its least value, so rounds after a bin is filled don't
    change it. From round ``size`` on, round ``size + j`` puts all items in bin j, so
    that every bin is filled after 2 * size rounds, whatever the set. Rounds are
    made in blocks until all bins are filled.
    """
    sketch = np.full(size, _EMPTY)
    seeds = _constants(2 * size, 0)
    block = max(1, math.ceil(1.3 * size * math.log(size) / len(items)))
    at = 0
    while at < size:
        rounds = np.arange(at, min(at + block, size))
        hashes = _mixed(items[None, :] ^ seeds[rounds][:, None])
        bins = ((hashes >> np.uint64(48)) * np.uint64(size)) >> np.uint64(16)
        values = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (hashes & _LOW)
        np.minimum.at(sketch, bins.ravel().astype(np.intp), values.ravel())
        at += len(rounds)
        if sketch.max() != _EMPTY:
            return sketch
    left = np.flatnonzero(sketch == _EMPTY)
    hashes = _mixed(items[None, :] ^ seeds[size + left][:, None])
    sketch[left] = ((size + left).astype(np.uint64) << np.uint64(48)) | (hashes & _LOW).min(axis=1)
    return sketch


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of every band of a sketch; keys of different bands differ."""
    rows = _mixed(sketch).reshape(bands, -1)
    sums = (rows * _constants(rows.shape[1], 1)[None, :]).sum(axis=1, dtype=np.uint64)
    return _mixed(sums ^ _constants(bands, 2)).view(np.int64)


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts, names, keys = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_hashes(text, width)
                counts.append(len(items))
                names.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                keys.append(band_keys(similarity_sketch(items, bands * rows), bands) if len(items) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "name", "keys"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            items = [shingle_hashes(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("_left"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("_right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_left", "_right"))
    sized = both.select("a", "b", common.alias("_common"), (F.size("_left") + F.size("_right")).alias("_sum"))
    return sized.where(f"100 * _common >= {percent} * (_sum - _common)").select("a", "b")


def _may_link(percent: int) -> str:
    """Condition on two members: shingles that no other candidate has can't be common, nor more than the smaller set."""
    return f"(100 + {percent}) * least(a_most, b_most) >= {percent} * (a_n + b_n)"


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents linked by a resemblance of their shingle sets of ``percent`` or more.

    Equal sets are one class from the start. Classes meet in buckets of equal
    bands of their sketches (with 32 bands of 4 rows a pair of resemblance 0.8 is missed
    with a chance below 1e-7). Links are confirmed on full sets, without all pairs
    of a bucket:

    1. A class is dropped when shingles that no other class in any bucket has
       are so many that nothing can be alike enough.
    2. Every class is compared with the pivot of its best bucket, then with the
       pivots of its other buckets; a pivot is the class with the least share of shingles
       of its own. What is linked becomes a component.
    3. Classes of buckets that still hold different components meet by their rarest
       shingles, which two sets alike enough can't both be without; these pairs are
       compared in rounds that take more of each class's pairs every time and
       leave out what was joined meanwhile. After these, no pair of a bucket is unknown.

    Columns: doc_id, n_shingles, component_id (the smallest doc_id that links
    lead to, itself included) and kept (it is that document). Texts that are null,
    empty or without words have no shingles and are linked with nothing. Rows
    with equal ids count as one document for links, each with its own n_shingles; a null id is kept and has no component. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    facts = cut_lineage(
        texts.mapInArrow(_sketched(width, bands, rows), "doc_id bigint, n_shingles bigint, name binary, keys array<bigint>")
    )
    classes = (
        facts.where("name is not null and doc_id is not null")
        .groupBy("name")
        .agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n"))
    )
    links = _bucket_links(texts, cut_lineage(classes), width, percent)
    named = components(links) if links is not None else None
    names = classes.select(F.col("name").alias("_name"), "node")
    joined = facts.select("doc_id", "n_shingles", "name").join(names, F.col("name") == F.col("_name"), "left")
    if named is not None:
        joined = joined.join(named, "node", "left")
    else:
        joined = joined.withColumn("component", F.lit(None).cast("bigint"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _bucket_links(texts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) between classes that make up the components; None if no two classes share a bucket."""
    placed = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("key")
    members = cut_lineage(placed.join(shared, "key"))
    candidates = members.select("node").distinct()
    whole_texts = texts.join(candidates, F.col("doc_id") == F.col("node")).select("node", "text")
    sets = cut_lineage(whole_texts.mapInArrow(_sets(width), "node bigint, items array<bigint>"))

    alone = (
        sets.select("node", F.explode("items").alias("_item"))
        .groupBy("_item")
        .agg(F.count(F.lit(1)).alias("_held"), F.min("node").alias("node"))
        .where("_held = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("_own"))
    )
    # most: shingles that another candidate may have too.
    most = F.col("n") - F.coalesce("_own", F.lit(0))
    members = members.join(alone, "node", "left").select("key", "node", "n", most.alias("most"))
    members = cut_lineage(members.where(f"100 * most >= {percent} * n"))

    rank = F.struct((1 - F.col("most") / F.col("n")).alias("share"), F.col("node").alias("node"))
    pivots = members.groupBy("key").agg(
        F.min(F.struct(rank.alias("rank"), "n", "most")).alias("_pivot"), F.count(F.lit(1)).alias("_size")
    ).where("_size > 1")
    stars = cut_lineage(
        members.join(pivots, "key")
        .select(
            F.col("_pivot.rank.node").alias("a"),
            F.col("node").alias("b"),
            F.col("_pivot.rank.share").alias("share"),
            F.col("_pivot.n").alias("a_n"),
            F.col("_pivot.most").alias("a_most"),
            F.col("n").alias("b_n"),
            F.col("most").alias("b_most"),
        )
        .where("a <> b")
        .where(_may_link(percent))
        .groupBy("a", "b")
        .agg(F.min("share").alias("share"))
    )
    best = stars.groupBy("b").agg(F.min(F.struct("share", "a")).alias("_best")).select(F.col("_best.a").alias("a"), "b")
    links = cut_lineage(_verified(best, sets, percent))
    named = components(links)
    done = best
    rest = _apart(stars.select("a", "b"), named).join(done, ["a", "b"], "left_anti")
    links = cut_lineage(links.unionByName(_verified(rest, sets, percent)))
    named = components(links)
    return _remaining(members, sets, links, named, percent)


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    left = named.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    right = named.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select(*pairs.columns)


def _remaining(members, sets, links, named, percent) -> DataFrame:
    """All links needed, after comparing what is left between components of a bucket.

    Two sets that are alike enough share one of the rarest shingles of both: of n
    shingles in a fixed order, one among the first n - ceil(n * percent / 100) + 1.
    Sets meet where these agree and their places in both orders leave room for
    enough common shingles. Within a shingle, sets of its main component
    meet only the others, so a shingle of a large component costs as much as it has others.
    """
    placed = members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high")
    open_sets = placed.join(mixed.select("key"), "key").select("node", "n", "most", "component").distinct()
    items = cut_lineage(sets.join(open_sets, "node").select("node", "n", "most", "component", F.explode("items").alias("item")))
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("_held"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("_held", "item")) - 1
    rare = cut_lineage(
        items.join(held, "item").withColumn("place", rank).where(f"place <= n - ({percent} * n + 99) div 100").drop("_held")
    )
    shares = rare.groupBy("item", "component").agg(F.count(F.lit(1)).alias("_sets"))
    mains = shares.groupBy("item").agg(F.max_by("component", F.struct("_sets", "component")).alias("_main"), F.count(F.lit(1)).alias("_kinds"))
    met = rare.join(mains.where("_kinds > 1"), "item")
    side = lambda df, s: df.select("item", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "most", "component", "place")])
    room = f"(100 + {percent}) * least(a_n - a_place, b_n - b_place) >= {percent} * (a_n + b_n)"
    allowed = (
        side(met.where("component <> _main"), "a")
        .join(side(met, "b"), "item")
        .where("a_component <> b_component")
        .where(_may_link(percent))
        .where(room)
    )
    pairs = cut_lineage(
        allowed.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    )
    take = 4
    while pairs.limit(1).count():
        turn = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        numbered = cut_lineage(pairs.withColumn("_turn", turn))
        links = cut_lineage(links.unionByName(_verified(numbered.where(F.col("_turn") <= take), sets, percent)))
        named = components(links)
        pairs = cut_lineage(_apart(numbered.where(F.col("_turn") > take).select("a", "b"), named))
        take *= 8
    return links
