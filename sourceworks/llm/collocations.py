"""Phrase collocations by set-oriented mining: relations of occurrences, joined at adjacent places, grouped, cut to frequent phrases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceworks.llm.memo import small_batches
from sourceworks.llm.ranking import ranked
from sourceworks.llm.text import whole
from sourceworks.session import cut_lineage, ship_package

BLOCK_BYTES, RANGE_BYTES = 6 << 20, 16 << 20
MARKS = b".,;:!?\n\x0b\x0c\r"
_APART = bytes.maketrans(MARKS + b"\t", b"\n" * len(MARKS) + b" ")
BLOCK = "block bigint, occurrences binary"
QUESTION = "range int, block bigint, left binary, right binary, n binary"
ANSWER = "range int, block bigint, ids binary, left array<bigint>, right array<bigint>, f array<bigint>"


class _Codes(dict):
    """Numbers of words in order of first sight; blanks and piece ends have their own."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})

    def __missing__(self, word):
        self[word] = number = len(self) - 2
        return number


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts in order as numbers, with -1 where a piece ends, and the words by number."""
    apart = b"\n".join(texts).lower().translate(_APART).replace(b"\n", b" \n ").split(b" ")
    of = _Codes()
    codes = np.fromiter(map(of.__getitem__, apart), dtype=np.int64, count=len(apart))
    return codes[codes != -2], list(of)[2:]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in as many bytes each as the greatest needs, byte plane by byte plane."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(len(numbers), 8)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b"")


def _numbers(blob: bytes) -> np.ndarray:
    width, count = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((count, 8), dtype=np.uint8)
    if count:
        planes = np.frombuffer(pa.decompress(blob[9:], count * width, codec="zstd", asbytes=True), dtype=np.uint8)
        out[:, :width] = planes.reshape(width, count).T
    return out.view("<i8").ravel()


def _packed(numbers: np.ndarray) -> bytes:
    """Occurrences in order; what stands between frequent ones is one -1."""
    gap = numbers < 0
    return _squeezed(numbers[~(gap & np.append(gap[1:], True))] + 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return _numbers(blob) - 1


def _word_blocks(block_bytes: int):
    """One row for the documents of a language in a stretch of input: words by number, their counts, all occurrences in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in small_batches(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
            for lang in [x for x in held if sizes[x] >= block_bytes]:
                yield _word_block(lang, held.pop(lang))
                del sizes[lang]
            if sum(sizes.values()) >= 2 * block_bytes:  # many small languages
                for lang in list(held):
                    yield _word_block(lang, held.pop(lang))
                sizes.clear()
        for lang in list(held):
            yield _word_block(lang, held.pop(lang))

    return run


def _word_block(lang: str, texts: list[bytes]) -> pa.RecordBatch:
    codes, words = word_codes(texts)
    counts = np.bincount(codes[codes >= 0], minlength=len(words))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang]),
            pa.array([words], pa.list_(pa.binary())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([_packed(codes)], pa.binary()),
        ],
        names=["lang", "words", "counts", "occurrences"],
    )


def _occurrences(table: pa.Table) -> np.ndarray:
    return _unpacked(table.column("occurrences")[0].as_py())


def _block(key: int, numbers: np.ndarray) -> pa.Table:
    """A row for the block, or none if nothing frequent is left in it."""
    rows = [(key, _packed(numbers))] if (numbers >= 0).any() else []
    return pa.table({"block": pa.array([k for k, _ in rows], pa.int64()), "occurrences": pa.array([b for _, b in rows], pa.binary())})


def _keep_words(key, blocks, frequent):
    """Semi-join of a block's occurrences with frequent words: their ids, -1 for all others."""
    if not blocks.num_rows or not frequent.num_rows:
        return _block(0, np.empty(0, np.int64))
    codes = _occurrences(blocks)
    local, ids = (frequent.column(c).to_numpy() for c in ("local", "id"))
    names = np.full(max(int(codes.max(initial=0)), int(local.max())) + 2, -1, dtype=np.int64)
    names[local] = ids
    return _block(key[0].as_py(), names[codes])  # a code of -1 finds the last place


def _neighbours(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a sorted relation with itself at the next place.

    Distinct (left, right) in order, the place of each joined occurrence among them, and where these stand.
    """
    at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    names, local = np.unique(numbers, return_inverse=True)
    keys = local[at] * len(names) + local[at + 1]
    keys, which = np.unique(keys, return_inverse=True)
    return names[keys // max(len(names), 1)], names[keys % max(len(names), 1)], which, at


def _by_range(left: np.ndarray, right: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending pairs by range of their hash, and where in it the ranges start and end."""
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    range_ = ((mixed >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(range_, kind="stable")
    return order, np.searchsorted(range_[order], np.arange(ranges + 1, dtype=np.uint64))


def _ask_pairs(ranges: int):
    """The distinct pairs of each block with their counts, a row for each range that has any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("occurrences").to_pylist(), strict=True):
                left, right, which, _ = _neighbours(_unpacked(blob))
                counts = np.bincount(which, minlength=len(left))
                order, cuts = _by_range(left, right, ranges)
                rows = [(r, order[a:b]) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _ in rows], pa.int32()),
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([_squeezed(np.diff(left[at], prepend=0)) for _, at in rows], pa.binary()),
                        pa.array([_squeezed(right[at]) for _, at in rows], pa.binary()),
                        pa.array([_squeezed(counts[at]) for _, at in rows], pa.binary()),
                    ],
                    names=["range", "block", "left", "right", "n"],
                )

    return run


def _count_pairs(least: int, last: bool):
    """Group-count of a range: its frequent pairs, and for each block (unless this is the ``last`` length) their ids.

    An id has the range in its upper half and the place among the frequent pairs of the range in its lower.
    """

    def run(key, asked):
        unpacked = {c: [_numbers(x) for x in asked.column(c).to_pylist()] for c in ("left", "right", "n")}
        left = np.concatenate([np.cumsum(x) for x in unpacked["left"]])
        right, n = np.concatenate(unpacked["right"]), np.concatenate(unpacked["n"])
        order = np.lexsort((right, left))
        changed = (left[order[1:]] != left[order[:-1]]) | (right[order[1:]] != right[order[:-1]])
        first = np.concatenate([[0], np.flatnonzero(changed) + 1])
        total = np.add.reduceat(n[order], first)
        frequent = total >= least
        numbers = np.where(frequent, np.cumsum(frequent) - 1 + (key[0].as_py() << 32), -1)
        ids = np.empty(len(left), dtype=np.int64)
        ids[order] = np.repeat(numbers, np.diff(np.append(first, len(order))))
        parts = np.split(ids, np.cumsum([len(x) for x in unpacked["n"]])[:-1])
        answers = [] if last else [(b, _squeezed(p + 1)) for b, p in zip(asked.column("block").to_pylist(), parts, strict=True) if (p >= 0).any()]
        chosen = order[first[frequent]]
        none = [None] * len(answers)
        lists = [pa.array([*none, x], pa.list_(pa.int64())) for x in (left[chosen], right[chosen], total[frequent])]
        return pa.table(
            [
                pa.array([key[0].as_py()] * (len(answers) + 1), pa.int32()),
                pa.array([*[b for b, _ in answers], None], pa.int64()),
                pa.array([*[i for _, i in answers], None], pa.binary()),
                *lists,
            ],
            names=["range", "block", "ids", "left", "right", "f"],
        )

    return run


def _keep_phrases(ranges: int):
    """Occurrences of the frequent phrases one word longer, at the place of their first word."""

    def run(key, blocks, answers):
        if not blocks.num_rows or not answers.num_rows:
            return _block(0, np.empty(0, np.int64))
        numbers = _occurrences(blocks)
        left, right, which, at = _neighbours(numbers)
        order, cuts = _by_range(left, right, ranges)
        ids = np.full(len(left), -1, dtype=np.int64)
        for r, found in zip(answers.column("range").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            ids[order[cuts[r] : cuts[r + 1]]] = _numbers(found) - 1
        out = np.full(len(numbers), -1, dtype=np.int64)
        out[at] = ids[which]
        return _block(key[0].as_py(), out)

    return run


def _numbered(frequent: DataFrame, order: list[str]) -> DataFrame:
    """Phrases with dense ids, the frequent ones first."""
    placed = ranked(frequent.withColumn("_rare", -F.col("f")), [], ["_rare", *order], "id", "_all")
    return cut_lineage(placed.drop("_rare", "_all"))


def _semi_join(blocks: DataFrame, frequent: DataFrame, keep) -> DataFrame:
    """The blocks' occurrences of what ``frequent`` (block, ...) lists, written sorted as they are."""
    named = blocks.select(F.col("block").alias("_block"), "occurrences")
    joined = named.groupBy("_block").cogroup(frequent.groupBy("block"))
    return cut_lineage(joined.applyInArrow(keep, BLOCK))


def frequent_phrases(
    docs: DataFrame, longest: int, least: int, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES
) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of 1 to ``longest`` words found at least ``least`` times in their language, by length, and all words by language.

    Columns of the k-th table: id, lang, words (array of binary), f, left and right (ids of the first and last k - 1
    words; not for k = 1), heads and tails (how often its first and its last 1, 2, ... k words occur).
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = size // range_bytes + 1
    made = rows.mapInArrow(_word_blocks(block_bytes), "lang string, words array<binary>, counts array<bigint>, occurrences binary")
    blocks = cut_lineage(made.withColumn("block", F.monotonically_increasing_id()))
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "block", "lang", F.col("pos").alias("local"), F.col("col.words").alias("word"), F.col("col.counts").alias("n")
    )
    total = cut_lineage(
        blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)).alias("n"))
    )
    known = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    single = _numbered(known, ["lang", "word"])
    level = single.select(
        "id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")
    )
    found = each.join(single.select("lang", "word", "id"), ["lang", "word"]).select("block", "local", "id")
    relation = _semi_join(blocks, found, _keep_words)
    levels = [level]
    for length in range(2, longest + 1):
        asked = relation.mapInArrow(_ask_pairs(ranges), QUESTION)
        answers = cut_lineage(asked.groupBy("range").applyInArrow(_count_pairs(least, length == longest), ANSWER))
        pairs = answers.where("block is null").select("range", F.posexplode(F.arrays_zip("left", "right", "f")))
        number = F.shiftleft(F.col("range").cast("bigint"), 32) + F.col("pos")
        pairs = pairs.select(number.alias("id"), "col.left", "col.right", "col.f")
        first = level.select(F.col("id").alias("left"), "lang", F.col("words").alias("_words"), F.col("heads").alias("_heads"))
        last = level.select(F.col("id").alias("right"), F.element_at("words", -1).alias("_word"), F.col("tails").alias("_tails"))
        level = cut_lineage(
            pairs.join(first, "left")
            .join(last, "right")
            .select(
                "id", "lang", F.concat("_words", F.array("_word")).alias("words"), "f", "left", "right",
                F.concat("_heads", F.array("f")).alias("heads"), F.concat("_tails", F.array("f")).alias("tails"),
            )
        )
        levels.append(level)
        if length < longest:
            relation = _semi_join(relation, answers.where("block is not null").select("block", "range", "ids"), _keep_phrases(ranges))
    return levels, total


#: Scores of all cuts of a phrase; the least struct has the lowest score, of equals the fewest words.
_BEST = """array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
    'score', cast(f as decimal(20, 0)) * 2000000BD
             div (cast(heads[k - 1] as decimal(20, 0)) + cast(tails[size(words) - k - 1] as decimal(20, 0))),
    'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))"""


def _uncovered(level: DataFrame, longer: DataFrame | None, percent: int) -> DataFrame:
    """Phrases that no phrase one word longer has nearly as often.

    A phrase two words longer stands in for no more than the one between them, which occurs at least as often.
    """
    if longer is None:
        return level
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    parts = longer.select(F.explode(F.array("left", "right")).alias("id"), "f")
    most = parts.groupBy("id").agg(F.max("f").alias("_longer"))
    kept = F.col("_longer").isNull() | (100 * wide("_longer") < percent * wide("f"))
    return level.join(most, "id", "left").where(kept).drop("_longer")


def collocations(
    docs: DataFrame,
    longest: int = 4,
    least: int = 30,
    covered_percent: int = 80,
    top: int = 2000,
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words in each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and these into
    words at blanks and tabs. A phrase is a candidate if it occurs at least ``least``
    times (a) in pieces of its language (null: ``und``), which has n words. A cut
    splits it into a first part that occurs l times and a rest that occurs r
    times; its score is floor(2000000 a / (l + r)), and the lowest-scoring cut counts (of equals the
    one after fewest words). Candidates inside a longer one that occurs at least ``covered_percent``
    percent as often are left out. The ``top`` first by score, a (both descending) and phrase are returned.

    Relations of occurrences are written sorted, in blocks of documents, by piece and place. For each
    length a block joins its relation with itself at the next place (a phrase and the one that starts a word
    later give a phrase one word longer), sends each phrase once with its count to one of
    the ranges of phrases (as many as ``range_bytes`` of text need), packed, and hears from the range which are
    frequent, so the next length extends frequent phrases only. A phrase of
    any frequency is one entry of each block, so it is no hot spot; languages are spread over blocks. A document
    is in one block, and held whole by its task.

    Null texts count as empty; ids, repeated rows and other columns play no part; ties
    in score and a go by the bytes of the phrase. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    levels, total = frequent_phrases(docs, longest, least, block_bytes, range_bytes)
    chosen = None
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        some = _uncovered(level, longer, covered_percent).select("lang", "words", "f", "heads", "tails")
        chosen = some if chosen is None else chosen.unionByName(some)
    scored = chosen.select(
        "lang",
        F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"),
        F.col("f").alias("a"),
        F.expr(_BEST).alias("_best"),
    ).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")
    order = scored.withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
    placed = ranked(order, ["lang"], ["_score", "_a", "phrase"], "rank", "_all").where(F.col("rank") <= top)
    return placed.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
