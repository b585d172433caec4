"""Periodic runs of words: block convolution at dyadic scales finds seeds, which are extended to maximal runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceworks.llm.memo import small_batches
from sourceworks.llm.text import whole, words
from sourceworks.session import ship_package

LEAST = 12  # words of a run
PRIME, ROOT = 3 * 2**30 + 1, 5  # transforms of up to 2**30 words; products fit 64 bits
DIRECT = 32  # below this distance a block has so few words that its sums are taken term by term
CELLS = 1 << 19  # numbers transformed at a time
BATCH_BYTES = 2_000_000
FAR = np.iinfo(np.int64).max


@lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``, by doubling."""
    step = pow(ROOT, (PRIME - 1) // size, PRIME)
    step = pow(step, PRIME - 2, PRIME) if inverse else step
    out = np.ones(max(size // 2, 1), dtype=np.uint64)
    done = 1
    while done < len(out):
        out[done : 2 * done] = out[:done] * np.uint64(pow(step, done, PRIME)) % np.uint64(PRIME)
        done *= 2
    return out


def _transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    x, prime = rows.copy(), np.uint64(PRIME)
    half = x.shape[1] // 2
    while half:
        pairs = x.reshape(len(x), -1, 2, half)
        total, less = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] + (prime - pairs[:, :, 1])
        pairs[:, :, 0] = np.where(total >= prime, total - prime, total)
        pairs[:, :, 1] = less % prime * _powers(2 * half, False) % prime
        half //= 2
    return x


def _restore(rows: np.ndarray) -> np.ndarray:
    """The rows of which ``rows`` are the transforms."""
    x, prime = rows.copy(), np.uint64(PRIME)
    half = 1
    while half < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, half)
        turned = pairs[:, :, 1] * _powers(2 * half, True) % prime
        total, less = pairs[:, :, 0] + turned, pairs[:, :, 0] + (prime - turned)
        pairs[:, :, 0] = np.where(total >= prime, total - prime, total)
        pairs[:, :, 1] = np.where(less >= prime, less - prime, less)
        half *= 2
    return x * np.uint64(pow(x.shape[1], PRIME - 2, PRIME)) % prime


def _by_transform(codes: np.ndarray, at: np.ndarray, width: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks agree with their window at which distances in [low, 2 low): squared differences that add up to zero.

    The sum over a block is sum(p * p) + sum(w * w) - 2 sum(p * w), whose last part for all
    distances at once is the convolution of the window with the reversed block. All is computed
    in integers modulo a prime above every code, so a block that agrees always gives zero; the few other zeros fall when seeds
    are extended.
    """
    prime, span = np.uint64(PRIME), low + width - 1
    size = 1 << (span - 1).bit_length()
    found = []
    step = max(1, CELLS // size)
    for start in range(0, len(at), step):
        rows = at[start : start + step]
        block = codes[rows[:, None] + np.arange(width)].astype(np.uint64)
        window = codes[rows[:, None] + low + np.arange(span)].astype(np.uint64)
        a, b = np.zeros((len(rows), size), np.uint64), np.zeros((len(rows), size), np.uint64)
        a[:, :width], b[:, :span] = block[:, ::-1], window
        product = _restore(_transform(a) * _transform(b) % prime)[:, width - 1 : span]
        squares = np.zeros((len(rows), span + 1), np.uint64)
        np.cumsum(window * window % prime, axis=1, out=squares[:, 1:])
        sums = (squares[:, width:] - squares[:, : span + 1 - width]) % prime
        own = (block * block % prime).sum(axis=1) % prime
        row, away = np.nonzero((own[:, None] + sums) % prime == 2 * product % prime)
        found.append((rows[row], away + low))
    return _joined(found)


def _term_by_term(codes: np.ndarray, at: np.ndarray, width: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for short blocks, word by word; blocks that differ leave at once."""
    found = []
    for away in range(low, 2 * low):
        left = at
        for k in range(width):
            left = left[codes[left + k] == codes[left + k + away]]
        found.append((left, np.full(len(left), away, dtype=np.int64)))
    return _joined(found)


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common prefix, in steps that double."""
    most, done, step = min(len(left), len(right)), 0, 32
    while done < most:
        differ = left[done : min(done + step, most)] != right[done : min(done + step, most)]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + step, 2 * step
    return most


def _stretch(codes: np.ndarray, at: int, away: int) -> tuple[int, int]:
    """The longest [start, end) around ``at`` in which every word equals the one ``away`` words on."""
    end = at + _agreeing(codes[at:-away], codes[at + away :])
    start = at - _agreeing(codes[:at][::-1], codes[away : at + away][::-1])
    return start, end


def _block_width(low: int, least: int) -> int:
    """Words such that each run with a period in [low, 2 low) holds a block at a multiple of it, a period before its end."""
    return max(1, min((max(least, 2 * q) - q + 1) // 2 for q in range(low, min(2 * low, least + 1))) if low <= least else low // 2)


def find_runs(codes: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """All maximal runs (start, length, period) in ``codes``, no stretch of equal codes being over ``longest`` words long.

    ``codes`` are small non-negative integers; texts stand one after another with codes of their own each, so
    that nothing agrees across them. At the scale of periods in [low, 2 low) each run holds a whole block
    of about low / 2 words together with the same words a period later. Blocks go if one of their
    words does not come again within 2 low words, or if they lie with all their distances in a
    run whose period is known and not above the block: they can agree there only at
    multiples of that period. The others are convolved with the window that follows.
    """
    count = len(codes)
    order = np.argsort(codes, kind="stable")
    again = np.full(count, FAR, dtype=np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: dict[tuple[int, int], int] = {}
    low = 1
    while 2 * low <= longest and low < count:
        width = _block_width(low, least)
        blocks = count // width
        near = again[: blocks * width].reshape(blocks, width).max(axis=1) < 2 * low if blocks else np.empty(0, bool)
        at = np.flatnonzero(near).astype(np.int64) * width
        known = [(s, e, q) for (s, e), q in runs.items() if q <= width]
        reach, period = _reach(known, at)
        inside = reach >= at + 2 * low - 1 + width
        at, reach, period = at[~inside], reach[~inside], period[~inside]
        padded = np.concatenate([codes, np.arange(count, count + 3 * low + width) + int(codes.max(initial=0)) + 1])
        seeds, away = (_by_transform if low >= DIRECT else _term_by_term)(padded, at, width, low)
        place = np.searchsorted(at, seeds)
        fresh = (reach[place] < seeds + away + width) | (away % np.maximum(period[place], 1) != 0)
        seeds, away = seeds[fresh], away[fresh]
        done: dict[int, int] = {}
        for k in np.lexsort((seeds, away)).tolist():
            seed, gap = int(seeds[k]), int(away[k])
            if done.get(gap, -1) > seed:
                continue
            start, end = _stretch(codes, seed, gap)
            done[gap] = end
            if end - start >= gap and end - start + gap >= least:
                runs.setdefault((start, end + gap), gap)  # periods ascend, so the first one is the smallest
        low *= 2
    found = np.array([(s, e - s, q) for (s, e), q in runs.items()], dtype=np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _reach(known: list[tuple[int, int, int]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the furthest end of a known run that starts at it or before, and that run's period."""
    if not known or not len(at):
        return np.full(len(at), -1, dtype=np.int64), np.ones(len(at), dtype=np.int64)
    known = sorted(known)
    starts, ends, periods = (np.array(c, dtype=np.int64) for c in zip(*known, strict=True))
    best = np.maximum.accumulate(ends)
    holder = np.maximum.accumulate(np.where(ends == best, np.arange(len(ends)), 0))
    place = np.searchsorted(starts, at, side="right") - 1
    held = place >= 0
    return np.where(held, best[place], -1), np.where(held, periods[holder[place]], 1)


class _Codes(dict):
    """Numbers of words in order of first sight."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def text_runs(texts: list[bytes], least: int = LEAST) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text, and each text without the words that runs repeat, joined by one space."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    ends = np.cumsum(sizes)
    of = _Codes()
    flat = np.fromiter((of[w] for some in split for w in some), dtype=np.int64, count=int(sizes.sum()))
    apart = np.repeat(np.arange(len(texts)), sizes) * max(len(of), 1) + flat
    _, codes = np.unique(apart, return_inverse=True)
    runs = find_runs(codes.astype(np.int64), int(sizes.max(initial=0)), least)
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    found, collapsed = [], []
    for k, some in enumerate(split):
        own = runs[cuts[k] : cuts[k + 1]] - np.array([ends[k] - sizes[k], 0, 0])
        found.append(own)
        if len(own):
            steps = np.zeros(len(some) + 1, dtype=np.int64)
            np.add.at(steps, own[:, 0] + own[:, 2], 1)
            np.add.at(steps, own[:, 0] + own[:, 1], -1)
            some = [some[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(some))
    return found, collapsed


def _scan(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH_BYTES):
            found, collapsed = text_runs(batch.column("text").cast(pa.binary()).to_pylist(), least)
            numbers = np.concatenate(found)
            items = pa.StructArray.from_arrays([pa.array(numbers[:, k]) for k in range(3)], ["start", "length", "period"])
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_given"), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(collapsed, pa.binary())],
                names=["_given", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All periodic runs of words of every text, and the text without their repetitions.

    A run is a stretch of words, as long as possible, whose smallest period q
    (words q apart are equal) fits in it twice, of at least ``least`` words. A
    word goes if any run has it after its first q words.

    Columns: the columns of ``docs`` in the struct ``_given``, runs (start, length, period by start, then period) and
    collapsed (bytes of the remaining words, one space between). Words are what stands between
    white space (\\x20, \\x09 to \\x0D). Null, empty and blank texts have no words and no runs.
    Every row is worked on by itself, so repeated rows and null ids need no
    care; there is no shuffle. A text is held whole by a task. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("_given"), whole("text").alias("text")
    )
    found = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    return rows.mapInArrow(_scan(least), StructType([rows.schema["_given"], *StructType.fromDDL(found)]))


def planted_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, in about a tenth of the documents with a periodic end that the id's checksum sets; null ids have none."""
    sum_ = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) div 10")
    items = words(F.col(text))

    def repeated(parts: Column) -> Column:
        n = F.size(parts)
        start = g % n
        period = F.floor((n - start) / (3 + g % 8)) + 1
        at = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, at(i))), " ")

    planted = F.get(F.transform(F.array(items), lambda parts: F.when(F.size(parts) > 0, repeated(parts)).otherwise("")), 0)
    return F.when(sum_ % 10 == 0, planted).otherwise(F.col(text))


def run_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the longest run (of equals the first, then that of the smallest period), and digests of runs and remaining words."""
    found = periodic_runs(docs.select("doc_id", "text"), least)
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    best = found.withColumn("_best", F.array_max(order))
    return best.select(
        F.col("_given.doc_id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        "_best.length",
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
