"""Passages that occur in an earlier document: suffixes whose longest previous factor reaches a length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourceworks.llm.slices import id_marks, slice_of
from sourceworks.llm.text import whole
from sourceworks.session import ship_package

LENGTH = 50
SEED = 16  # bytes of a landmark
HALF = (LENGTH - SEED) // 2
BLOCK = 1 << 20  # suffixes worked on at a time
SORTED = 1 << 19  # suffixes sorted at a time
MANY = 10_000  # contexts of a stem that are asked for together
SLICE_BYTES, RANGE_BYTES = 8 << 20, 12 << 20
_POSITION = np.uint64((1 << 21) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
FILTER_BITS = 40


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _words(raw: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each of ``count`` places on, as one number; ``raw`` has eight bytes more."""
    out = np.empty(count, dtype=np.uint64)
    for shift in range(8):
        part = out[shift::8]
        part[:] = np.frombuffer(raw, dtype="<u8", offset=shift, count=len(part))
    return out


def _prints(words: np.ndarray, at: np.ndarray, length: int, *salts: int) -> list[np.ndarray]:
    """64-bit fingerprints of the ``length`` bytes from each place in ``at`` on, for each salt (at most two)."""
    found = [np.full(len(at), salt, dtype=np.uint64) for salt in salts]
    for step in [*range(0, length - 8, 8), length - 8]:
        here = words[at + step]
        found = [_mixed(f * factor + here) for f, factor in zip(found, (_B, _A), strict=False)]
    return found


def _blocks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of keys, where its blocks of equal keys start, and the block of each place in the order."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def _least(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, start) if len(start) else values


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each pair, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _parts(raw: np.ndarray, at: np.ndarray, depth: int = 0) -> Iterator[np.ndarray]:
    """Suffixes in parts of at most ``SORTED`` that follow each other in suffix order, equal ones always in one part.

    Equal suffixes keep their order. Only if all ``LENGTH`` bytes are equal a part may be larger.
    """
    if len(at) <= SORTED or depth >= LENGTH:
        yield at
        return
    width = min(8, LENGTH - depth)
    keys = np.zeros((len(at), 8), dtype=np.uint8)
    for k in range(width):
        keys[:, k] = raw[at + depth + k]
    keys = keys.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(at)]])
    start = 0
    while start < len(at):
        stop = int(bounds[np.searchsorted(bounds, start + SORTED, side="right") - 1])
        if stop > start:
            yield at[start:stop]
        else:
            stop = int(bounds[np.searchsorted(bounds, start, side="right")])
            yield from _parts(raw, at[start:stop], depth + width)
        start = stop


def suffix_order(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes at ``at`` in order of their first ``LENGTH`` bytes, part by part, and how many of these each shares with the one before."""
    windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    for part in _parts(raw, at):
        if len(part) <= SORTED:
            chosen = np.ascontiguousarray(windows[part])
            order = np.argsort(chosen.view(f"S{LENGTH}").ravel(), kind="stable")
            chosen = chosen[order]
            same = chosen[1:] == chosen[:-1]
            common = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
            yield part[order], np.concatenate([[0], common])
        else:
            yield part, np.concatenate([[0], np.full(len(part) - 1, LENGTH)])


def previous_factors(ranks: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of suffixes in suffix order: what a suffix shares with one of a smaller rank.

    That is the more of what it shares with the nearest such suffix before it and the nearest one
    after it. Both are found by jumps: while the candidate is not smaller, its own
    candidate takes its place, and the shared length is the least on the way. Where less than ``LENGTH`` is shared on the way
    the search ends, so values below it are upper bounds.
    """

    def nearest(ranks: np.ndarray, shared: np.ndarray) -> np.ndarray:
        to = np.arange(-1, len(ranks) - 1)
        shared = shared.copy()
        waiting = np.arange(len(ranks))
        while len(waiting):
            ahead = to[waiting]
            waiting = waiting[(shared[waiting] >= LENGTH) & (ahead >= 0) & (ranks[ahead] >= ranks[waiting])]
            ahead = to[waiting]
            shared[waiting], to[waiting] = np.minimum(shared[waiting], shared[ahead]), to[ahead]
        return np.where(to >= 0, shared, 0)

    before = nearest(ranks, common)
    after = nearest(ranks[::-1], np.concatenate([common[1:], [0]])[::-1])[::-1]
    return np.maximum(before, after)


class Suffixes:
    """The suffixes of the documents of one slice, cut at ``LENGTH`` bytes and within their document.

    Every suffix has a landmark: the place among its first bytes where the hash
    of ``SEED`` bytes is least (leftmost of equals). Equal suffixes have it at
    the same distance, and hold ``SEED + HALF`` equal bytes that start or end
    with it; these are the suffix's stem. Neighbouring suffixes share landmarks, so there are far
    fewer stems than suffixes, and a suffix whose stem no other document has can't occur elsewhere.
    """

    def __init__(self, texts: list[bytes], ranks: np.ndarray):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.ranks = ranks
        self.size = int(self.ends[-1]) if len(sizes) else 0
        self.raw = np.frombuffer(b"".join(texts) + bytes(LENGTH + 80), dtype=np.uint8)
        inside = np.ones(self.size, dtype=bool)
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            inside[max(start, end - LENGTH + 1) : end] = False
        self._inside = inside
        runs = [self._runs(at, min(at + BLOCK, self.size)) for at in range(0, self.size, BLOCK)]
        self.first, self.count, self.stem = (
            np.concatenate([r[k] for r in runs]) if runs else np.empty(0, dtype=t)
            for k, t in enumerate((np.int64, np.int64, np.uint64))
        )

    def _block(self, start: int, stop: int) -> np.ndarray:
        span = stop - start + LENGTH + SEED  # a stem may start at the last byte but SEED of a suffix's reach
        return _words(np.ascontiguousarray(self.raw[start : start + span + 16]), span)

    def _runs(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of suffixes with one stem: first suffix, number of suffixes, stem."""
        words = self._block(start, stop)
        count = stop - start
        reach = LENGTH - SEED + 1
        places = count + reach - 1
        hashes = _mixed(words[:places] * _A + words[8 : places + 8])
        least = (hashes & ~_POSITION) | np.arange(places, dtype=np.uint64)
        covered = 1
        while 2 * covered <= reach:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < reach:
            least = np.minimum(least[: len(least) - (reach - covered)], least[reach - covered :])
        own = np.flatnonzero(self._inside[start:stop])
        if not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        landmark = (least[own] & _POSITION).astype(np.int64)
        ahead = landmark - own >= HALF  # the stem ends with the landmark
        change = (landmark[1:] != landmark[:-1]) | (own[1:] != own[:-1] + 1) | (ahead[1:] != ahead[:-1])
        at = np.flatnonzero(np.concatenate([[True], change]))
        where, before = landmark[at], ahead[at]
        stem = np.where(
            before,
            _prints(words, np.where(before, where - HALF, 0), SEED + HALF, 1)[0],
            _prints(words, where, SEED + HALF, 2)[0],
        )
        return own[at] + start, np.diff(np.append(at, len(own))), stem >> np.uint64(64 - FILTER_BITS)

    def rank_at(self, places: np.ndarray) -> np.ndarray:
        return self.ranks[np.searchsorted(self.ends, places, side="right")]

    @cached_property
    def stems(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct stems in order, whether two documents here have it, and each run's place among them."""
        order, start, block = _blocks(self.stem)
        ranks = self.rank_at(self.first)[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = block
        return self.stem[order[start]], _least(ranks, start) < -_least(-ranks, start), place

    def _prints_at(self, places: np.ndarray, salt: int) -> np.ndarray:
        """Fingerprints of the suffixes at ascending places."""
        out = np.empty(len(places), dtype=np.uint64)
        for start in range(0, self.size, BLOCK):
            a, b = np.searchsorted(places, [start, start + BLOCK])
            if a < b:
                out[a:b] = _prints(self._block(start, min(start + BLOCK, self.size)), places[a:b] - start, LENGTH, salt)[0]
        return out

    def context_counts(self) -> np.ndarray:
        """About how many different contexts each distinct stem has here: a run's context is all its suffixes cover."""
        keys, _, place = self.stems
        counts = np.bincount(place, minlength=len(keys))
        several = np.flatnonzero(counts[place] > 1)
        first, last = self.first[several], self.first[several] + self.count[several] - 1
        prints = _mixed(self._prints_at(first, 3) * _A + self._prints_at(last, 4))
        _, one = np.unique(_mixed(prints + place[several].astype(np.uint64) * _B), return_index=True)
        return np.where(counts > 1, np.bincount(place[several[one]], minlength=len(keys)), counts)

    def later_here(self) -> np.ndarray:
        """Places of suffixes whose longest previous factor among the documents of the slice reaches ``LENGTH``."""
        _, here, place = self.stems
        chosen = np.flatnonzero(here[place])
        at = _spread(self.first[chosen], self.count[chosen])
        found = [np.empty(0, dtype=np.int64)]
        for part, common in suffix_order(self.raw, at):
            found.append(part[previous_factors(self.rank_at(part), common) >= LENGTH])
        return np.concatenate(found)


class Contexts:
    """What a slice asks the others: the contexts of its runs whose stem another slice has, each text of a context once.

    The context of a run is all bytes of its suffixes, at most ``2 * LENGTH``. Of stems with very many contexts
    each suffix is asked for by itself, under its own fingerprint, so that these spread over ranges too. Texts are in order of
    their keys (a stem or a fingerprint), which only lead them to a range: what is equal is judged by the bytes.
    """

    def __init__(self, suffixes: Suffixes, elsewhere: np.ndarray, many: np.ndarray):
        _, _, place = suffixes.stems
        together = np.flatnonzero((elsewhere & ~many)[place])
        alone = np.flatnonzero((elsewhere & many)[place])
        singles = _spread(suffixes.first[alone], suffixes.count[alone])
        self.first = np.concatenate([suffixes.first[together], singles])
        self.count = np.concatenate([suffixes.count[together], np.ones(len(singles), dtype=np.int64)])
        keys = np.concatenate([suffixes.stem[together], suffixes._prints_at(singles, 5) >> np.uint64(64 - FILTER_BITS)])
        data = suffixes.raw.tobytes()
        known: dict[bytes, int] = {}
        stops = self.first + self.count + LENGTH - 1
        which = [known.setdefault(data[a:b], len(known)) for a, b in zip(self.first.tolist(), stops.tolist(), strict=True)]
        self._which = np.array(which, dtype=np.int64)
        own = np.empty(len(known), dtype=np.uint64)
        own[self._which] = keys
        order = np.argsort(own, kind="stable")
        self.keys = own[order]
        texts = list(known)
        self.texts = [texts[k] for k in order.tolist()]
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        self._which = at[self._which]

    @property
    def suffixes(self) -> np.ndarray:
        """Suffixes in each text."""
        return np.array([len(t) for t in self.texts], dtype=np.int64) - LENGTH + 1

    def places(self, flags: np.ndarray) -> np.ndarray:
        """Places of the suffixes that are flagged, of flags for all suffixes of all texts in order."""
        ends = np.cumsum(self.suffixes)
        start = (ends - self.suffixes)[self._which]
        return _spread(self.first, self.count)[flags[_spread(start, self.count)]]


def removed_bytes(size: int, places: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes are covered by the suffixes at ``places``."""
    starts = np.zeros(size + LENGTH, dtype=bool)
    starts[places + LENGTH - 1] = True
    seen = np.cumsum(starts)
    return seen[LENGTH - 1 : LENGTH - 1 + size] > np.concatenate([[0], seen])[:size]


# Questions between slices: which of my stems has another slice, which of my suffixes one with smaller ids?


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, count * 8, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


PART = "slice int, salt int"
QUESTION = f"range int, {PART}, n bigint, keys binary, more binary"
ANSWER = f"{PART}, range int, n bigint, flags binary, many binary"
RESULT = "n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"


def _ranges(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, start, stop) of ascending keys of ``FILTER_BITS`` bits, of ranges that have any."""
    top = keys >> np.uint64(FILTER_BITS - 32)
    cuts = np.searchsorted((top * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    return [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]


def _question(part: tuple[int, int], rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table(
        {
            "range": pa.array(columns[0], pa.int32()),
            "slice": pa.array([part[0]] * len(rows), pa.int32()),
            "salt": pa.array([part[1]] * len(rows), pa.int32()),
            "n": pa.array(columns[1], pa.int64()),
            "keys": pa.array(columns[2], pa.binary()),
            "more": pa.array(columns[3], pa.binary()),
        }
    )


def _answer(asked: pa.Table, flags: list[np.ndarray], many: list[np.ndarray] | None = None) -> pa.Table:
    bits = lambda parts: pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())
    return pa.table(
        {
            **{c: asked.column(c) for c in ("slice", "salt", "range")},
            "n": pa.array([len(f) for f in flags], pa.int64()),
            "flags": bits(flags),
            "many": bits(many) if many is not None else pa.nulls(len(flags), pa.binary()),
        }
    )


def _ask_stems(ranges: int):
    """Distinct stems of a slice, with the number of their contexts."""

    def run(key, docs):
        _, suffixes = _loaded(docs)
        stems, counts = suffixes.stems[0], np.minimum(suffixes.context_counts(), 65_535).astype("<u2")
        squeezed = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)
        rows = [(r, b - a, _packed(stems[a:b]), squeezed(counts[a:b])) for r, a, b in _ranges(stems, ranges)]
        return _question(tuple(k.as_py() for k in key), rows)

    return run


def _answer_stems(limit: int):
    """For each stem of a range: whether another slice has it, and whether it has more than ``limit`` contexts."""

    def run(asked):
        counts = asked.column("n").to_pylist()
        keys = np.concatenate([_unpacked(k, n) for k, n in zip(asked.column("keys").to_pylist(), counts, strict=True)])
        contexts = np.concatenate(
            [np.frombuffer(pa.decompress(m, 2 * n, codec="zstd", asbytes=True), dtype="<u2") for m, n in zip(asked.column("more").to_pylist(), counts, strict=True)]
        )
        order, start, block = _blocks(keys)
        several = np.diff(np.append(start, len(keys))) > 1
        total = np.add.reduceat(contexts[order].astype(np.int64), start)
        flags, many = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
        flags[order], many[order] = several[block], (total > limit)[block]
        cuts = np.cumsum(counts)[:-1]
        return _answer(asked, np.split(flags, cuts), np.split(many, cuts))

    return run


def _ask_contexts(ranges: int):
    """The texts of a slice's contexts, with their lengths."""

    def run(key, docs, stems):
        part = tuple(k.as_py() for k in key)
        if not docs.num_rows:
            return _question(part, [])
        _, suffixes = _loaded(docs)
        contexts = Contexts(suffixes, *_flags(stems, len(suffixes.stems[0])))
        rows = []
        for r, a, b in _ranges(contexts.keys, ranges):
            texts = contexts.texts[a:b]
            lengths = np.array([len(t) for t in texts], dtype=np.uint8).tobytes()
            rows.append((r, b - a, lengths, pa.compress(b"".join(texts), codec="zstd", asbytes=True)))
        return _question(part, rows)

    return run


def _answer_contexts(asked: pa.Table) -> pa.Table:
    """For each suffix in the texts of a range: has a slice with smaller ids the same ``LENGTH`` bytes?"""
    asked = asked.sort_by("slice")
    lengths = [np.frombuffer(k, dtype=np.uint8).astype(np.int64) for k in asked.column("keys").to_pylist()]
    texts = [pa.decompress(m, int(n.sum()), codec="zstd", asbytes=True) for m, n in zip(asked.column("more").to_pylist(), lengths, strict=True)]
    raw = np.frombuffer(b"".join(texts) + bytes(LENGTH), dtype=np.uint8)
    every = np.concatenate(lengths)
    starts = np.cumsum(every) - every
    at = _spread(starts, every - LENGTH + 1)
    ends = np.cumsum([int((n - LENGTH + 1).sum()) for n in lengths])
    slices = np.repeat(asked.column("slice").to_numpy(), np.diff(ends, prepend=0))
    number = np.empty(len(raw), dtype=np.int64)
    number[at] = np.arange(len(at))
    flags = np.zeros(len(at), dtype=bool)
    for part, common in suffix_order(raw, at):
        mine = number[part]
        ranks = slices[mine]
        first = np.flatnonzero(common < LENGTH)
        flags[mine] = ranks > np.repeat(_least(ranks, first), np.diff(np.append(first, len(part))))
    return _answer(asked, np.split(flags, ends[:-1]))


def _flags(answers: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Both answers to the questions of a slice, which were in order of ranges."""
    rows = answers.sort_by("range")

    def joined(column: str) -> np.ndarray:
        parts = [
            np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=n).astype(bool)
            for f, n in zip(rows.column(column).to_pylist(), rows.column("n").to_pylist(), strict=True)
            if f is not None
        ]
        return np.concatenate(parts) if parts else np.empty(0, dtype=bool)

    if len(found := joined("flags")) != count:
        raise ValueError(f"{len(found)} answers to {count} questions")
    return found, joined("many")


def _loaded(docs: pa.Table) -> tuple[pa.Table, Suffixes]:
    """A slice's documents in order of id; null ids are above all others."""
    docs = docs.sort_by("doc_id")
    ids = docs.column("doc_id").combine_chunks()
    _, ranks = np.unique(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), return_inverse=True)
    texts = docs.column("text").combine_chunks().cast(pa.binary()).to_pylist()
    return docs, Suffixes(texts, ranks.astype(np.int64))


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone``, with every byte of a character of which a byte is gone."""
    first = (raw & 0xC0) != 0x80
    first[0] = True
    start = np.flatnonzero(first)
    return np.repeat(np.logical_or.reduceat(gone, start), np.diff(start, append=len(raw)))


def _cut(characters: bool):
    def run(left, right):
        stems, earlier = (right.filter(pc.equal(right.column("question"), q)) for q in (0, 1))
        docs, suffixes = _loaded(left)
        contexts = Contexts(suffixes, *_flags(stems, len(suffixes.stems[0])))
        earlier, _ = _flags(earlier, int(contexts.suffixes.sum()))
        gone = removed_bytes(suffixes.size, np.concatenate([suffixes.later_here(), contexts.places(earlier)]))
        sizes, spans, kept = [], [], []
        for start, end in zip(suffixes.starts.tolist(), suffixes.ends.tolist(), strict=True):
            here = gone[start:end]
            sizes.append(int(here.sum()))
            edges = np.flatnonzero(np.diff(here, prepend=False, append=False)).reshape(-1, 2)
            spans.append(edges.tolist())
            raw = suffixes.raw[start:end]
            if sizes[-1] and characters:
                here = _whole_characters(raw, here)
            kept.append((raw[~here] if sizes[-1] else raw).tobytes())
        return pa.table(
            {
                "_given": docs.column("_given"),
                "n_bytes": pa.array(suffixes.ends - suffixes.starts, pa.int64()),
                "n_removed": pa.array(sizes, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return run


def _placed(docs: DataFrame, size: int, slice_bytes: int) -> DataFrame:
    """Documents with their slice, a run of ids, and salt, which splits an id (or no id) that fills more than a slice.

    Rows of one id don't remove from each other, so they may lie apart.
    """
    slices = size // slice_bytes + 1
    cuts = id_marks(docs, "doc_id", slices)
    full = sorted(m for m, n in Counter(cuts).items() if n > 1)
    marks = sorted({*cuts, *(m + 1 for m in full)})
    nameless = docs.where("doc_id is null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    row = F.monotonically_increasing_id()
    salt = F.when(F.col("doc_id").isNull(), F.pmod(row, F.lit(nameless // slice_bytes + 1)))
    if full:
        salt = salt.when(F.col("doc_id").isin(full), F.pmod(row, F.lit(max(Counter(cuts).values()) + 1)))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        whole("text").alias("text"),
        F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("_given"),
        salt.otherwise(0).cast("int").alias("salt"),
    ).withColumn("slice", slice_of("doc_id", marks, len(marks) + 1))


def remove_repeats(
    docs: DataFrame, slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES, characters: bool = False, many: int = MANY
) -> DataFrame:
    """Remove every byte of a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

    Texts are taken as UTF-8 bytes; strings are judged on the input. Documents
    are cut into slices of ascending ids. A suffix goes if its longest previous
    factor reaches ``LENGTH``: if the nearest suffix of a smaller document, before or after it in
    suffix order, agrees with it that far. Within a slice the suffixes are ordered and previous and next smaller
    positions taken; between slices, a suffix has an earlier match if a slice of smaller ids has its bytes.
    Only suffixes that can occur elsewhere are ordered and asked for: first
    the slices ask which stems (see ``Suffixes``) any other slice has, then they send the bytes around these
    (see ``Contexts``), which are compared as they are.

    A context goes out once per slice however often it occurs in it, so a
    passage that a third of all documents share is one text of each slice; stems with more than ``many`` contexts, and eight
    for each slice, are split. Texts
    are shuffled once, to their slices, which are quantiles of the documents of
    about ``slice_bytes``; contexts are compared in ranges of what ``range_bytes`` of text hold, so
    the size of a task doesn't depend on that of the table. A slice sends a row to each range, and no more rows
    than it has contexts.

    Columns: the columns of ``docs`` in the struct ``_given``, n_bytes, n_removed,
    spans (removed [start, end) byte ranges) and kept (remaining bytes; with ``characters``
    without those of characters that a span cuts). Null texts
    count as empty; documents with equal ids don't remove from each other; null ids come
    after all others. Texts shorter than ``LENGTH`` bytes stay whole. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = size // range_bytes + 1
    placed = _placed(docs, size, slice_bytes)
    by_slice = placed.groupBy("slice", "salt")
    asked = by_slice.applyInArrow(_ask_stems(ranges), QUESTION)
    limit = many + 8 * (size // slice_bytes + 1)
    stems = asked.groupBy("range").applyInArrow(_answer_stems(limit), ANSWER)
    again = by_slice.cogroup(stems.groupBy("slice", "salt")).applyInArrow(_ask_contexts(ranges), QUESTION)
    earlier = again.groupBy("range").applyInArrow(_answer_contexts, ANSWER)
    answers = stems.withColumn("question", F.lit(0)).unionByName(earlier.withColumn("question", F.lit(1)))
    out = StructType([placed.schema["_given"], *StructType.fromDDL(RESULT)])
    return by_slice.cogroup(answers.groupBy("slice", "salt")).applyInArrow(_cut(characters), out)


def repeat_digests(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the remaining bytes; ``sizes`` as above."""
    found = remove_repeats(docs.select("doc_id", "text"), **sizes)
    return found.select(
        F.col("_given.doc_id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
