"""Every query against a brute-force version on small documents with edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sourceworks.llm import repeats
from sourceworks.llm.queries import QUERIES

from .conftest import by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = [q for q in QUERIES if not q.startswith("op5_")]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def named(prefix):
    return QUERIES[next(q for q in QUERIES if q.startswith(prefix))]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", [q for q in DOCUMENTS if q != "pipeline" and not q.startswith("op11_")])
def test_repeated_rows_and_null_ids_keep_their_rows(spark, repeated_folder, name):
    rows = QUERIES[name](spark, repeated_folder).collect()
    ids = Counter(r["doc_id"] for r in rows)
    given = Counter(r["doc_id"] for r in spark.read.parquet(f"{repeated_folder}/documents.parquet").collect())
    assert ids == given


def test_token_files(spark, folder, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, start = by_id(named("op1_")(spark, folder)), 0
    for doc_id, text in texts:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        row = found[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards(spark, folder, texts):
    found = by_id(named("op2_")(spark, folder))
    assert set(found) == {d for d, _ in texts}
    for doc_id, text in texts:
        data = text.encode()
        row = found[doc_id]
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    shards = defaultdict(list)
    for row in found.values():
        shards[row["shard"]].append(row["slot"])
    assert set(shards) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def shingles(text, width):
    words = text.encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def classes(texts, width):
    """Smallest id reachable over links of resemblance 0.8, by comparing all pairs."""
    sets = [(d, shingles(t, width)) for d, t in texts]
    name = {d: d for d, _ in sets}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    for i, (a, left) in enumerate(sets):
        for b, right in sets[:i]:
            if left and right and 5 * min(len(left), len(right)) >= 4 * max(len(left), len(right)):
                common = len(left & right)
                if 100 * common >= 80 * (len(left) + len(right) - common):
                    low, high = sorted((root(a), root(b)))
                    name[high] = low
    return {d: root(d) for d, _ in sets}, {d: len(s) for d, s in sets}


def test_near_copies(spark, folder, texts):
    component, sizes = classes(texts, 4)
    for doc_id, row in by_id(named("op3_")(spark, folder)).items():
        assert (row["n_shingles"], row["component_id"], row["kept"]) == (sizes[doc_id], component[doc_id], component[doc_id] == doc_id)


def test_token_counts(spark, folder, texts):
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(named("op4_")(spark, folder))
    for doc_id, text in texts:
        count = len(library.encode(text))
        row = found[doc_id]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), count, count > 4096)


def test_fingerprints(spark, folder, texts):
    found = by_id(named("op6_")(spark, folder))
    prints = {}
    for (doc_id, text), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc_id]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), sha(edited))
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        own, other, after = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for w in map(WORD.findall, (text, edited, following)))
        for near, second in ((row["near_edited"], other), (row["near_next"], after)):
            true = len(own & second) / len(own | second) if own | second else 1.0
            assert abs(near - true) < 0.2


def test_previous_factors(spark, folder, texts):
    found, seen = by_id(named("op7_")(spark, folder)), set()
    for doc_id, text in texts:
        data = text.encode()
        covered = bytearray(len(data))
        here = [data[i : i + 50] for i in range(len(data) - 49)]
        for i, piece in enumerate(here):
            if piece in seen:
                covered[i : i + 50] = b"\1" * 50
        seen.update(here)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        row = found[doc_id]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(data), sum(covered), spans, sha(kept))


def test_previous_factors_over_many_slices(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = by_id(repeats.repeat_digests(docs))
    assert by_id(repeats.repeat_digests(docs, slice_bytes=40_000, range_bytes=90_000)) == whole


def test_quality_rules(spark, folder, texts):
    found = by_id(named("op8_")(spark, folder))
    for doc_id, text in texts:
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        row = found[doc_id]
        assert row[1:7] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert row["kept"] == (not failed)  # no line is common here


def test_mixing(spark, folder, texts):
    found = by_id(named("op9_")(spark, folder))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for doc_id, text in texts:
        sizes[source[doc_id]] += len(WORD.findall(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, target, rest = set(order), {}, 1.5 * sum(sizes.values())
    while True:
        unit = rest / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= above
    target |= {s: weight[s] * unit for s in free}
    largest = defaultdict(int)
    for doc_id, text in texts:
        row, s, size = found[doc_id], source[doc_id], len(WORD.findall(text))
        assert (row["size"], row["source_size"]) == (size, sizes[s])
        assert row["target"] == pytest.approx(target[s])
        assert row["taken"] <= 2 * size
        taken[s] += row["taken"]
        largest[s] = max(largest[s], size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] + 1 for s in order)
    assert found == by_id(named("op9_")(spark, folder))


def test_byte_bpe(spark, folder, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by_id(named("op10_")(spark, folder))
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        row = found[doc_id]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))
