"""Each stage of the pipeline against a brute-force version of it on the stage's own input."""

import base64
from collections import Counter

import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline
from sourceworks.llm import mixing
from sourceworks.session import cut_lineage

from .test_queries import WORD, classes

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The input of every stage and the result of the last."""
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], folder)))
    return docs


def rows(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_stages_return_documents(steps):
    assert all(df.columns == NAMES for df in steps[1:5])
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_keeps_clean_documents(steps):
    want = []
    for doc_id, text, lang, source, _ in rows(steps[0]):
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words):
            want.append((doc_id, text, lang, source, len(text)))
    assert rows(steps[1]) == sorted(want, key=repr)


def test_quality_stage_removes_boilerplate_of_a_hot_source(spark):
    own = lambda k: " ".join(f"d{k}w{i}" for i in range(60))
    notice, few = "all rights reserved by the source", "a line of a hundred texts"
    texts = [own(k) + f"\n{notice}" * (k < 110) + f"\n{few}" * (k >= 1100) for k in range(1200)]
    made = [(k, t, "en", "hot", len(t)) for k, t in enumerate(texts)]
    given = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, given, "").collect()}
    assert left == {k: own(k) + f"\n{few}" * (k >= 1100) for k in range(1200)}


def test_near_stage_keeps_one_of_each_group(steps):
    given = rows(steps[1])
    component, _ = classes(sorted((r[0], r[1]) for r in given), 5)
    assert rows(steps[2]) == [r for r in given if component[r[0]] == r[0]]
    assert len(rows(steps[2])) < len(given)


def test_repeats_stage_removes_later_passages(steps):
    want, seen = [], set()
    for doc_id, text, lang, source, _ in sorted(rows(steps[2])):
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 49):
            if data[i : i + 50] in seen:
                covered[i : i + 50] = b"\1" * 50
        seen.update(data[i : i + 50] for i in range(len(data) - 49))
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        if kept or not data:
            left = kept.decode("utf-8", "ignore")
            want.append((doc_id, left, lang, source, len(left)))
    assert rows(steps[3]) == sorted(want, key=repr)


def test_repeats_stage_drops_cut_characters_only(spark):
    passage = "\x82" + "".join(chr(97 + i % 26) for i in range(52))  # c2 82
    first = "\u0102" + passage[1:]  # c4 82: the second byte of both is the same
    texts = [passage, "own \ufffd before, " + first + " after \ufffd \u00e9", "\ufffd"]
    made = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    given = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeats_stage(spark, given, "").collect()}
    assert left == {0: (passage, 53), 1: ("own \ufffd before,  after \ufffd \u00e9", 24), 2: ("\ufffd", 1)}


def test_mixing_stage_takes_copies(steps):
    copies = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(steps[3]).collect()}
    want = [r for r in rows(steps[3]) for _ in range(copies[r[0]])]
    assert rows(steps[4]) == want and set(copies.values()) <= {0, 1, 2}


def test_last_stage_has_the_ids(steps):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = steps[5].collect()
    assert sorted(map(repr, [[r[c] for c in NAMES] for r in last])) == sorted(repr(list(r)) for r in rows(steps[4]))
    assert all(r["ids"] == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in last)


def test_stages_take_repeated_rows_and_null_ids(spark, repeated_folder):
    assert corpus_pipeline.run(spark, repeated_folder).count() > 0
