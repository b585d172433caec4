"""Phrases, shared lines and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sourceworks.llm import collocations, line_dedup, periodic_runs
from sourceworks.llm.queries import QUERIES

from .conftest import by_id, write_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def named(prefix):
    return QUERIES[next(q for q in QUERIES if q.startswith(prefix))]


@pytest.fixture(scope="session")
def phrase_rows(given_rows):
    """Given texts, and texts over few words, in several languages and with odd pieces."""
    rng = random.Random(5)
    rows = list(given_rows)
    for i in range(900):
        words = [rng.choice(["New", "york", "city", "café", "a\x1cb", "x", "new", "日本"]) for _ in range(rng.randrange(40))]
        marks = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in words]
        lang = rng.choice(["en", "en", None, "und", "xx"])
        rows.append((50_000 + i, "".join(w + m for w, m in zip(words, marks, strict=True)), lang, None, 0))
    return [*rows, (60_000, None, "en", None, 0), (60_001, "", None, None, 0), (None, "new york " * 70, "en", "s", 3)]


@pytest.fixture(scope="session")
def phrase_folder(tmp_path_factory, phrase_rows):
    base = tmp_path_factory.mktemp("phrases")
    write_documents(f"{base}/documents.parquet", phrase_rows, rank="clash", phrase="clash", block="clash", n="clash", word="clash")
    return str(base)


def brute_phrases(rows, least=30, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        covered = set()
        for longer, f in candidates.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    if 100 * f >= 80 * found[longer[i : i + k]]:
                        covered.add(longer[i : i + k])
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                cuts = [(2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def test_collocations(spark, phrase_folder, phrase_rows):
    found = named("op11_")(spark, phrase_folder)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute_phrases(phrase_rows)
    assert sorted(map(tuple, found.collect())) == expected
    assert {r[0] for r in expected} >= {"en", "und", "xx"}
    assert {len(r[2].split(" ")) for r in expected} == {2, 3, 4}


def test_collocations_over_many_blocks(spark, phrase_folder, phrase_rows):
    docs = spark.read.parquet(f"{phrase_folder}/documents.parquet")
    found = collocations.collocations(docs, least=8, top=50, block_bytes=3000, range_bytes=20_000)
    assert sorted(map(tuple, found.collect())) == brute_phrases(phrase_rows, 8, 50)


def test_occurrences_are_packed_without_loss():
    for numbers in ([], [-1], [5], [1 << 40, -1, -1, -1, 3], [-1, -1, 7, 7, -1]):
        kept = [n for i, n in enumerate(numbers) if n >= 0 or i + 1 == len(numbers) or numbers[i + 1] >= 0]
        back = collocations._unpacked(collocations._packed(np.array(numbers, dtype=np.int64))).tolist()
        assert [n for n in back if n >= 0] == [n for n in kept if n >= 0]
        assert [(a, b) for a, b in zip(back, back[1:], strict=False) if a >= 0 and b >= 0] == [
            (a, b) for a, b in zip(numbers, numbers[1:], strict=False) if a >= 0 and b >= 0
        ]


def line_rows():
    shared = "This Line stands in several documents"
    rng = random.Random(3)
    common = [f"common line number {i} of the corpus" for i in range(40)] + ["é" * 19, "é" * 20, "日" * 20, "short"]
    rows = [
        (1, shared, "en", None, 0),
        (2, f"  {shared.upper()}\t\r\nown line that is long enough", "en", None, 0),
        (3, f"{shared}\n{shared}\n{shared}", "en", None, 0),
        (7, f"last\n{shared}\nlast\n{shared}", "en", None, 0),
        (8, "", "en", None, 0),
        (9, None, "en", None, 0),
        (10, "\n\n", "en", None, 0),
        (11, "only two documents hold this line", "en", None, 0),
        (12, "only two documents hold this line", "en", None, 0),
        (13, "only one document has this line\nonly one document has this line\nonly one document has this line", "en", None, 0),
    ]
    for i in range(300):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.random()} of one document" for _ in range(rng.randrange(12))]
        rows.append((100 + i, "\n".join(lines), "en", None, 0))
    return rows


def brute_lines(rows, least=3, chars=20):
    def keys(text):
        return [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")]

    held = defaultdict(list)
    for doc_id, text, *_ in rows:
        for key in set(keys(text)):
            if len(key) >= chars:
                held[key].append(doc_id)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text), strict=True) if k not in last or last[k] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_shared_lines(spark, tmp_path, folder, given_rows):
    from .conftest import edge_rows

    rows = line_rows()
    write_documents(f"{tmp_path}/documents.parquet", rows, lines="clash", key="clash", last="clash")
    found = named("op12_")(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == brute_lines(rows)
    found = named("op12_")(spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == brute_lines(given_rows + edge_rows(10_000))


def test_shared_lines_with_repeated_rows_and_null_ids(spark, tmp_path):
    line = "a line of documents without an id"
    rows = line_rows()[:10] * 2 + [(None, line, "en", None, 0)] * 3 + [(None, None, "en", None, 0)] * 3
    write_documents(f"{tmp_path}/documents.parquet", rows)
    found = named("op12_")(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == brute_lines(rows)


@pytest.mark.parametrize("least", [2, 5])
def test_shared_lines_with_full_filters(spark, tmp_path, monkeypatch, least):
    """Filters that are far too small let more lines through to the comparison; the result is the same."""
    rows = line_rows()
    write_documents(f"{tmp_path}/documents.parquet", rows)
    monkeypatch.setattr(line_dedup, "SUSPECT_BITS", (16, 16))
    monkeypatch.setattr(line_dedup, "SEGMENT_LINES", 50)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, line_dedup.line_digests(docs, least).collect()), key=str) == brute_lines(rows, least)


def test_filter_holds_every_suspect(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50_000)
    table = spark.createDataFrame([(int(h),) for h in hashes], "hash bigint")
    filter_ = line_dedup._suspect_filter(table)
    assert line_dedup._in_filter(hashes.view(np.uint64), filter_).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 50_000).view(np.uint64)
    assert line_dedup._in_filter(others, filter_).mean() < 0.05


def brute_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            n, kinds = rng.randrange(0, 400), rng.choice([1, 2, 3, 5, 50])
            words = [str(rng.randrange(kinds)) for _ in range(n)]
            for _ in range(rng.randrange(0, 4)):
                if n > 2:
                    a = rng.randrange(n)
                    p, length = rng.randrange(1, max(2, (n - a) // 2 + 1)), rng.randrange(1, n - a + 1)
                    for i in range(a + p, min(n, a + length)):
                        words[i] = words[i - p]
            texts.append(words)
        found, collapsed = periodic_runs.text_runs([" ".join(w).encode() for w in texts])
        for words, runs, left in zip(texts, found, collapsed, strict=True):
            expected = brute_runs(words)
            assert [tuple(r) for r in runs.tolist()] == expected
            gone = {i for s, length, q in expected for i in range(s + q, s + length)}
            assert left.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_long_texts():
    rng = random.Random(2)
    once = [str(rng.randrange(1000)) for _ in range(3000)]
    twice = [str(rng.randrange(100_000)) for _ in range(60_000)]
    for words, expected in (
        (["a"] * 100_000, [(0, 100_000, 1)]),
        (["a", "b"] * 50_000 + ["c"], [(0, 100_000, 2)]),
        (once * 20, [(0, 60_000, 3000)]),
        (["x"] + twice * 2, [(1, 120_000, 60_000)]),
    ):
        found, _ = periodic_runs.text_runs([" ".join(words).encode()])
        assert [tuple(r) for r in found[0].tolist()] == expected


def test_both_ways_of_convolving_agree():
    rng = np.random.default_rng(3)
    codes = np.concatenate([np.tile(rng.integers(0, 3, 45), 8), rng.integers(0, 2, 500), np.arange(10, 400)])
    for low in (32, 64):
        at = np.arange(0, 700, low // 2)
        exact = set(zip(*map(np.ndarray.tolist, periodic_runs._term_by_term(codes, at, low // 2, low)), strict=True))
        assert exact == set(zip(*map(np.ndarray.tolist, periodic_runs._by_transform(codes, at, low // 2, low)), strict=True))
        assert low != 32 or exact


def test_run_query(spark, folder, texts):
    found = by_id(named("op13_")(spark, folder))
    planted = 0
    for doc_id, text in texts:
        words, h = WORD.findall(text), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        row = found[doc_id]
        if n > 5000:
            continue
        runs = brute_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(row)[:6] == (doc_id, len(runs), *best, milli)
        assert row["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert row["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert planted
