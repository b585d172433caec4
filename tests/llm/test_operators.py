"""Operators on inputs made for one purpose."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sourceworks.llm import bpe, hosts, near, oracles, queries, registry, repeats, rules, shards, sketches, token_files, transducer
from sourceworks.llm.components import components
from sourceworks.llm.ranking import ranked
from sourceworks.llm.slices import id_marks, slice_of
from sourcechecks.compare import connect, differences

from .conftest import write_documents

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, FOLDER), connect(FOLDER), registry.ORACLES[name]) == []


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")


def test_ranks_of_a_hot_group(spark):
    df = spark.range(0, 3000, numPartitions=5).select((F.col("id") % 7 == 0).alias("cold"), (-F.col("id")).alias("k"))
    got = ranked(df, ["cold"], ["k"], "n", "all").collect()
    for cold in (True, False):
        members = sorted((r.k, r.n) for r in got if r.cold == cold)
        assert [n for _, n in members] == list(range(1, len(members) + 1))
        assert {r.all for r in got if r.cold == cold} == {len(members)}


@pytest.mark.parametrize("slices", [1, 2, 9, 50])
def test_slices_are_runs_of_ids(spark, slices):
    df = spark.range(0, 500, 3).withColumnRenamed("id", "doc_id")
    marks = id_marks(df, "doc_id", slices)
    got = df.withColumn("s", slice_of("doc_id", marks, len(marks))).orderBy("doc_id").collect()
    assert [r.s for r in got] == [sum(m <= r.doc_id for m in marks) for r in got]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    name = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in name:
        for a, b in links:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r.node: r.component for r in components(df).collect()} == name


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    for size, common in ((1, 1), (3, 2), (40, 32), (2000, 1000)):
        a = rng.integers(1, 2**63, size, dtype=np.uint64)
        b = np.concatenate([a[:common], rng.integers(1, 2**63, size - common, dtype=np.uint64)])
        x, y = near.similarity_sketch(np.unique(a), 512), near.similarity_sketch(np.unique(b), 512)
        assert x.max() < np.uint64(2**64 - 1)
        assert abs(float((x == y).mean()) - common / (2 * size - common)) < 0.12


def test_a_large_group_of_near_copies_and_its_outsiders(spark):
    pick = random.Random(3)
    base = [f"w{i}" for i in range(200)]

    def edited(count):
        words = list(base)
        for _ in range(count):
            words[pick.randrange(200)] = f"x{pick.random()}"
        return " ".join(words)

    texts = [edited(k % 14) for k in range(300)]
    found = {r.doc_id: r for r in near.near_copies(docs(spark, texts), 4).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    name = list(range(300))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                name[high] = low
    assert [found[i].component_id for i in range(300)] == [root(i) for i in range(300)]


def test_rules_fit_hosts_and_paths(spark):
    urls = ["http://a.example.net/en/x?q=/de/", "http://EXAMPLE.net", "http://example.net/", "http://badexample.com/de/", "x://example.com/de/1#a",
            "http://a.org/fr/", "http://a.org/fr", "nothing", None, "://", "http://h?a://b/c", "http://x.net/\n/y"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint")
    got = [r[1:5] for r in sorted(hosts.filter_urls(pages, labels).collect())]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("example.net", "/", "net/", "block"),
        ("badexample.com", "/de/", None, "allow"), ("example.com", "/de/1", "example.com/de/", "block"), ("a.org", "/fr/", "org/fr/", "allow"),
        ("a.org", "/fr", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
        ("x.net", "/\n/y", "net/", "block"),
    ]


def test_bad_hosts_are_blocked_and_unknown_ones_are_not(spark):
    made = [("bad.example.com", 1)] * 40 + [("good.example.com", 0)] * 40 + [("few.example.com", 1)] + [("other.org", 0)] * 40
    pages = spark.createDataFrame([(i, f"http://{h}/p", "") for i, (h, _) in enumerate(made)] + [(900, "http://new.example.com/", "")], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(made)] + [(0, None, None)], "doc_id bigint, quality bigint, toxic bigint")
    verdicts = {r.host: r.verdict for r in hosts.filter_urls(pages, labels).collect()}
    assert verdicts == {"bad.example.com": "block", "good.example.com": "allow", "few.example.com": "allow", "other.org": "allow", "new.example.com": "allow"}


def sql_rows(folder, name, *tables):
    """Rows of a query's SQL over the tables of a folder."""
    with duckdb.connect() as db:
        for table in tables:
            db.execute(f"create view {table} as from '{folder}/{table}.parquet'")
        return db.execute(registry.ORACLES[name]).fetchall(), [d[0] for d in db.description]


def same_as_sql(spark, folder, name, *tables):
    expected, columns = sql_rows(folder, name, *tables)
    found = registry.QUERIES[name](spark, folder).select(*columns).collect()
    assert Counter(map(tuple, found)) == Counter(expected)
    return [dict(zip(columns, r, strict=True)) for r in expected]


def test_reputation_decides_as_in_sql(spark, tmp_path):
    """Sites of many levels, addresses, users and ports; repeated and null ids; columns that clash."""
    made, labels = [], []

    def pages(host, count, bad, known=True):
        for k in range(count):
            made.append((len(made), f"http://{host}/p{k}"))
            if known:
                labels.append((len(made) - 1, 0 if k < bad else 1, 0))

    for k in range(25):
        pages(f"good{k}.example.org", 20, 1)
        pages(f"site{k}.co.uk", 20, k % 3)
    pages("spam.example.org", 30, 28)
    pages("user:pw@SPAM.example.org:8080", 5, 0, known=False)
    pages("spam.example.org.", 2, 0, known=False)
    pages("bad.co.uk", 30, 30)
    pages("www.bad.co.uk", 4, 0, known=False)
    pages("co.uk", 2, 0, known=False)
    pages("10.0.0.1", 30, 29)
    pages("10.0.0.2:81", 30, 0)
    pages("[::1]:80", 3, 0, known=False)
    pages("new.example.org", 2, 0, known=False)
    made += [made[0], made[0], (None, "http://spam.example.org/x"), (None, None)]
    names = {"host": "clash", "rule": "clash", "verdict": "clash", "site": "clash", "domain": "clash"}
    table = pa.table({"page_id": pa.array([i for i, _ in made], pa.int64()), "url": [u for _, u in made], "html": [""] * len(made)})
    for name, value in names.items():
        table = table.append_column(name, pa.array([value] * len(made)))
    pq.write_table(table, f"{tmp_path}/pages.parquet")
    ids, quality, toxic = zip(*[*labels, labels[3], (None, 0, 1), (5, None, None)], strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": quality, "toxic": toxic}), f"{tmp_path}/labels.parquet")
    verdicts = {}
    for row in same_as_sql(spark, str(tmp_path), "op5_host_reputation", "pages", "labels"):
        verdicts.setdefault(row["host"], set()).add(row["verdict"])
    assert all(len(v) == 1 for v in verdicts.values())
    blocked = {h for h, v in verdicts.items() if v == {"block"}}
    assert blocked == {"spam.example.org", "user:pw@spam.example.org:8080", "spam.example.org.", "bad.co.uk", "www.bad.co.uk", "10.0.0.1"}


def test_levels_of_sites(spark):
    names = ["a.b.example.org", "example.org", "org", "x.y.co.uk", "co.uk", "10.0.0.1", "[::1]", "", "notco.uk", "1.2.3.4.5"]
    domain, suffix = hosts.site_levels("s")
    found = spark.createDataFrame([(n,) for n in names], "s string").select("s", domain.alias("d"), suffix.alias("x")).collect()
    assert [tuple(r)[1:] for r in found] == [
        ("example.org", "org"), ("example.org", "org"), ("org", "org"), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"),
        ("10.0.0.1", ""), ("[::1]", ""), ("", ""), ("notco.uk", "uk"), ("4.5", "5"),
    ]


def test_common_lines_decide_as_in_sql(spark, tmp_path):
    """Lines of 100 and of 101 texts; copies of a text vouch once; sources of any size, none among them."""
    own = lambda k, n: " ".join(f"d{k}w{i}" for i in range(n))
    rows = []
    for source, holders, others in (("a", 101, 0), ("b", 100, 0), ("c", 130, 900), (None, 101, 5), ("", 100, 5)):
        notice = " ".join(f"notice{i}" for i in range(60))
        made = [f"{own(f'{source}{k}', 40)}\n {notice.upper()}  end" for k in range(holders)]
        made += [f"{own(f'{source}{k}', 55)}\n{own(f'x{source}{k}', 9)}" for k in range(holders, holders + others)]
        rows += [(len(rows) + i, t, "en", source, 0) for i, t in enumerate([*made, made[0], made[0]])]
    write_documents(f"{tmp_path}/documents.parquet", rows, kept="clash", host="clash")
    found = same_as_sql(spark, str(tmp_path), "op8_line_frequency", "documents")
    kept = Counter((rows[r["doc_id"]][3], r["kept"]) for r in found)
    assert kept == {("a", False): 103, ("b", True): 102, ("c", False): 132, ("c", True): 900, (None, False): 103, (None, True): 5, ("", True): 107}
    assert not any(r["base_failed"] for r in found)


def test_a_line_of_many_texts_is_common_in_a_large_source(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))), " ")
    text = F.when(F.col("id") % 20 == 0, F.concat(words, F.lit("\nShared by five thousand texts"))).otherwise(words)
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("src0").alias("source"))
    left = rules.quality_rules(df).groupBy("kept", (F.col("n_words") - F.col("n_left")).alias("gone")).count().collect()
    assert {(r.kept, r.gone): r["count"] for r in left} == {(True, 0): 95_000, (True, 5): 5_000}


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    half = " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(496, 1000))
    df = spark.createDataFrame([(text, *half)], "t string, a string, b string")
    for column in "tab":
        df = sketches.with_sketch(df, F.col(column), f"s_{column}")
    row = df.select(
        (sketches.merged(F.col("s_a"), F.col("s_b")) == F.col("s_t")).alias("same"),
        sketches.containment(F.col("s_a"), F.col("s_t")).alias("inside"),
        sketches.distinct_shingles(F.col("s_t")).alias("count"),
    ).first()
    assert row.same and row.inside > 0.8 and abs(row["count"] - 996) < 300


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda k, n: " ".join(f"d{k}w{i}" for i in range(n))
    notice = " ".join(f"notice{i}" for i in range(60))
    made = [f"{own(k, 100)}\n  {notice.upper()}\t" for k in range(30)] + [f"{own(99, 20)}\n{notice}", own(100, 80)]
    df = docs(spark, made + made[:5]).withColumn("n_left", F.lit("clash"))
    got = sorted(rules.quality_rules(df, most_documents=20).collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in got] == [True] * 30 + [False, True] + [True] * 5
    assert got[0].text == own(0, 100) and got[31].text == own(100, 80)
    assert got[30].n_left == 20 and not got[30].base_failed


def test_many_repeated_windows_are_counted_by_sorting(spark):
    words = [f"v{i % 300}" for i in range(900)] + ["end"]
    row = rules.quality_rules(docs(spark, [" ".join(words)]), carry=["doc_id"]).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (901, 900, True)


def test_token_files_answer_for_one_document(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs(spark, ["a b", None, "c"] * 20), path, public_tokenizers.path("word_bpe_49k.json"))
    one = token_files.read_tokens(spark, path).where("doc_id = 31")
    assert one.first().ids == [1] and "GreaterThan" not in str(one) and one.first().start == sum(
        r.n_tokens for r in token_files.read_metadata(spark, path).where("doc_id < 31").collect()
    )
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    filtered = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,31)" in filtered


def test_encoding_and_decoding_as_columns(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    given_docs = docs(spark, ["héllo  wörld\n", None, ""]).withColumn("bytes", F.lit("clash"))
    encoded = bpe.encode_texts(given_docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode_ids(encoded, ranks, public_tokenizers.PATTERN)
    assert [bytes(r.bytes).decode() for r in decoded.orderBy("doc_id").collect()] == ["héllo  wörld\n", "", ""]
    trips = bpe.round_trips(given_docs, ranks, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r.ids for r in trips] == [r.ids for r in encoded.orderBy("doc_id").collect()]


def test_counts_of_any_text():
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        counter = transducer.Counter(file.read())
    library = SentencePieceProcessor(model_file=path)
    pick = random.Random(7)
    pieces = [library.id_to_piece(i) for i in range(0, 32000, 7)]
    texts = ["".join(pick.choices(" \n\tab's1é日́▁", k=pick.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(pick.choices(pieces, k=8)) for _ in range(3000)] + ["x" * 5000, "ab" * 700 + " " * 300]
    assert counter.counts(texts).tolist() == [len(i) for i in library.encode(texts)]


def test_shards_match_the_mixture(spark):
    made = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 40))").alias("source"))
    placed = shards.interleaved_shards(made, 24)
    counts = {(r.shard, r.source): r["count"] for r in placed.groupBy("shard", "source").count().collect()}
    assert all(abs(counts[k, "hot"] - 1600 / 24) <= 3 for k in range(24))
    again = {(r.doc_id, r.shard, r.slot) for r in shards.interleaved_shards(made.repartition(7), 24).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


def test_passages_over_block_ends(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    pick = random.Random(1)
    passage = bytes(pick.randrange(97, 123) for _ in range(120))
    texts = [bytes(pick.randrange(97, 123) for _ in range(pick.randrange(0, 200))) + passage[pick.randrange(60) :] for _ in range(30)]
    monkeypatch.setattr(repeats, "SORTED", 100)
    suffixes = repeats.Suffixes(texts, np.arange(30))
    gone = repeats.removed_bytes(suffixes.size, suffixes.later_here())
    seen, want = set(), []
    for text in texts:
        covered = [False] * len(text)
        for i in range(len(text) - 49):
            if text[i : i + 50] in seen:
                covered[i : i + 50] = [True] * 50
        seen.update(text[i : i + 50] for i in range(len(text) - 49))
        want += covered
    assert gone.tolist() == want and any(want)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 50])
def test_different_passages_of_one_64_bit_print_stay(spark, slice_bytes):
    tail = b"xlwznpldpfpcnpclvvpexoxporqvinapvd"
    pair = [b"yuyncopuejszncrr" + tail, b"dpyavmpfowY<:-v|" + tail]
    prints = [repeats._prints(repeats._words(np.frombuffer(p + bytes(8), dtype=np.uint8), 50), np.array([0]), 50, 3, 4) for p in pair]
    assert prints[0][0] == prints[1][0] and prints[0][1] != prints[1][1]
    texts = [p.decode() for p in [*pair, pair[0], pair[1]]]
    found = repeats.repeat_digests(docs(spark, texts), slice_bytes=slice_bytes, range_bytes=50).collect()
    assert {r.doc_id: r.n_removed for r in found} == {0: 0, 1: 0, 2: 50, 3: 50}


@pytest.mark.parametrize("part", [7, 1000])
def test_previous_factors_by_smaller_positions(monkeypatch, part):
    """Suffix order, shared lengths and longest previous factors against comparing all pairs."""
    monkeypatch.setattr(repeats, "SORTED", part)
    pick = random.Random(part)
    raw = np.frombuffer(bytes(pick.choice(b"ab\0") for _ in range(60)) * 5 + bytes(120), dtype=np.uint8)
    at = np.array(sorted(pick.sample(range(320), 250)))
    ranks = at // 40
    windows = {int(i): raw[i : i + 50].tobytes() for i in at}
    order = []
    for places, common in repeats.suffix_order(raw, at):
        factors = repeats.previous_factors(places // 40, common)
        for k, i in enumerate(places.tolist()):
            earlier = any(windows[j] == windows[i] and j // 40 < i // 40 for j in windows)
            assert (factors[k] >= 50) == earlier
        order += places.tolist()
    assert sorted(order) == at.tolist() and len(ranks) == len(order)
    assert [windows[i] for i in order] == sorted(windows.values())


def test_repeats_of_an_id_that_fills_slices(spark):
    """Many rows of one id, and of none: they are dealt over slices, and don't remove from each other."""
    passage = "passage of the corpus that is longer than fifty bytes in all, "
    made = [(5, f"{passage}{i} {i * 7919} own words") for i in range(60)] + [(None, f"{i}{passage}") for i in range(60)]
    made += [(1, "no such thing"), (9, f"x {passage}"), (3, f"{passage} first"), (4, None)]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    found = repeats.repeat_digests(df, slice_bytes=700, range_bytes=300)
    removed = sorted(((r.doc_id, r.n_removed) for r in found.collect()), key=str)
    size = len(passage)
    assert removed == sorted([(5, size)] * 60 + [(None, size)] * 60 + [(1, 0), (9, size), (3, 0), (4, 0)], key=str)


def test_stems_with_many_contexts_are_split(spark):
    pick = random.Random(8)
    word = lambda n: "".join(pick.choice("abcdef") for _ in range(n))
    common, tails = word(40), [word(30) for _ in range(20)]
    texts = [f"{word(12)}{common}{pick.choice(tails)}{word(5)}" for _ in range(80)]
    whole = {r.doc_id: r for r in repeats.repeat_digests(docs(spark, texts), slice_bytes=300, range_bytes=200).collect()}
    split = {r.doc_id: r for r in repeats.repeat_digests(docs(spark, texts), slice_bytes=300, range_bytes=200, many=-1000).collect()}
    seen = set()
    for i, text in enumerate(texts):
        covered = {k for j in range(len(text) - 49) if text[j : j + 50] in seen for k in range(j, j + 50)}
        seen.update(text[j : j + 50] for j in range(len(text) - 49))
        assert whole[i] == split[i] and whole[i].n_removed == len(covered)


def test_sql_is_there_where_it_can_be():
    expressed = {"op5_host_reputation", "op8_line_frequency", "op9_systematic_mix", "op11_collocations", "op12_line_dedup"}
    assert set(registry.ORACLES) == expressed
    assert oracles.OP9


def same_ids(encoder, library, texts):
    ids, counts = encoder.encode([t.encode() for t in texts])
    expected = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for some in expected for i in some]


@pytest.mark.parametrize("limit", [300, 800_000])
def test_token_ids_of_any_text(limit):
    """Every code point around the marks at which texts are cut, letters that compose, special tokens; also with a short memory."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        encoder = token_files.ChunkEncoder(file.read(), limit)
    assert encoder.cuts
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000][:: 1 if limit == 300 else 7]
    for shape in ("{0}. x", "a{0}, x", "x.{0} x", "A{0}H{0} a,{0}", "a={0}'s{0}t É{0}", "ö{0}-é${0}"):
        for start in range(0, len(points), 5000):
            same_ids(encoder, library, [shape.format(c) for c in points[start : start + 5000]])
    pick = random.Random(limit)
    odd = ["İ", "̱", "́", "̇", "क़", "ড়", "é", "É", "ẖ", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x01", "\x00", "²", "'s", "'LL", "Σ", "ß", "ÿ", "\x1c", "\x85"]
    alphabet = [*"abAHhKI.,;:!?'st1=_-$<|>  \n\t\r\x0b\x0c", *odd, "\u0338", "À", "Þ", "×", "÷", "ö"]
    for _ in range(10):
        same_ids(encoder, library, ["".join(pick.choice(alphabet) for _ in range(pick.randrange(60))) for _ in range(1500)])


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        encoder = token_files.ChunkEncoder(file.read())
    assert not encoder.cuts
    same_ids(encoder, Tokenizer.from_file(path), ["A text, with. marks", "", " two  spaces\n<|endoftext|>"])


def test_folding_in_spark_gives_the_same_ids(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = docs(spark, ["the cat's hat", "", "  été 12", "é"]).withColumn("text", F.expr("if(doc_id = 1, null, text)"))
    found = {r.doc_id: r.ids for r in bpe.fold_texts(df, ranks, public_tokenizers.PATTERN).collect()}
    assert found == {r.doc_id: r.ids for r in bpe.encode_texts(df, ranks, public_tokenizers.PATTERN).collect()}
