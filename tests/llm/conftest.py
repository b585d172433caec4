import pyarrow as pa
import pyarrow.parquet as pq
import pytest

GIVEN = "/root/testdata/sf0.001"


def edge_rows(start):
    """Texts that operators meet rarely: null, empty, blank, long, odd characters, copies, repeats."""
    words = " ".join(f"w{i}" for i in range(120))
    passage = "this passage of more than fifty bytes stands in several documents at once"
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "one two three",
        "ONE two three",
        words,
        words,
        words.upper(),
        words + " end",
        passage,
        "before " + passage + " after",
        "é" * 60 + passage[:50] + "日本語" * 30,
        "  two  spaces\r\nand \x0b odd\x00 white space <|endoftext|> ▁▁x <s>",
        "x" * 3000,
        " ".join(f"long{i % 977}" for i in range(40_000)),
        "| a | b |\n| a | b |\n# * $ % &\n\n" * 40,
        "na " * 400,
    ]
    sources = [None, "src0", "src1", "", None] * 4
    return [(start + i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=False))]


def write_documents(path, rows, **extra):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))}
    columns |= {n: pa.array([v] * len(rows), pa.string()) for n, v in extra.items()}
    pq.write_table(pa.table(columns), path)


@pytest.fixture(scope="session")
def given_rows():
    table = pq.read_table(f"{GIVEN}/documents.parquet").to_pylist()
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table]


@pytest.fixture(scope="session")
def folder(tmp_path_factory, given_rows):
    """The smallest given documents and the edge rows, with columns whose names operators use themselves."""
    base = tmp_path_factory.mktemp("documents")
    rows = given_rows + edge_rows(10_000)
    clash = ["size", "slot", "shard", "ids", "kept", "n_words", "_row", "_rank", "node", "slice", "target", "bytes", "key"]
    write_documents(f"{base}/documents.parquet", rows, **{c: "clash" for c in clash})
    return str(base)


@pytest.fixture(scope="session")
def texts(given_rows):
    """(doc_id, text) of ``folder`` in order of id, null texts as empty."""
    return sorted((r[0], r[1] or "") for r in given_rows + edge_rows(10_000))


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("none")
    write_documents(f"{base}/documents.parquet", [])
    for name, columns in (("pages", ("page_id", "url", "html")), ("labels", ("doc_id", "quality", "toxic"))):
        kinds = {"page_id": pa.int64(), "doc_id": pa.int64(), "quality": pa.int64(), "toxic": pa.int64()}
        pq.write_table(pa.table({c: pa.array([], kinds.get(c, pa.string())) for c in columns}), f"{base}/{name}.parquet")
    return str(base)


@pytest.fixture(scope="session")
def repeated_folder(tmp_path_factory, given_rows):
    """Rows that occur several times, ids with several texts, and rows without an id."""
    base = tmp_path_factory.mktemp("repeated")
    rows = given_rows[:40]
    again = rows[:10] + [(rows[0][0], "another text under the same id " * 5, "en", "src0", 155)]
    nameless = [(None, *r[1:]) for r in rows[10:13]] + [(None, None, None, None, None)]
    write_documents(f"{base}/documents.parquet", rows + again + nameless)
    return str(base)


def by_id(df, key="doc_id"):
    found = {}
    for row in df.collect():
        assert row[key] not in found
        found[row[key]] = row
    return found
