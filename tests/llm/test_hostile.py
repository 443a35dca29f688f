"""Every operator on null ids, repeated rows, columns of clashing names, and one very long text."""

import collections
import time

import pytest

from lodestone.llm import html_text, line_dedup, minhash, mixing, packing, phrases, pii, quality, repeats, secrets, simhash

NAMES = ["doc", "row", "key", "found", "place", "bucket", "n", "size", "h", "word", "block", "part", "a.b", "_q_note", "entities", "gram", "line", "seq", "_1", "value", "nth", "Text2", "w` x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
#: Rows of documents, by the operators that return rows of documents.
WHOLE = {
    "mixed": mixing.mixed,
    "one_of_each": simhash.one_of_each,
    "accepted": quality.accepted,
    "redact": secrets.redact,
    "replaced": lambda df: pii.replaced(df, "k"),
    "deduplicated": line_dedup.deduplicated,
}
REPORTS = {
    "mixing": mixing.report,
    "repeats": repeats.report,
    "minhash": minhash.report,
    "packing": packing.pack,
    "simhash": simhash.report,
    "quality": quality.report,
    "secrets": secrets.report,
    "pii": lambda df: pii.report(df, "k"),
    "lines": line_dedup.report,
}
PROSE = "the quick brown fox of mr smith walks along a river and talks about every stone it meets on its long way home "


def hostile_rows():
    told = "Mrs. Ada Byron said token = \"abcdefabcdef0123\" to a@b.org. " + " ".join(f"w{i}" for i in range(80))
    rows = [(None, "null id " + " ".join(f"x{i}" for i in range(70))), (None, None), (5, told), (5, told), (6, told), (7, ""), (8, None), (-3, "negative " + " ".join(f"y{i}" for i in range(60))), (9, "\n \n"), (None, told)]
    return [(i, t, None if k % 3 else "en", [None, "", "a"][k % 3], None, *["clash"] * len(NAMES)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(hostile_rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("name", WHOLE)
def test_null_ids_and_clashing_columns_pass(hostile, name):
    out = WHOLE[name](hostile)
    assert set(hostile.columns) <= set(out.columns)
    rows = out.collect()
    assert rows and all(r[c] == "clash" for r in rows for c in NAMES)
    if name in ("redact", "replaced", "deduplicated"):
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in hostile_rows())


@pytest.mark.parametrize("name", REPORTS)
def test_reports_keep_null_ids(hostile, name):
    got = collections.Counter(r["doc_id"] for r in REPORTS[name](hostile).collect())
    want = collections.Counter(r[0] for r in hostile_rows())
    assert set(got) == set(want)
    if name != "packing":
        assert got == want


@pytest.mark.parametrize("name", [*REPORTS, "phrases", "html"])
def test_a_text_of_megabytes_is_taken_whole(spark, name):
    words = PROSE.split()
    long = "\n".join(" ".join(words[(i * 7 + j * (i % 13 + 1)) % len(words)] + str((i * j) % 97) for j in range(12)) for i in range(40_000))
    assert len(long) > 3_000_000
    rows = [(1, long, "en", "a", 1), (2, PROSE * 5, "en", "b", 1), (3, None, "en", "a", 1)]
    began = time.time()
    if name == "html":
        pages = spark.createDataFrame([(1, "u", "<body><article><p>" + long.replace("\n", "</p><p>") + "</p></article></body>")], "page_id long, url string, html string")
        assert html_text.extract(pages).first()["text"] == long.replace("\n", "\n\n")
    else:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = (phrases.mined if name == "phrases" else REPORTS[name])(docs).collect()
        if name == "phrases":
            assert any(r["a"] > 10 for r in got)
        else:
            assert {r["doc_id"] for r in got} == {1, 2, 3} or (name == "packing" and {r["doc_id"] for r in got} >= {1, 2})
        if name == "secrets":
            assert all(r["n_assign"] == 0 for r in got)
        if name in ("minhash", "pii"):
            assert next(r["n_chars"] for r in got if r["doc_id"] == 1) == len(long)
    assert time.time() - began < 150


@pytest.mark.parametrize("bad", ["eyJ" * 300_000, "eyJa." * 200_000, "-----BEGIN " * 90_000, "token=" * 150_000, "a:" * 400_000, "://" * 300_000, "f" * 900_000])
def test_secrets_are_searched_for_in_linear_time(spark, bad):
    docs = spark.createDataFrame([(1, bad)], "doc_id long, text string")
    began = time.time()
    assert secrets.report(docs).count() == 1
    assert time.time() - began < 40
