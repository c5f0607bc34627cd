"""Spelling variants against plain counting and comparing every pair of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from batida.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            out[word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    out, forms = {}, {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def made():
    stems = ["banana", "banane", "bananen", "canana", "ananas", "cafés", "cafes", "caféss", "Àgora", "àgora", "house", "houses", "mouse", "mouses", "moouse"]
    rows = []
    for k in range(400):
        rng = np.random.default_rng(k)
        text = " ".join(rng.choice(stems, 30, p=np.arange(1, 16) / 120))
        rows.append((k, text.upper() if k % 7 == 0 else text + "; don't-stop中" + text))
    rows += [(1000 + k, "kettle kettle kettle kettle kettle kettle kettl kettl" + " kettx" * (k % 2)) for k in range(20)]
    return rows + [(None, "House house HOUSE"), (5, None), (6, ""), (7, "1 2 3 ... ×÷×÷× ×÷×÷× ×÷×÷×")] + [(9, "repeated rows")] * 4


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in made()], "doc_id long, text string, n int, word string").repartition(5)


def test_whole_result(docs):
    want = expected(counted(made()))
    assert result(spelling.variants(docs)) == want
    assert {w[0] for w in want.values()} > {None} and max(v[3] for v in want.values()) > 3
    assert want["kettx"][:2] == ("kettl", "kettle")  # a chain of forms


def test_whole_tables(spark):
    """Every word of the smallest table of documents."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = expected(counted([tuple(r) for r in rows]))
    got = result(spelling.variants(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert got == want and len(want) > 1000


def test_slices_do_not_matter(docs, monkeypatch):
    want = result(spelling.word_counts(docs).selectExpr("word", "word form", "word root", "n", "n n_near", "n form_n"))
    monkeypatch.setattr(spelling, "SLICE", 50)
    assert result(spelling.word_counts(docs).selectExpr("word", "word form", "word root", "n", "n n_near", "n form_n")) == want


def test_a_small_filter_changes_nothing(docs, monkeypatch):
    """A filter that lets nearly everything pass gives the same pairs: the join decides."""
    monkeypatch.setattr(spelling, "LEAST_BITS", 64)
    monkeypatch.setattr(spelling, "MOST_BITS", 64)
    assert result(spelling.variants(docs)) == expected(counted(made()))


def test_long_words_and_texts(spark):
    """Words of 200 to 30,000 letters at one edit, in texts longer than a slice."""
    a, b = "ab" * 15_000, "ab" * 7_000 + "c" + "ab" * 8_000
    c, d = "x" * 100, "x" * 99 + "é"
    filler = "word " * 1_000_000
    rows = [(k, f"{a} {c} {a} {filler}{c} {a} {b}, {b}") for k in (1, 2)] + [(3, f"{a} {b} {d} {d} {d}"), (4, f"{b} {a} {a}")]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    words = counted(rows)
    assert {30_000, 30_001, 100} <= {len(w) for w in words}
    assert got == expected(words)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
