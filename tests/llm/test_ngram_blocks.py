"""Row blocks of the n-gram join: which pairs are multiplied, and that none is missed."""

import random

import pytest
from test_operators import linked, table

from batida.llm import ngram_join


def families(copies, n_families=10, seed=7):
    """Families of near copies of different lengths, all joined to one candidate group by a passage that they share."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(12)]
    rows = []
    for f in range(n_families):
        base = passage + [f"f{f}x{k}" for k in range(40 + 9 * f)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(12, len(w))] = f"y{r.randint(0, 99999)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


def blocks_of(spark, monkeypatch, rows):
    """The result of the join, the pairs of row blocks it multiplied, and how many there could be."""
    seen = []
    plain = ngram_join.block_pairs

    def noted(*args, **more):
        out = plain(*args, **more)
        own = args[1].select("component", "own").distinct().groupBy("component").count().collect()
        seen.append((out.count(), sum(r["count"] * (r["count"] + 1) // 2 for r in own)))
        return out

    monkeypatch.setattr(ngram_join, "block_pairs", noted)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.join(table(spark, rows)).collect()}
    monkeypatch.setattr(ngram_join, "block_pairs", plain)
    return got, *seen[0]


@pytest.mark.parametrize("copies", [3, 15, 40])
def test_alike_rows_share_blocks(spark, monkeypatch, copies):
    monkeypatch.setattr(ngram_join, "ROWS", 8)
    monkeypatch.setattr(ngram_join, "MET", 3)
    rows = families(copies)
    got, pairs, possible = blocks_of(spark, monkeypatch, rows)
    assert got == linked(rows, 3, 90)
    assert copies < 40 or pairs * 2 < possible  # a family of 40 is five or six blocks, so 15 to 21 pairs


def test_pairs_of_a_common_column_are_dealt(spark):
    """A column that 50 blocks have is paired by several tasks; sizes beyond the bound give no pair."""
    sig = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id long, sig long")
    dealt = spark.createDataFrame([(k, 0, k, 100 + 10 * k) for k in range(50)], "doc_id long, component long, own long, n_shingles long")
    want = {(a, b) for a in range(50) for b in range(a, 50) if 100 * (100 + 10 * a) >= 90 * (100 + 10 * b)}
    for most in (64, 7, 1):
        assert {(x.lo, x.hi) for x in ngram_join.block_pairs(sig, dealt, 90, most).collect()} == want


def test_rows_that_stand_for_copies(spark):
    """Copies, null ids, null and empty texts beside near copies, each with its own row."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(9, text), (4, text.upper()), (None, text), (None, text), (7, text + " more"), (7, None), (2, ""), (None, None), (1, " \t ")]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in ngram_join.join(table(spark, rows)).collect()), key=str)
    want = [(9, 58, 4, 2), (4, 58, 4, 2), (None, 58, None, 0), (None, 58, None, 0), (7, 59, 4, 2), (7, 0, 7, 0), (2, 0, 2, 0), (None, 0, None, 0), (1, 0, 1, 0)]
    assert got == sorted(want, key=str)
