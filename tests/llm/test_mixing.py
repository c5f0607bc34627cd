"""Mixing sources against taking the draws one by one."""

import re
from collections import Counter

import numpy as np
import pytest

from batida.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def made(n=300):
    rows = []
    for k in range(n):
        rng = np.random.default_rng(k)
        source = ["web", "books", "code", "émile", "", None][int(rng.choice(6, p=[0.4, 0.2, 0.15, 0.15, 0.05, 0.05]))]
        rows.append((k, " ".join(f"w{k}x{i}" for i in range(int(rng.integers(0, 600)))) + "\n\t " * (k % 3), source))
    rows += [(None, "no id", "web"), (5, None, "web"), (6, "", "books"), (6, " \t ", None), (900, "tiny", "tiny")]
    return rows + [(7, "repeated rows of one source", "books")] * 40


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in made()], SCHEMA + ", size int, target string").repartition(7)


def source_sizes(rows):
    out = Counter()
    for _, text, source in rows:
        out[source] += len(WORDS.findall(text or ""))
    return dict(sorted(out.items(), key=lambda s: (s[0] is None, s[0] or "")))


def plain_targets(sizes):
    """By handing out the excess again and again."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    total = sum(sizes.values())
    out = {s: total * w / sum(weights.values()) for s, w in weights.items()}
    for _ in range(1000):
        over = {s for s in sizes if out[s] >= 3 * sizes[s]}
        excess = sum(out[s] - 3 * sizes[s] for s in over)
        open_ = sum(w for s, w in weights.items() if s not in over)
        out = {s: 3 * sizes[s] if s in over else out[s] + excess * weights[s] / open_ for s in sizes}
    return out


def test_shares(docs):
    rows, sizes = made(), source_sizes(made())
    want = plain_targets(sizes)
    got = mixing.shares(docs).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.size) for r in got), key=key) == sorted(((i, len(WORDS.findall(t or ""))) for i, t, _ in rows), key=key)
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in got:
        source = by_size[r.source_size]
        assert abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert taken.keys() == want.keys() and all(abs(taken[s] - t) < 0.5 + 1e-6 for s, t in want.items())
    assert any(abs(t - 3 * sizes[s]) < 1e-6 for s, t in want.items()) and len({r.taken for r in got}) > 10


def test_reruns_agree(spark, docs):
    key = lambda r: tuple(map(str, r))
    first = sorted(map(tuple, mixing.shares(docs).collect()), key=key)
    again = spark.createDataFrame([(*r, 1, "x") for r in reversed(made())], SCHEMA + ", size int, target string").repartition(2)
    assert sorted(map(tuple, mixing.shares(again).collect()), key=key) == first


@pytest.mark.parametrize("block", [3, 50])
def test_taken_is_what_the_mix_holds(docs, monkeypatch, block):
    """Counting the words of the mix itself: each text's words come as often as `taken` says, whole draws at a time."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "SHARD", 16)
    held = Counter()
    for r in mixing.mix(docs).collect():
        found = WORDS.findall(r.text)
        assert 0 < len(found) <= block and r.text == r.text.strip()
        held[(r.doc_id, r.source)] += len(found)
    taken, by_size = Counter(), {n: s for s, n in source_sizes(made()).items()}
    for r in mixing.shares(docs).collect():
        taken[(r.doc_id, by_size[r.source_size])] += r.taken
    assert held == {k: n for k, n in taken.items() if n}


def test_draws_against_the_quotas(spark):
    """Every number of a source is drawn once, blocks of a round are disjoint, shards are as large as told, and only the last draw is cut."""
    sizes = [("a", 10_007), ("b", 3_001), ("c", 12), ("d", 0), (None, 400)]
    plan = mixing.quotas(sizes, 8, 5)
    draws = mixing.drawn(spark, plan, 5).collect()
    shards = Counter(r.shard for r in draws)
    total = sum(q.draws for q in plan)
    n = -(-total // mixing.SHARD)
    assert [shards[k] for k in range(n)] == [total * (k + 1) // n - total * k // n for k in range(n)]
    for k, q in enumerate(plan):
        own = [r for r in draws if r.n_source == k]
        assert len(own) == q.draws and len({(r.round, r.block) for r in own}) == q.draws
        words = sum(r.cut or (8 if r.block < q.blocks - 1 else q.size - 8 * (q.blocks - 1)) for r in own)
        assert words == round(q.target) and sum(r.cut is not None for r in own) == (q.cut > 0)
    for shard in shards:
        assert sorted(r.place for r in draws if r.shard == shard) == list(range(shards[shard]))


def test_split_is_hypergeometric_and_the_same_in_any_task():
    counts, bounds = np.array([500, 300, 200, 0]), lambda k: 1000 * k // 8
    whole = [tuple(map(tuple, (own, begins))) for _, own, begins in mixing.split(counts, counts * 0, 0, 8, 0, 8, bounds, 1)]
    parts = [tuple(map(tuple, (own, begins))) for a in range(8) for _, own, begins in mixing.split(counts, counts * 0, 0, 8, a, a + 1, bounds, 1)]
    assert whole == parts
    assert np.array([own for own, _ in whole]).sum(0).tolist() == counts.tolist() and {sum(own) for own, _ in whole} == {125}
    first = np.array([next(mixing.split(counts, counts * 0, 0, 8, 0, 1, bounds, seed))[1] for seed in range(400)])
    assert np.allclose(first.mean(0), counts / 8, rtol=0.03)
    variance = 125 * 0.5 * 0.5 * (1000 - 125) / 999
    assert abs(first[:, 0].var() / variance - 1) < 0.25


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation(n):
    keys = mixing._round_keys(1, 2, 3)
    there = mixing.permuted(np.arange(n), n, keys)
    assert sorted(there.tolist()) == list(range(n))
    assert mixing.permuted(there, n, keys, back=True).tolist() == list(range(n))
    assert n < 64 or there.tolist() != list(range(n))


def test_long_texts_and_empty_tables(spark):
    assert mixing.shares(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in mixing.shares(spark.createDataFrame([(1, None, None), (None, "", "a")], SCHEMA)).orderBy("doc_id").collect()] == [(None, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]
    rows = [(1, "word " * 2_000_000, "a"), (2, "x" * 5_000_000, "b")]
    got = {r.doc_id: (r.size, r.taken) for r in mixing.shares(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2_000_000, 1_999_998), 2: (1, 3)}
