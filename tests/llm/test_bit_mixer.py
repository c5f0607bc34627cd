"""Running text coded bit by bit: counts of nodes, their way to a block, chances of all words, and whole scores."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from batida.llm import bit_mixer, lang_model


def counted(seed: int, words: int, tokens: int, hot_share: float):
    """Nodes of one text of random words, with every pair of words among its pairs, and what is told of them."""
    rng = np.random.default_rng(seed)
    names = np.sort(rng.integers(0, 1 << 63, words, np.uint64) * np.uint64(2))
    names[1] = names[0] + np.uint64(1)  # one path
    text = np.minimum(rng.geometric(0.1, tokens), words) - 1
    every = np.indices((words, words)).reshape(2, -1)
    before, token = np.r_[0, text[:-1], every[0]], np.r_[text, every[1]]
    learned = np.arange(len(token)) < tokens
    nodes = bit_mixer.Nodes(names, token, before, learned, rng.random(words) < hot_share, 3)
    return names, before[:tokens], text, nodes, bit_mixer.answers(nodes.keys, nodes.counts)


@pytest.mark.parametrize("hot_share", [0.0, 0.5, 1.0])
def test_numbers_of_nodes(hot_share):
    """The number at each bit stands for the plain counts of training tokens that share the bits before it, and with it."""
    names, before, text, nodes, codes = counted(1, 40, 3000, hot_share)
    first = np.searchsorted(nodes.keys >> np.uint64(46), np.unique(nodes.keys >> np.uint64(46)))
    parts = [bit_mixer.packed(c, k) for c, k in zip(np.split(codes, first[1:], 1), np.split(nodes.keys, first[1:]), strict=True)]
    cells = nodes.cells(bit_mixer.unpacked(parts, first, nodes.keys))
    path = [f"{p:024b}" for p in bit_mixer.paths(names).tolist()]
    alone, after = collections.Counter(), collections.Counter()
    for w, t in zip(before.tolist(), text.tolist(), strict=True):
        for d in range(25):
            alone[path[t][:d]] += 1
            after[w, path[t][:d]] += 1
    pairs = sorted({(w, t) for w in range(40) for t in range(40)})
    assert len(cells) == len(pairs)
    for (w, t), row in zip(pairs, cells.tolist(), strict=True):
        for d, cell in enumerate(row):
            a, b = path[t][:d], path[t][: d + 1]
            want = bit_mixer.coded(np.array([alone[b], after[w, b]]), np.array([alone[a], after[w, a]])).tolist()
            assert list(divmod(cell, bit_mixer.CODES)) == want


def test_chances_of_all_words_add_up():
    """After any word and in any state, known words have all of the chance, before and after the mixer has learned."""
    names, _, text, nodes, codes = counted(2, 60, 5000, 0.5)
    first = np.searchsorted(nodes.keys >> np.uint64(46), np.unique(nodes.keys >> np.uint64(46)))
    parts = [bit_mixer.packed(c, k) for c, k in zip(np.split(codes, first[1:], 1), np.split(nodes.keys, first[1:]), strict=True)]
    cells = nodes.cells(bit_mixer.unpacked(parts, first, nodes.keys))
    count = np.bincount(text, minlength=60)
    path = bit_mixer.paths(names)
    share = count / np.maximum([count[path == p].sum() for p in path], 1)
    mixer = bit_mixer.Mixer()
    for _ in range(3):
        for state in range(len(bit_mixer.STATES) + 1):
            chance = np.exp(mixer.chances(state)[cells].sum(1)).reshape(60, 60)
            assert np.allclose((chance * share)[:, count > 0].sum(1), 1, atol=1e-4)
            mixer.learn(state, np.bincount(mixer.without[cells[::7]].ravel(), minlength=bit_mixer.CODES**2))


@pytest.mark.parametrize("share, best", [(0.9, -0.71), (0.0, -3.91)])
def test_mixer_learns_whom_to_trust(share, best):
    """Tokens that nothing was learned from are predicted about as well as can be, whether the word before tells the next one or nothing."""
    words, n = 50, 24_000
    rng = np.random.default_rng(3)
    follow = rng.permutation(words)
    text = np.zeros(n, np.int64)
    for k in range(1, n):
        text[k] = follow[text[k - 1]] if rng.random() < share else rng.integers(words)
    names = rng.integers(0, 1 << 63, words, np.uint64) * np.uint64(2)
    learned = np.arange(n) < 18_000
    nodes = bit_mixer.Nodes(names, text, np.r_[0, text[:-1]], learned, np.zeros(words, bool), 1)
    cells = nodes.cells(bit_mixer.unpacked([bit_mixer.packed(bit_mixer.answers(nodes.keys, nodes.counts), nodes.keys)], np.array([0]), nodes.keys))
    got = bit_mixer.scored(cells, nodes.pair, np.array([0]), np.array([n]), learned)[18_000:].mean()
    untaught = bit_mixer.scored(cells, nodes.pair, np.array([0]), np.array([n]), np.zeros(n, bool))[18_000:].mean()
    assert best - 0.15 < got < best + 0.1 and got > untaught


def test_running_text_is_coded(spark, monkeypatch):
    """A held-out text in the order of a training text is likelier than its words in another order; the ways of counts change nothing."""
    r = random.Random(11)
    words = [f"{a}{b}{c}{d}" for a in "klmnprst" for b in "aeiou" for c in "nrstlmkp" for d in "aeiou"]
    texts = {i: [r.choice(words) for _ in range(60)] for i in range(200)}
    held = [i for i in range(200, 500) if zlib.crc32(str(i).encode()) % 10 == 0]
    source = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 10)
    texts |= {held[0]: list(texts[source]), held[1]: r.sample(texts[source], 60), held[2]: [], 600: ["Q" * 3000], 601: ["ka"]}

    def scores(texts, **sizes):
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
        return {x.doc_id: x for x in lang_model.score(docs, running=True, **sizes).collect()}

    out = scores(texts, block_bytes=9000)
    assert len(out) == len(texts) and all(x.score < 0 and np.isfinite(x.score) for x in out.values())
    assert out[held[0]].score > 0.8 * out[held[1]].score
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    same = ("held_out", "n_tokens", "n_known", "train_tokens", "n_bytes")
    for x in lang_model.score(docs).collect():
        assert all(x[c] == out[x.doc_id][c] for c in same) and abs(x.base_score - out[x.doc_id].base_score) < 1e-9
    monkeypatch.setattr(lang_model, "frequent", lambda docs, total: np.array([xxhash.xxh3_64_intdigest(w) for w in (b"", *(x.encode() for x in words))], np.uint64))
    hot = scores(texts, block_bytes=9000)
    assert all(abs(hot[i].score - out[i].score) < 1e-6 for i in out)


def test_no_text_to_learn_from(spark):
    """A table of held-out texts alone has finite scores and no known token."""
    docs = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    out = lang_model.score(docs, running=True).collect()
    assert out and all(x.n_known == x.train_tokens == 0 and np.isfinite(x.score) and x.score < 0 for x in out)


def test_blocks_go_as_tokens():
    """Blocks hold all rows once, in order; their tokens take less than half the room of their texts and give the words back."""
    r = random.Random(4)
    texts = [None, "", "Ka\x0blo KA", *(" ".join("".join(r.choice(("ka", "lo", "mi", "tu", "ven")) for _ in range(r.randint(1, 6))) for _ in range(300)) for _ in range(60))]
    rows = pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string()), "held": [i % 3 == 0 for i in range(len(texts))], "language": pa.array([i % 2 for i in range(len(texts))], pa.int32())})
    blocks = list(lang_model.cut_into_blocks(rows.to_batches(max_chunksize=7), 20_000))
    assert 2 < len(blocks) < 30 and pa.concat_tables(blocks).equals(rows)
    for block in [rows, *blocks]:
        payload = lang_model.packed_texts(block)
        t = lang_model.Texts(payload, 3, True)
        own = [(x or "").encode().lower().split() + [b""] for x in block.column("text").to_pylist()]
        assert [t.words[k] for k in t.tokens] == [w for x in own for w in x] and t.sizes.tolist() == [len(x) for x in own] and t.words[t.end] == b""
        assert t.rows.column("doc_id").to_pylist() == block.column("doc_id").to_pylist() and t.counts(2).sum() == sum(len(x) for x, h in zip(own, t.held, strict=True) if not h)
    assert len(lang_model.packed_texts(rows)) < sum(len(x or "") for x in texts) / 2


@pytest.mark.parametrize("width", [8, 40, 63, 64])
def test_distinct(width):
    """Distinct values and places are those of np.unique, whether or not the places fit below the values."""
    values = np.random.default_rng(width).integers(0, 1 << width, 5000, np.uint64, endpoint=False) if width < 64 else np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)
    values = np.r_[values, values[:900], values[:50] ^ np.uint64(1)]
    for part in (values, values[:1], values[:0]):
        for a, b in zip(bit_mixer.distinct(part), np.unique(part, return_inverse=True), strict=True):
            assert np.array_equal(a, b)


def test_known_words_are_not_spelled(spark, monkeypatch):
    """Only words that no training text has are spelled where running text is coded."""
    texts = {i: f"ka lo mi x{i}" for i in range(60)}
    held = {f"x{i}" for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plain = {x.doc_id: x for x in lang_model.score(docs, running=True).collect()}
    # a speller that refuses known words
    real = lang_model.spelled

    def spelled(words, *rest):
        assert {w.decode() for w in words} <= held, words
        return real(words, *rest)

    monkeypatch.setattr(lang_model, "spelled", spelled)
    out = {x.doc_id: x for x in lang_model.score(docs, running=True).collect()}
    assert out == plain and all(np.isfinite(x.score) and x.score < 0 for x in out.values())
