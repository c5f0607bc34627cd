"""All rows of the pipeline against its stages in plain Python, one after the other, over a whole table."""

import base64
import itertools
import json

import public_tokenizers
import pytest
from test_operators import canon_by_hand, linked, spans_by_hand

from batida.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def toxic_by_hand(text, weights, lexicon, parts):
    """Whether the model finds a text toxic: the transducers run one after the other, clauses counted as they come."""
    import math

    tape = [lexicon[t] for t in toxicity.TOKEN.findall((text or "").lower())] + [toxicity.END]
    for part in parts:
        state, out = 0, []
        for symbol in tape:
            state, made = part.step(state, symbol)
            out.append(made)
        tape = out
    return weights[0] + sum(w * math.log2(1 + tape.count(k)) for k, w in zip(toxicity.EVENTS, weights[1:], strict=True)) >= 0


def leaks(doc, item):
    """Whether some of the pieces that document and item share cover half of the item, filled consistently: every choice of pieces is tried."""
    held = lambda w: [v for t, v in w if t[0] == "<"]
    at = {}
    for b in range(len(doc) - 5):
        at.setdefault(tuple(k for k, _ in doc[b : b + 6]), []).append(b)
    pieces = {}
    for a in range(len(item) - 5):
        x = item[a : a + 6]
        if len(held(x)) > 2:
            continue
        for b in at.get(tuple(k for k, _ in x), ()):
            covered, pairs = pieces.setdefault(b - a, (set(), set()))
            covered.update(range(a, a + 6))
            pairs.update(zip(held(x), held(doc[b : b + 6]), strict=True))
    assert len(pieces) <= 14
    for n in range(1, len(pieces) + 1):
        for chosen in itertools.combinations(pieces.values(), n):
            covered, pairs = set().union(*(c for c, _ in chosen)), set().union(*(p for _, p in chosen))
            if 2 * len(covered) >= len(item) and 5 * len({a for a, _ in pairs}) >= 4 * len(pairs):
                return True
    return False


def redacted(text):
    out, at = [], 0
    for a, e in sorted((int(a), int(e)) for p in spans_by_hand(text).split(",") if p for _, a, e in [p.split(":")]):
        if a >= at or not out:
            out += [text[at:a], "<SECRET>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def test_pipeline_by_hand(spark):
    import tiktoken

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = [tuple(r) for r in read("documents").select("doc_id", "text", "lang", "source").collect()]
    items = [canon_by_hand(r.text) for r in read("benchmark").collect()]
    assert all(len(i) >= 6 for i in items)

    learned, weights = toxicity.model(read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic"))
    lexicon, parts = toxicity.Lexicon(learned), toxicity.grammar()
    rows = [r for r in rows if not toxic_by_hand(r[1], weights, lexicon, parts)]
    counts = [len(rows)]
    label = {i: component for i, (_, component, _) in linked([r[:2] for r in rows], 5, 80).items()}
    rows = [r for r in rows if label[r[0]] == r[0]]
    counts.append(len(rows))
    rows = [r for r in rows if not any(leaks(canon_by_hand(r[1]), i) for i in items)]
    counts.append(len(rows))
    assert read("documents").count() > counts[0] > counts[1] > counts[2]
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    true = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    clean = [redacted(r[1] or "") for r in rows]
    assert any("<SECRET>" in t for t in clean)
    want = sorted(json.dumps([i, lang, source, true.encode_ordinary(t)]) for (i, _, lang, source), t in zip(rows, clean, strict=True))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(json.dumps([r.doc_id, r.lang, r.source, list(r.ids)]) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
