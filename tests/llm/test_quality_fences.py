"""Every fence of the quality rules drops what it is for, and leaves clean text alone."""

import random

import pytest
from test_operators import WORDS, table

from batida.llm import quality_rules

VOCABULARY = [w + a + b for a in ("", "a", "ee", "ii", "o") for b in "klmnopqrst" for w in WORDS[:6]]


def clean(k):
    """Text with a few marks, capitals, symbols, repeated lines and repeated words, as clean texts have them."""
    r = random.Random(k)
    words = [VOCABULARY[min(int(r.expovariate(0.02)), len(VOCABULARY) - 1)] for _ in range(r.randint(100, 200))]
    for at in r.sample(range(len(words)), len(words) // 12):
        words[at] = r.choice([words[at].capitalize(), words[at] + ","])
    if k % 2 == 0:
        for at in r.sample(range(len(words)), r.randint(2, 4)):
            words[at] += "#"
    lines = [" ".join(words[j : j + 6]) for j in range(0, len(words), 6)]
    if k % 3 == 0:
        lines += r.sample(lines, r.choice([1, 1, 1, 1]))
    return "\n".join(lines)


def odd(feature, k):
    words = clean(2 * k + 1).split()
    r = random.Random(k)
    if feature == "symbol_ratio":
        return " ".join(w + "#|" for w in words)
    if feature == "mark_ratio":
        return " ".join(w + ",;" for w in words)
    if feature == "capital_ratio":
        return " ".join(words).upper()
    if feature == "dup_line_ratio":
        lines = clean(2 * k + 1).split("\n")
        short = [w + "!" for w in "abcdefghijklmnopq"]
        return "\n".join(lines + [x for c in short for x in [c] * 4])
    if feature == "repeat_ratio":
        return " ".join(words + [r.choice(WORDS)] + words[: int(0.325 * len(words))])
    if feature == "monotony":
        return " ".join(f"{r.choice(WORDS[:9])}{r.choice('xyz')}" for _ in range(900))  # 27 words
    if feature == "word_length":
        return " ".join(w * 4 if k % 2 else w[:1] + str(j % 10) * (j % 2) for j, w in enumerate(words))
    raise ValueError(feature)



@pytest.mark.parametrize("feature", list(quality_rules.FEATURES))
def test_each_fence(spark, feature):
    rows = [(k, clean(k)) for k in range(600)] + [(1000 + k, odd(feature, k)) for k in range(6)]
    out = {x.doc_id: x for x in quality_rules.judge(table(spark, rows)).collect()}
    hit = [k for k in range(1000, 1006) if not out[k].base_failed and feature in out[k].beyond]
    missed = {k: (out[k][feature], out[k]["max_" + feature]) for k in range(1000, 1006) if k not in hit}
    assert len(hit) >= 3, missed
    assert sum(not out[k].kept for k in range(600)) <= 3
    assert all(x["max_" + f] <= max(y[f] for y in out.values()) * quality_rules.GAMMA * 1.001 for x in list(out.values())[:1] for f in quality_rules.FEATURES)


def test_report(spark):
    judged = quality_rules.judge(table(spark, [(k, clean(k)) for k in range(100)] + [(200, "few"), (201, odd("mark_ratio", 1))]))
    (row,) = quality_rules.report(judged).collect()
    assert (row.lang, row.source, row.n, round(row.base_failed * 102), round(row.by_mark_ratio * 102)) == ("en", "s", 102, 1, 1)
    assert row.dropped >= row.by_mark_ratio
