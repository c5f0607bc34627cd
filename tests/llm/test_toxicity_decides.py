"""What decides by itself: aimed insults and threats, with the weights that the labels of the given tables give."""

import math

import numpy as np
import pytest

from batida.llm import toxicity

SENTENCES = [
    ("you are an idiot.", 1),
    ("I will kill you.", 1),
    ("They are going to hurt him, they will strangle him!", 1),
    ("You worthless coward", 1),
    ("he is not an idiot.", 0),
    ("she said you are an idiot.", 0),
    ('They wrote "idiot, moron" and "I will kill you".', 0),
    ("the dog will kill the rat", 0),
    ("nobody called them stupid", 0),
    ("we will beat the eggs, shoot the film and crush the ice", 0),
    ("A quiet day in the hills.", 0),
    ("", 0),
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_sentences(spark, size):
    read = lambda name: spark.read.parquet(f"/root/testdata/{size}/{name}.parquet")
    learned, weights = toxicity.model(read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic"))
    (arcs, _), lexicon = toxicity.compose(toxicity.grammar()), toxicity.Lexicon(learned)

    def score(text):
        found = toxicity.events(text, lexicon, arcs)
        return 1 / (1 + math.exp(-weights[0] - sum(w * math.log2(1 + found.get(k, 0)) for k, w in zip(toxicity.EVENTS, weights[1:], strict=True))))

    got = {text: score(text) for text, _ in SENTENCES}
    assert {t: int(p >= 0.5) for t, p in got.items()} == dict(SENTENCES)
    assert got["you are an idiot."] >= score("a pig stood in the trash.")
    assert all(not any(t != s and s.endswith("*") and t.startswith(s[:-1]) for s in learned) for t in learned)


def test_both_routes_of_the_fit(spark):
    """Fitted on the driver or in Spark, on labelled rows or on all, the weights are the same."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic")
    counts = toxicity.event_counts(docs, ["zorg"])
    few = toxicity.event_counts(toxicity.labelled(docs, labels), ["zorg"])
    assert few.count() < counts.count() == toxicity.labelled(docs, labels, most=0).count()
    want = toxicity.fit(counts, labels)
    assert np.allclose(want, toxicity.fit(few, labels), atol=1e-6) and np.allclose(want, toxicity.fit(counts, labels, most=0), atol=1e-3)


def test_both_routes_of_the_terms(spark, monkeypatch):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic")
    sent = toxicity.learn_terms(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_SENT", 0)
    assert toxicity.learn_terms(docs, labels) == sent and sent


def test_labels_may_contradict(spark):
    """Where most texts with one aimed insult are labelled clean, it decides no more."""
    rows = [(k, "you idiot" if k < 100 else "a tree") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for toxic, want in ((0, 0), (1, 1)):
        labels = spark.createDataFrame([(k, toxic if k < 100 else 0) for k, _ in rows], "doc_id long, toxic int")
        assert {r.predicted for r in toxicity.score(docs, labels).where("doc_id < 100").collect()} == {want}


def test_nearest_against_trying_many():
    rng = np.random.default_rng(3)
    limits = toxicity.constraints()
    for _ in range(5):
        a = rng.normal(size=(20, 8))
        bend, pull = a.T @ a + np.eye(8), rng.normal(size=8) * 10
        value = lambda w, bend=bend, pull=pull: w @ bend @ w / 2 - pull @ w
        w = toxicity.nearest(bend, pull, limits)
        assert all(np.dot(r, w) >= e - 1e-6 for r, e in limits)
        for _ in range(20_000):
            v = w + rng.normal(size=8) * rng.choice([0.01, 0.1, 1])
            assert value(v) >= value(w) - 1e-6 or any(np.dot(r, v) < e - 1e-9 for r, e in limits)
