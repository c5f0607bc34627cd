"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols of a small alphabet (insult, violent act, person,
negation, speech report, intent, quotation mark, clause end). Transducers for
reported speech, negation, targets and threats rewrite the symbols, and a last
one rates each clause by what is left in it; they are composed into one
machine before any text is read. So a word counts as its clause has it:
outright or aimed at somebody, repeated, denied, or told of others. A logistic
model over the clauses of each kind, drawn towards fixed prior weights, gives
the score. What decides by itself is a constraint of the fit, not a summand
that labels of other kinds may outweigh: one insult aimed at somebody, and one
threat of violence at a person, reach 0.5 and count as much as bare insults do
at least; denied and reported insults never raise a score. The labels may lift
the first two where they contradict them. One clause with one bare insult
stays below 0.5 by the prior, and follows the labels.
Terms that the labels show beyond the fixed lists are insults like the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batida.llm.common import add_from_texts, held_out, materialize, runs

FOLDS = 5
SAMPLE = 20_000  # labelled texts, about, that terms are learned from
LEAST_SHARE = 0.75  # of a term's neighbourhoods that are in toxic texts
STEMS = range(4, 9)  # lengths of word beginnings that can be terms
MOST_SENT = 100_000  # suspect words (some MB) up to which they are sent to all tasks; more are joined by a shuffle, with the same result
KNOWN_WORDS = 100_000  # that a task remembers, of up to LONGEST letters
LONGEST = 64
MOST_LABELS = 1_000_000  # labelled ids (some MB) up to which they are sent to all tasks; with more, all texts are counted, with the same result
MOST_COUNTS = 100_000  # different counts (some MB) that the model is fitted to on the driver; more stay in Spark, with the same result
MARGIN = 0.2  # beyond 0.5, in log odds, of what decides by itself
LEAST_SEEN = 20  # labelled texts that may contradict a constraint

# The lexicons.
INSULTS = (
    "arschloch asshole bastard bitch bastardo cabrón clown coward cretin crétin degenerate depp dimwit disgusting dumb dumbass dummkopf filth freak "
    "hurensohn idiot idiota idiote imbecile imbécil imbécile inútil jerk loser lowlife maggot mistkerl moron parasite pathetic pendejo pig "
    "pitoyable retard scum scumbag shithead slut stupid stupide subhuman trash trottel ugly vermin whore wichser worthless wretch"
).split()
VIOLENT = "attack beat burn choke crush destroy erschießen frapper golpear hang hurt kill kills killing matar murder punch schlagen shoot slap stab strangle tuer töten".split()
PERSONS = "du ella er eux he her him ihr ils je lui me nous she sie tu tú they them toi ustedes usted vosotros vous we you your yours yourself".split()
NEGATIONS = "aren't didn't doesn't don't isn't jamais kein keine never nicht nobody non not nunca pas wasn't weder".split()
REPORTS = "afirmó alleged behauptete called claimed dijo dit gesagt prétend quoted reported said sagte says wrote écrit".split()
INTENTS = "gonna going werde werden will would voy vais must should shall soon".split()

# Symbols. Small letters are plain input, capitals are what is made of them.
OTHER, INSULT, VIOLENCE, PERSON, NEGATION, REPORT, INTENT, QUOTE, END = "o i v p n r w q .".split()
AIMED, PLAIN, REPEATED, DENIED, TOLD, THREAT, ACT = "A I R D T H V".split()
EVENTS = (AIMED, PLAIN, REPEATED, DENIED, TOLD, THREAT, ACT)
#: Prior weights of the clauses' kinds, and of a text without any (the bias).
PRIOR = {AIMED: 4.0, PLAIN: 2.0, REPEATED: 3.5, DENIED: 0.0, TOLD: 0.0, THREAT: 3.5, ACT: 0.3}
BIAS = -3.0
RIDGE = 2.0

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]|[\"“”„«»]")


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> (next state, output). State 0 is the start; other symbols pass and lead to fall[state].

    A clause's end leads to the start and passes, or gives ends[state].
    """

    arcs: dict[tuple[int, str], tuple[int, str]]
    fall: tuple[int, ...]
    ends: tuple[str, ...] = ()

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        if symbol == END:
            return 0, self.ends[state] if self.ends else END
        return self.arcs.get((state, symbol), (self.fall[state], symbol))


def countdown(trigger: str, reach: int, rewrite: dict[str, str]) -> Transducer:
    """Rewrites symbols that follow the trigger by at most `reach` words of the clause."""
    arcs = {(s, trigger): (reach, trigger) for s in range(reach + 1)}
    arcs |= {(s, a): (s - 1, b) for s in range(1, reach + 1) for a, b in rewrite.items()}
    return Transducer(arcs, (0, *range(reach)))


def reported() -> Transducer:
    """After a verb of speech up to the clause's end, or between quotation marks."""
    arcs = {(0, REPORT): (1, REPORT), (0, QUOTE): (2, QUOTE), (1, QUOTE): (2, QUOTE), (2, QUOTE): (0, QUOTE)}
    arcs |= {(s, a): (s, b) for s in (1, 2) for a, b in ((INSULT, TOLD), (VIOLENCE, OTHER))}
    return Transducer(arcs, (0, 1, 2))


def threats() -> Transducer:
    """Intent, at most three words on an act of violence, at most three words on a person: a threat."""
    arcs = {(s, INTENT): (3, INTENT) for s in range(7)}
    arcs |= {(s, VIOLENCE): (6, VIOLENCE) for s in range(1, 7)}
    arcs |= {(s, PERSON): (0, THREAT) for s in range(4, 7)}
    return Transducer(arcs, (0, 0, 1, 2, 0, 4, 5))


def rated() -> Transducer:
    """One event per clause, at its end: the gravest thing in it; two outright insults make a repeated one."""
    ranks = (OTHER, ACT, TOLD, DENIED, PLAIN, REPEATED, AIMED, THREAT)  # by gravity; the state is the index
    arcs = {(s, x): (max(s, k), OTHER) for s in range(len(ranks)) for k, x in enumerate(ranks) if x in (TOLD, DENIED, AIMED, THREAT)}
    arcs |= {(s, VIOLENCE): (max(s, 1), OTHER) for s in range(len(ranks))}
    plain = ranks.index(PLAIN)
    arcs |= {(s, INSULT): (max(s, plain) if s != plain else plain + 1, OTHER) for s in range(len(ranks))}
    return Transducer(arcs, tuple(range(len(ranks))), ranks)


def grammar() -> list[Transducer]:
    return [
        reported(),
        countdown(NEGATION, 3, {INSULT: DENIED, VIOLENCE: OTHER}),
        countdown(PERSON, 4, {INSULT: AIMED}),
        threats(),
        rated(),
    ]


def compose(parts: list[Transducer]) -> tuple[dict[tuple[int, str], tuple[int, str]], int]:
    """One machine whose arcs feed each part's output to the next; its reachable states are numbered from 0."""
    symbols = (OTHER, INSULT, VIOLENCE, PERSON, NEGATION, REPORT, INTENT, QUOTE, END)
    start = (0,) * len(parts)
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        states = todo.pop()
        for symbol in symbols:
            out, after = symbol, []
            for part, state in zip(parts, states, strict=True):
                state, out = part.step(state, out)
                after.append(state)
            after = tuple(after)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            arcs[number[states], symbol] = (number[after], out)
    return arcs, len(number)


class Lexicon(dict):
    """Token -> symbol. A learned term that ends in * stands for all words that begin so."""

    def __init__(self, learned: list[str] = ()):
        self.stems = {t[:-1] for t in learned if t.endswith("*")}
        self.fixed = {t: INSULT for t in (*learned, *INSULTS) if not t.endswith("*")}
        for words, symbol in ((VIOLENT, VIOLENCE), (PERSONS, PERSON), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT)):
            self.fixed |= {w: symbol for w in words}
        self.fixed |= {c: END for c in ".!?;:\n"} | {c: QUOTE for c in "\"“”„«»"}

    def __missing__(self, token: str) -> str:
        symbol = self.fixed.get(token)
        if symbol is None:
            symbol = INSULT if any(token[:k] in self.stems for k in STEMS if k < len(token)) else OTHER
        if len(self) > KNOWN_WORDS:
            self.clear()
        if len(token) <= LONGEST:
            self[token] = symbol
        return symbol


def events(text: str, symbols: Lexicon, arcs) -> dict[str, int]:
    """Events of one text, in whole: kind -> number of clauses."""
    tape = [symbols[t] for t in TOKEN.findall(text.lower())]
    if INSULT not in tape and VIOLENCE not in tape:
        return {}
    state, found = 0, {}
    for symbol in (*tape, END):
        state, out = arcs[state, symbol]
        if out.isupper():
            found[out] = found.get(out, 0) + 1
    return found


def event_counts(docs: DataFrame, learned: list[str]) -> DataFrame:
    """doc_id and the number of clauses of each kind, e_<kind>, for every row."""
    arcs, _ = compose(grammar())

    def make():
        symbols = Lexicon(learned)

        def work(texts: list) -> list:
            found = [events(t or "", symbols, arcs) for t in texts]
            return [[f.get(k, 0) for f in found] for k in EVENTS]

        return work

    return add_from_texts(docs.select("doc_id", "text"), {f"e_{k}": "int" for k in EVENTS}, make).drop("text")


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learned from; the larger label where rows repeat."""
    usable = labels.where(~held_out(F.col("doc_id"), FOLDS) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def learn_terms(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words seen almost only in toxic texts, in many different neighbourhoods.

    Learned from about SAMPLE labelled texts, picked by a hash of doc_id; that
    bounds the labels' side of the join, which is broadcast, and the terms. A
    term is asked to be in more texts, and in 2.4 times as many neighbourhoods,
    the more toxic texts there are: with them grows the number of words that
    are in toxic texts alone by chance.
    """
    train = training_labels(labels)
    total = train.count()
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, total))))
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    toxic = sample.where("toxic = 1").count()
    least = max(3, round(math.log2(max(1, toxic))) - 3)
    words = F.expr(r"regexp_extract_all(lower(text), '[\\p{L}]+', 0)")
    split = sample.select("doc_id", "toxic", words.alias("w")).where(F.size("w") > 0)
    beside = F.transform("w", lambda x, k: F.struct(x.alias("word"), F.xxhash64(F.get("w", k - 1), F.get("w", k + 1)).alias("near")))
    each = split.select("doc_id", "toxic", F.explode(beside).alias("at")).select("doc_id", "toxic", "at.word", "at.near")
    # counts come first, so that neighbourhoods are gathered for suspect words alone
    counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    suspects = counted.where((F.col("n") >= 3) & (F.col("bad") >= 0.5 * F.col("n"))).select("word")
    suspects = materialize(suspects)
    few = suspects.count() <= MOST_SENT
    each = each.join(F.broadcast(suspects) if few else suspects, "word")
    seen = each.groupBy("word", "near").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc"))
    rated = seen.groupBy("word", "doc").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    rated = rated.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("texts"))
    cuts = F.filter(F.array(*[F.lit(k) for k in STEMS]), lambda k: k < F.length("word"))
    beginnings = F.explode(F.transform(cuts, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem")
    # a beginning is held against all words that have it, suspect or not
    known = counted.select(beginnings, "n", "bad").join(suspects.select(beginnings).distinct(), "stem")
    known = known.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") >= LEAST_SHARE * F.col("n")).select("stem")
    begun = rated.select(beginnings, "n", "bad", "texts").join(known, "stem")
    stems = begun.groupBy(F.concat("stem", F.lit("*")).alias("word")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("texts").alias("texts"), F.count(F.lit(1)).alias("words"))
    both = rated.where(F.length("word") > 2).withColumn("words", F.lit(3)).unionByName(stems)
    good = both.where((F.col("n") >= math.ceil(2.4 * least)) & (F.col("texts") >= least) & (F.col("words") >= 3) & (F.col("bad") >= LEAST_SHARE * F.col("n")))
    return pruned([r["word"] for r in good.select("word").collect()])


def pruned(terms: list[str]) -> list[str]:
    """Terms without those that a shorter beginning covers."""
    stems = {t[:-1] for t in terms if t.endswith("*")}
    covered = lambda t: any(t.rstrip("*")[:k] in stems for k in STEMS if k < len(t.rstrip("*")))
    return sorted(t for t in terms if not covered(t))


def features(n: Column) -> Column:
    """What n clauses of a kind add, per unit of weight: further ones add less each."""
    return F.log2(1.0 + n)


def total(weights: list[float]) -> Column:
    return sum((w * features(F.col(f"e_{k}")) for k, w in zip(EVENTS, weights[1:], strict=True)), F.lit(weights[0]))


def probability(weights: list[float]) -> Column:
    return 1 / (1 + F.exp(-total(weights)))


def constraints(contradicted: frozenset[str] = frozenset()) -> list[tuple[list[float], float]]:
    """Rows (coefficients of bias and weights, least value) of linear constraints."""

    def row(least: float, **of: float) -> tuple[list[float], float]:
        return [of.get("bias", 0.0), *(of.get(k, 0.0) for k in EVENTS)], least

    decides = [row(MARGIN, bias=1.0, **{k: 1.0}) for k in (AIMED, THREAT) if k not in contradicted]
    above = [row(0.0, **{AIMED: 1.0, k: -1.0}) for k in (PLAIN, REPEATED) if AIMED not in contradicted]
    return decides + above + [row(0.0, **{k: -1.0}) for k in (DENIED, TOLD)]


def nearest(bend, pull_to, limits: list[tuple[list[float], float]]):
    """The w that makes w'bend w / 2 - pull_to'w least within the limits: the best of those that meet some of them exactly."""
    import itertools

    import numpy as np

    best, least = None, math.inf
    rows, ends = np.array([r for r, _ in limits]), np.array([e for _, e in limits])
    for n in range(len(limits) + 1):
        for met in itertools.combinations(range(len(limits)), n):
            size, own = len(pull_to), list(met)
            left = np.zeros((size + n, size + n))
            left[:size, :size] = bend
            left[:size, size:], left[size:, :size] = -rows[own].T, rows[own]
            try:
                w = np.linalg.solve(left, np.r_[pull_to, ends[own]])[:size]
            except np.linalg.LinAlgError:
                continue
            value = w @ bend @ w / 2 - pull_to @ w
            if value < least and (rows @ w >= ends - 1e-9).all():
                best, least = w, value
    return best


def fit(counts: DataFrame, labels: DataFrame, most: int = MOST_COUNTS) -> list[float]:
    """Bias and weights of the clauses' kinds: ridge logistic regression around the prior, within constraints().

    The different counts that labelled texts have, a few hundred rows here, are
    fitted on the driver up to `most` of them; with more, each Newton step is
    an aggregation in Spark and the driver sees sums alone. A kind's
    constraint is lifted where LEAST_SEEN labelled texts or more have such
    clauses, none graver and no bare insults, and most of these are clean.
    """
    import numpy as np

    names = [f"e_{k}" for k in EVENTS]
    rows = counts.select("doc_id", *names).join(training_labels(labels), "doc_id").groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    rows = materialize(rows.select(*names, F.col("n").cast("double"), F.col("bad").cast("double")))
    alone = {k: (F.col(f"e_{k}") > 0) & sum((F.col(f"e_{x}") > 0).cast("int") for x in (AIMED, THREAT, PLAIN, REPEATED) if x != k).eqNullSafe(0) for k in (AIMED, THREAT)}
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(c, F.col(v))).alias(f"{v}_{k}") for k, c in alone.items() for v in ("n", "bad")]).first()
    contradicted = frozenset(k for k in alone if (seen[f"n_{k}"] or 0) >= LEAST_SEEN and 2 * seen[f"bad_{k}"] < seen[f"n_{k}"])
    prior = np.array([BIAS, *(PRIOR[k] for k in EVENTS)])
    size, pull = len(prior), RIDGE * np.eye(len(prior))
    sums = _sums_here(rows, names) if seen["rows"] <= most else _sums_in_spark(rows, names)
    limits, w = constraints(contradicted), prior.copy()
    for _ in range(30):
        slope, bend = sums(w)
        bend = bend + pull
        after = nearest(bend, bend @ w + slope - pull @ (w - prior), limits)
        step = after - w
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return w.tolist()


def _sums_here(rows: DataFrame, names: list[str]):
    """w -> slope and curvature of the log likelihood over rows, which the driver holds."""
    import numpy as np

    held = rows.toArrow().to_pydict()
    x = np.column_stack([np.ones(len(held["n"])), *(np.log2(1.0 + np.array(held[c], float)) for c in names)]).reshape(len(held["n"]), len(names) + 1)
    n, bad = np.array(held["n"], float), np.array(held["bad"], float)

    def sums(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (bad - n * p), (x * (n * p * (1 - p))[:, None]).T @ x

    return sums


def _sums_in_spark(rows: DataFrame, names: list[str]):
    """w -> the same sums, by one aggregation."""
    import numpy as np

    size = len(names) + 1
    x = [F.lit(1.0), *(features(F.col(c)) for c in names)]
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]

    def sums(w):
        p = 1 / (1 + F.exp(-F.least(F.greatest(total(w.tolist()), F.lit(-30.0)), F.lit(30.0))))
        held = rows.select("n", "bad", p.alias("p"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        spread, miss = F.col("n") * F.col("p") * (1 - F.col("p")), F.col("bad") - F.col("n") * F.col("p")
        found = held.agg(*[F.sum(F.col(f"x{i}") * miss) for i in range(size)], *[F.sum(spread * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        bend = np.zeros((size, size))
        for (i, j), v in zip(pairs, found[size:], strict=True):
            bend[i, j] = bend[j, i] = v or 0.0
        return np.array([v or 0.0 for v in found[:size]]), bend

    return sums


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """The rows of docs that the model is fitted to, or all of them where more than `most` ids are labelled."""
    ids = training_labels(labels).select("doc_id")
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= most else docs


def model(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float]]:
    """Learned terms and weights; of docs, labelled rows alone are read in whole."""
    learned = learn_terms(docs, labels)
    return learned, fit(event_counts(labelled(docs, labels), learned), labels)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, whose score is below 0.5.

    Null and empty texts have no clauses and stay; rows that repeat are judged
    one by one; an empty table gives no rows; columns of any name are carried
    along. A text is read in whole, its symbols are held at once.
    """
    learned, weights = model(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    arcs, _ = compose(grammar())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Lexicon(learned)
        for batch in batches:
            for begin, n in runs(batch.column(at)):
                part, keep = batch.slice(begin, n), []
                for text in part.column(at).to_pylist():
                    found = events(text or "", symbols, arcs)
                    keep.append(weights[0] + sum(w * math.log2(1.0 + found.get(k, 0)) for k, w in zip(EVENTS, weights[1:], strict=True)) < 0)
                yield part.filter(pa.array(keep, pa.bool_()))

    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes, strict=True))
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of clauses of each kind, for every row.

    Null and empty texts have no clauses and get the score of such texts.
    Rows with equal ids are scored one by one, equal texts alike; other columns
    are ignored; an empty table gives no rows; without labels the prior
    weights hold. A text is read in whole, its symbols are held at once.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    learned = learn_terms(docs, labels)
    counts = materialize(event_counts(docs, learned))
    p = probability(fit(counts, labels))
    names = {AIMED: "n_aimed", PLAIN: "n_plain", REPEATED: "n_repeated", DENIED: "n_denied", TOLD: "n_reported", THREAT: "n_threats", ACT: "n_violent"}
    return counts.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"),
        *[F.col(f"e_{k}").alias(v) for k, v in names.items()],
    )
