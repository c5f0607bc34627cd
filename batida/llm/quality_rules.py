"""Quality rules with thresholds that follow the corpus.

Ratios of each text are summarised per language and source in a mergeable
quantile sketch: counts per logarithmic bin, so that sketches merge by
adding counts and every quantile has a bounded relative error. A text is
dropped where a ratio lies beyond a fence that the quantiles of its language
and source set: the upper quartile times a power of the quartiles' factor,
and for the length of words the lower quartile by it as well. A ratio that is
0 in a quarter of the texts or more takes both quartiles from the part that is
not, within bounds that the 99th percentile sets, and has a small constant
where hardly any text has it at all. No fence is above the largest ratio there is. The fence of a group counts
by the number of texts that set it against that of its language, and the
language's against that of the whole corpus, so it follows the texts there are
without a step. All sketch work is DataFrame aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batida.llm.common import materialize

# Word separators, symbols and marks that are counted.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: times that the quartiles' factor is applied to the upper quartile; words' lengths differ little, so theirs is higher
FEATURES = {"symbol_ratio": 4.0, "mark_ratio": 4.0, "capital_ratio": 4.0, "dup_line_ratio": 4.0, "repeat_ratio": 4.0, "monotony": 4.0, "word_length": 6.0}
LOWER = {"word_length": 6.0}  # and to the lower quartile
RARE = (1.5, 3.0)  # times the 99th percentile at least and at most, for a ratio that is 0 in a quarter of the texts or more
GUARD = 0.02  # the fence of a ratio that is 0 in 99 % of the texts
GAMMA = 1.005  # bins grow by this factor: quantiles are within 0.5 %
TIE = 1.1  # least factor of the quartiles, where they tie
PRIOR = 200  # texts that a language counts for against one of its groups, and the corpus against a language
ZERO_BIN = -1_000_000

STATS = "doc_id {id}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_capitals long, n_distinct long"


def measure(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of STATS after source."""
    import numpy as np

    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        v = len(seen)
        if v < 2_000_000:  # three ids fit one integer
            windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
            _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        else:
            _, at, times = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
        twice = times[at.ravel()] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    lines, earlier, dup, n_lines = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(SPACES):
            n_lines += 1
            dup += line in earlier
            earlier.add(line)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated,
        n_lines,
        len(raw) - len(raw.translate(None, MARKS)),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(set(words)),
    )


def text_stats(docs: DataFrame) -> DataFrame:
    schema = STATS.replace("{id}", dict(docs.dtypes)["doc_id"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column(3).to_pylist()]
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names) - 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts], names=names)

    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, schema)


def with_ratios(stats: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return stats.withColumns(
        {
            "symbol_ratio": over("n_symbols", "word_chars"),
            "mark_ratio": over("n_marks", "word_chars"),
            "capital_ratio": over("n_capitals", "word_chars"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
            "repeat_ratio": over("n_repeat_words", "n_words"),
            # how far the number of different words falls behind that of all, by logarithms, so that a text's length counts little
            "monotony": F.when(F.col("n_words") > 1, 1 - F.log(F.greatest("n_distinct", F.lit(1))) / F.log("n_words")).otherwise(0.0),
            "word_length": over("word_chars", "n_words"),
        }
    )


def sketch(ratios: DataFrame) -> DataFrame:
    """lang, source, feature, bin, n: one mergeable sketch per language and source."""
    long = ratios.select("lang", "source", F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("feature", "value"))
    place = F.when(F.col("value") > 1e-9, F.ceil(F.log("value") / math.log(GAMMA))).otherwise(ZERO_BIN)
    return long.groupBy("lang", "source", "feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, all, size, rare, low, high, most and top from the sketches, merged by keys.

    low and high are the quartiles of all texts or, where a quarter of them or
    more are 0 (rare), of the others; size is the number of texts that they
    are of. top is the 99th percentile of all.
    """
    merged = sketches.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "feature")
    zeros = F.sum(F.when(F.col("bin") == ZERO_BIN, F.col("n")).otherwise(0)).over(by)
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "size": F.sum("n").over(by), "zeros": zeros})
    value = F.when(F.col("bin") == ZERO_BIN, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin")))
    left = F.when(4 * F.col("zeros") >= F.col("size"), F.col("zeros")).otherwise(0)
    at = lambda q: F.min(F.when(F.col("upto") >= left + q * (F.col("size") - left), value))
    return ranked.groupBy(*keys, "feature").agg(F.max("size").alias("all"), F.max(F.col("size") - left).alias("size"), F.max(left > 0).alias("rare"), at(0.25).alias("low"), at(0.75).alias("high"), F.max(value).alias("most"), F.min(F.when(F.col("upto") >= 0.99 * F.col("size"), value)).alias("top"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, size and the upper and lower fence that a group's own quantiles set."""
    power = lambda of, other: F.coalesce(*[F.when(F.col("feature") == f, p) for f, p in of.items()], F.lit(other))
    factor = F.greatest(F.col("high") / F.col("low"), F.lit(TIE))
    scaled = F.col("high") * F.pow(factor, power(FEATURES, 0.0))
    rare = F.greatest(F.least(scaled, RARE[1] * F.col("top")), RARE[0] * F.col("top"))
    above = F.least(F.when(F.col("rare"), rare).otherwise(scaled), F.col("most"))
    below = F.when(F.col("feature").isin(*LOWER), F.col("low") / F.pow(factor, power(LOWER, 0.0))).otherwise(0.0)
    # hardly any text has the ratio: all texts say so
    none = F.col("rare") & (F.col("top") == 0)
    known = quartiles(sketches, keys).withColumns(
        {"size": F.when(none, F.col("all")).otherwise(F.col("size")), "fence": F.when(none, F.least(F.lit(GUARD), F.col("most"))).otherwise(above), "least": F.when(none, 0.0).otherwise(below)}
    )
    return known.select(*keys, "feature", "size", "fence", "least")


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source, one upper fence per ratio, and the lower fences."""
    top = fences(sketches, []).select(F.col("feature").alias("f3"), F.col("fence").alias("fence_all"), F.col("least").alias("least_all"))
    mid = fences(sketches, ["lang"]).select(F.col("lang").alias("l2"), F.col("feature").alias("f2"), F.col("size").alias("size_lang"), F.col("fence").alias("fence_lang"), F.col("least").alias("least_lang"))
    own = fences(sketches, ["lang", "source"])
    joined = own.join(mid, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("feature") == F.col("f2"))).join(top, F.col("feature") == F.col("f3"))
    blend = lambda size, own, under: (size * own + PRIOR * under) / (size + PRIOR)
    blended = lambda c: blend(F.col("size"), F.col(c), blend(F.col("size_lang"), F.col(c + "_lang"), F.col(c + "_all")))
    fenced = joined.select("lang", "source", "feature", blended("fence").alias("fence"), blended("least").alias("least"))
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    return fenced.groupBy("lang", "source").agg(*[pick(f, "fence").alias("max_" + f) for f in FEATURES], *[pick(f, "least").alias("min_" + f) for f in LOWER])


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept, language, source, what a text is beyond, and the ratios with their fences, one row per row of docs.

    A null text counts as empty and fails the base rule; the sketches are of
    the texts that pass it. Null languages and
    sources form groups of their own. Repeated rows are judged alike and count
    each; a ratio equal to its fence passes; other columns are ignored; an
    empty table gives no rows. A text is measured in whole, with memory of
    about a hundred times its own size.
    """
    ratios = with_ratios(materialize(text_stats(docs)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = thresholds(sketch(ratios.where(~failed))).withColumnsRenamed({"lang": "lang_of", "source": "source_of"})
    joined = ratios.join(limits, F.col("lang").eqNullSafe(F.col("lang_of")) & F.col("source").eqNullSafe(F.col("source_of")), "left")
    # quantiles are within a bin, so fences are too
    beyond = [F.when((F.col(f) > F.col("max_" + f) * GAMMA) | (F.col(f) < F.col("min_" + f) / GAMMA if f in LOWER else F.lit(False)), f) for f in FEATURES]
    dropped = F.when(failed, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.size(dropped) == 0)).alias("kept"), "lang", "source", dropped.alias("beyond"),
        *FEATURES, *["max_" + f for f in FEATURES], *["min_" + f for f in LOWER],
    )


def report(judged: DataFrame) -> DataFrame:
    """lang, source, number of texts, and the shares of them that the base rule, any fence and each fence drop."""
    share = lambda c: F.avg(c.cast("double"))
    return judged.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("base_failed")).alias("base_failed"), share(~F.col("kept") & ~F.col("base_failed")).alias("dropped"),
        *[share(F.array_contains("beyond", f)).alias("by_" + f) for f in FEATURES],
    )
