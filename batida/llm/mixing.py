"""Mixing sources to target weights, by a splitting tree of multivariate hypergeometric draws.

The words of a source, document after document, are cut into blocks of equal
length. A source's target is a quota of block draws: whole rounds over all its
blocks, then part of one more, the last draw cut so that the words come out
exactly. The quotas are split among the output shards: a node of the tree
draws, without replacement, which of its blocks go left, so that the numbers
of each source add up at every node, and a shard is a random sample of the
whole. A source's draws are numbered; a shard takes a run of numbers of each,
a keyed permutation of the blocks tells which block a number draws, so draws
are disjoint without any list of them. Shards shuffle their draws.

Documents get their place in their source from distributed prefix sums: range
partitions are summed each, and their totals, one number a partition, added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm.common import materialize

WEIGHTS = (5, 2, 1)  # of the sources in order of their names, repeating
MOST_TIMES = 3  # that a source's words may be taken
BLOCK = 256  # words of a block, at least
MOST_BLOCKS = 1 << 28  # of a corpus; larger ones have longer blocks, as the draws of numpy are exact below 10^9
SHARD = 4096  # draws of an output shard
MOST_SOURCES = 1 << 20  # the driver holds a few numbers of each
SEED = 13
ROUNDS = 4  # of the permutation

WORD = rb"[^\x20\x09-\x0D]+"
SPACE = "\\x20\\x09-\\x0D"


@dataclass(frozen=True)
class Quota:
    """What is taken of a source: `draws` draws, of which the last takes `cut` words of its block alone (0: all)."""

    source: str | None
    size: int
    target: float
    blocks: int
    draws: int
    cut: int


def _count(text: bytes) -> int:
    """Words of a text, in the memory of a few times its size."""
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return int(np.count_nonzero(~space[1:] & space[:-1])) + int(len(raw) > 0 and not space[0])


def sized(docs: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, source, size, digest of each row, and its text if with_text. Digests only order rows that share a doc_id."""
    kinds = dict(docs.dtypes)
    ddl = f"doc_id {kinds['doc_id']}, source string, size long, digest long" + (", text string" if with_text else "")
    names = ["doc_id", "source", "size", "digest", "text"][: 5 if with_text else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([_count(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, batch.column(2), *([batch.column(3)] if with_text else [])], names=names)

    return docs.select("doc_id", F.col("source").cast("string"), F.xxhash64("text").alias("digest"), F.col("text").cast("string")).mapInArrow(run, ddl)


def with_begin(rows: DataFrame) -> DataFrame:
    """rows with `at`, the words of all rows before, by source (null last), doc_id, size and digest.

    Each range partition sums its own rows; totals of partitions are added on
    the driver, one number a partition. Equal rows are told apart by where they
    were read, so that any number of them is spread over partitions.
    """
    spark = rows.sparkSession
    keys = [F.col("source").isNull(), "source", F.col("doc_id").asc_nulls_last(), "size", "digest", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = [f"`{n}` {k}" for n, k in rows.dtypes]
    names = [*rows.columns, "part", "within"]
    size_at = rows.columns.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = 0
        for batch in batches:
            sizes = batch.column(size_at).to_numpy()
            upto = held + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - sizes)], names=names)
            held = int(upto[-1]) if len(upto) else held

    summed = materialize(dealt.select(*rows.columns, F.spark_partition_id().alias("part")).mapInArrow(run, ", ".join([*kinds, "part int", "within long"])))
    totals = {r["part"]: r["n"] for r in summed.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(totals):
        offsets.append((part, before))
        before += totals[part]
    added = spark.createDataFrame(offsets, "part int, before long")  # one row a partition
    return summed.join(F.broadcast(added), "part").withColumn("at", F.col("before") + F.col("within")).drop("part", "before", "within")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Words to take of each source, sources in order: shares by weight, none above MOST_TIMES its size."""
    total, full = sum(sizes), [False] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    while True:
        rest = total - sum(MOST_TIMES * n for n, f in zip(sizes, full, strict=True) if f)
        shared = sum(w for w, f in zip(weight, full, strict=True) if not f)
        out = [float(MOST_TIMES * n) if f else rest * w / shared for n, w, f in zip(sizes, weight, full, strict=True)]
        over = [not f and t > MOST_TIMES * n for n, t, f in zip(sizes, out, full, strict=True)]
        if not any(over) or all(f or o for f, o in zip(full, over, strict=True)):
            return [float(min(t, MOST_TIMES * n)) for n, t in zip(sizes, out, strict=True)]
        full = [f or o for f, o in zip(full, over, strict=True)]


def _round_keys(seed: int, source: int, round_: int) -> list[int]:
    raw = hashlib.blake2b(f"{seed}/{source}/{round_}".encode(), digest_size=8 * ROUNDS).digest()
    return [int.from_bytes(raw[8 * k : 8 * k + 8], "little") for k in range(ROUNDS)]


def permuted(numbers, n: int, keys: list[int], back: bool = False):
    """Where the keyed permutation of 0..n-1 takes each of numbers (an array); back: its inverse.

    A Feistel network over the least even number of bits, repeated while its
    result is n or more.
    """
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def mixed(x, key: int):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & mask

    def once(x):
        left, right = x >> shift, x & mask
        for key in reversed(keys) if back else keys:
            left, right = (right ^ mixed(left, key), left) if back else (right, left ^ mixed(right, key))
        return (left << shift) | right

    out = once(np.asarray(numbers, np.uint64))
    while (out >= n).any():
        beyond = out >= n
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def quotas(sizes: list[tuple[str | None, int]], block: int, seed: int, weights: tuple[int, ...] = WEIGHTS) -> list[Quota]:
    """The quota of each (source, size), sources in order: its draws take round(target) words exactly."""
    out = []
    for k, ((source, size), target) in enumerate(zip(sizes, targets([n for _, n in sizes], weights), strict=True)):
        blocks = -(-size // block)
        rounds, rest = divmod(round(target), size) if size else (0, 0)
        draws, cut = rounds * blocks, 0
        if rest:
            short = size - (blocks - 1) * block  # the last block's words; draw number `at` of the round takes it
            at = int(permuted([blocks - 1], blocks, _round_keys(seed, k, rounds), back=True)[0])
            before = rest // block
            if rest >= at * block + short:
                before = 1 + (rest - short) // block
                cut = (rest - short) % block
            else:
                cut = rest % block
            draws += before + (cut > 0)
        out.append(Quota(source, size, target, blocks, draws, cut))
    return out


def split(counts, begins, low: int, high: int, first: int, last: int, bounds, seed: int) -> Iterator[tuple]:
    """(shard, counts, begins) of the shards from first to last below the node of shards low to high.

    counts: draws of each source below the node, begins: their first numbers.
    bounds: draws before each shard. Children depend on the seed and the node
    alone, so any task makes the same ones.
    """
    import numpy as np

    if last <= low or first >= high:
        return
    if high - low == 1:
        yield low, counts, begins
        return
    middle = (low + high) // 2
    dice = np.random.Generator(np.random.PCG64([seed, low, high]))
    left = dice.multivariate_hypergeometric(counts, int(bounds(middle) - bounds(low)), method="marginals")
    yield from split(left, begins, low, middle, first, last, bounds, seed)
    yield from split(counts - left, begins + left, middle, high, first, last, bounds, seed)


def drawn(spark, plan: list[Quota], seed: int) -> DataFrame:
    """shard, place, n_source, round, block, cut: every draw of the mix, made shard by shard.

    place: where the draw stands in its shard; cut: words that it takes of its
    block (null: all).
    """
    total = sum(q.draws for q in plan)
    n = max(1, -(-total // SHARD))
    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = np.array([q.draws for q in plan], np.int64)
        for batch in batches:
            shards = batch.column(0).to_pylist()
            if not shards:
                continue
            for shard, own, begins in split(counts, np.zeros_like(counts), 0, n, min(shards), max(shards) + 1, lambda k: total * k // n, seed):
                columns: list[list] = [[], [], [], []]
                for k in np.flatnonzero(own).tolist():
                    q, number = plan[k], np.arange(begins[k], begins[k] + own[k])
                    round_ = number // q.blocks
                    for r in np.unique(round_).tolist():
                        some = number[round_ == r]
                        cut = np.where((some == q.draws - 1) & (q.cut > 0), q.cut, 0)
                        for c, v in zip(columns, (np.full(len(some), k), np.full(len(some), r), permuted(some - r * q.blocks, q.blocks, _round_keys(seed, k, r)), cut), strict=True):
                            c.append(v)
                if columns[0]:
                    source, round_, block, cut = map(np.concatenate, columns)
                    place = np.random.Generator(np.random.PCG64([seed, shard])).permutation(len(source))
                    arrays = [pa.array(np.full(len(source), shard)), pa.array(place), pa.array(source), pa.array(round_), pa.array(block), pa.array(cut, pa.int64(), mask=cut == 0)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["shard", "place", "n_source", "round", "block", "cut"])

    return spark.range(0, n, 1, tasks).mapInArrow(run, "shard long, place long, n_source long, round long, block long, cut long")


@dataclass(frozen=True)
class Mix:
    """rows: doc_id, source, size, begin (first word's place in its source), n_source, source_size, target, and text if asked for; draws: see drawn()."""

    rows: DataFrame
    draws: DataFrame
    block: int


def plan(docs: DataFrame, with_text: bool = False, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> Mix:
    """The mix of docs (doc_id, text, source): where every row stands, and every draw. ValueError beyond MOST_SOURCES sources."""
    spark = docs.sparkSession
    placed = with_begin(materialize(sized(docs, with_text)))
    sources = placed.groupBy("source").agg(F.sum("size").alias("size"), F.min("at").alias("first")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    total = sum(r["size"] for r in sources)
    block = max(BLOCK, -(-total // MOST_BLOCKS))
    shares = quotas([(r["source"], r["size"]) for r in sources], block, seed, weights)
    known = [(k, r["source"], r["first"], r["size"], q.target) for k, (r, q) in enumerate(zip(sources, shares, strict=True))]
    table = spark.createDataFrame(known, "n_source long, own string, first long, source_size long, target double")
    table = F.broadcast(table) if len(known) <= 10_000 else table
    rows = placed.join(table, F.col("source").eqNullSafe(F.col("own"))).withColumn("begin", F.col("at") - F.col("first")).drop("own", "at", "first", "digest")
    return Mix(rows, drawn(spark, shares, seed), block)


def taken(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each row the draws take, repeats counted."""
    times = mix.draws.groupBy("n_source", "block").agg(F.sum(F.when(F.col("cut").isNull(), 1).otherwise(0)).alias("whole"), F.sum("cut").alias("part"))
    last = F.floor((F.col("begin") + F.col("size") - 1) / mix.block)
    rows = mix.rows.select("doc_id", "size", "source_size", "target", "n_source", "begin")
    pieces = rows.where("size > 0").select("n_source", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / mix.block), last)).alias("block"))
    start = F.greatest("begin", F.col("block") * mix.block)
    end = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * mix.block)
    part_end = F.least(end, F.col("block") * mix.block + F.coalesce("part", F.lit(0)))
    words = F.col("whole") * (end - start) + F.greatest(part_end - start, F.lit(0))
    # draws are made from a few rows, so their size would be underrated: never a broadcast
    sums = pieces.join(times.hint("merge"), ["n_source", "block"]).groupBy("n_source", "begin").agg(F.sum(words).cast("long").alias("taken"))
    # rows without words may stand at the same place as others
    out = rows.withColumn("own", F.when(F.col("size") > 0, F.col("begin"))).join(sums.withColumnRenamed("begin", "own").hint("merge"), ["n_source", "own"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row per row of docs (doc_id, text, source).

    Null and empty texts have no words and are never taken; a null source is
    one of its own, the last; rows of one source go by doc_id (nulls last),
    those that share it by size and a digest of the text, and repeated rows
    count each. Words that are taken of a source are its target, rounded. Other columns are
    ignored; an empty table gives no rows. The same rows and seed give the
    same result however they are stored. A text is counted in whole, in the
    memory of a few times its size.
    """
    return taken(plan(docs, weights=weights, seed=seed))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, place, round, source, doc_id, word, text, in range partitions by shard and place.

    A row is a piece of one document that a draw takes; word is the place of
    its first word in its source. Pieces of a draw share shard and place and
    follow each other by word.
    """
    made = plan(docs, with_text=True, weights=weights, seed=seed)
    kind = dict(docs.dtypes)["doc_id"]
    block = made.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(WORD)
        names = ["n_source", "source", "doc_id", "block", "word", "n_words", "text"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), None, pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True))[:2])
        for batch in batches:
            ids, out = batch.column(2), []
            for k, (n_source, source, begin, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 3, 4)], strict=True)):
                raw, at, first, since = text.encode(), begin, None, begin
                end = 0
                for found in words.finditer(raw):
                    if at % block == 0 and first is not None:
                        out.append((n_source, source, k, since // block, since, at - since, raw[first:end].decode()))
                        first = None
                    if first is None:
                        first, since = found.start(), at
                    end, at = found.end(), at + 1
                out.append((n_source, source, k, since // block, since, at - since, raw[first:end].decode()))
                if len(out) >= 10_000 or sum(len(o[6]) for o in out[-1:]) > 1 << 20:
                    yield _pieces(out, ids, schema)
                    out = []
            if out:
                yield _pieces(out, ids, schema)

    rows = made.rows.where("size > 0").select("n_source", "source", "doc_id", "begin", "text")
    pieces = rows.mapInArrow(run, f"n_source long, source string, doc_id {kind}, block long, word long, n_words long, text string")
    left = F.col("block") * block + F.col("cut") - F.col("word")  # words that a cut draw takes of the piece
    joined = pieces.join(made.draws.hint("merge"), ["n_source", "block"]).where(F.col("cut").isNull() | (left > 0))
    some = F.regexp_substr(F.col("text"), F.concat(F.lit(f"[^{SPACE}]+([{SPACE}]+[^{SPACE}]+){{"), (left - 1).cast("string"), F.lit("}")))
    text = F.when(F.col("cut").isNull() | (left >= F.col("n_words")), F.col("text")).otherwise(some)
    out = joined.select("shard", "place", "round", "source", "doc_id", "word", text.alias("text"))
    return out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "word")


def _pieces(out: list[tuple], ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    own = ids.take(pa.array(columns[2], pa.int64()))
    kinds = (schema.field(0).type, schema.field(1).type, None, pa.int64(), pa.int64(), pa.int64(), pa.string())
    arrays = [own if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["n_source", "source", "doc_id", "block", "word", "n_words", "text"])
