"""Repeated windows of a corpus, found by Spark shuffles of window names.

Texts are dealt into blocks by a hash. A window of L symbols is named by a
64-bit number. To avoid shuffling a name per position, each window is first
represented by its anchor: the gram of k symbols in it with the least name
(equal windows have equal anchors). Three rounds narrow the search down:

0. anchor grams: a window whose anchor occurs once occurs once itself;
1. the span of an anchor (all windows it represents, as one string): equal
   spans settle all their windows at once;
2. single windows of anchors whose spans differ.

In each round a block sends every name once, with a value, to the bucket of
that name; the bucket replies to each block with what it summed up. So a
text copied a million times costs a bucket one entry per block, and no task
holds a group of unbounded size. Round 0 sends 4 bytes a name: a false match
there costs time only, as later rounds compare whole names.

Two questions can be asked: does a window start at two positions or more
anywhere (EARLIER false), or also in a document with a smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm.common import text_bytes

BLOCK = 1 << 20  # bytes of text a block holds on average
HOT = 4096  # blocks that share an anchor; its spans are then dealt by span
NONE = (1 << 63) - 1  # in place of a null id: no id is smaller for it

REQUEST = "block long, bucket long, payload binary"
REPLY = "block long, level int, bucket long, payload binary"


@dataclass(frozen=True)
class Search:
    """window, gram: lengths in symbols, gram <= window. symbols(texts) -> (symbols, offsets);
    names(symbols) -> (gram names, window names); earlier: the question asked."""

    window: int
    gram: int
    symbols: Callable[[list[bytes]], tuple[Any, Any]]
    names: Callable[[Any], tuple[Any, Any]]
    earlier: bool
    hot: int = HOT


#: entries worked on at a time, so that they stay in the processor's cache
PIECE = 1 << 14


def mix(x):
    """Spreads the bits of an array of uint64, in place."""
    import numpy as np

    for a in range(0, len(x), PIECE):
        v = x[a : a + PIECE]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x9FB21C651E98DF25)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
    return x


def least_of(x, width: int):
    """Minimum of each `width` consecutive entries."""
    import numpy as np

    out = np.empty(len(x) - width + 1, x.dtype)
    for a in range(0, len(out), PIECE):
        v, done = x[a : a + PIECE + width - 1], 1
        while done < width:
            step = min(done, width - done)
            v = np.minimum(v[:-step], v[step:])
            done += step
        out[a : a + PIECE] = v
    return out


def ranges(starts, ends):
    """All integers of the ranges [start, end], one after the other, and the range each is of."""
    import numpy as np

    size = ends - starts + 1
    of = np.repeat(np.arange(len(starts)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + starts[of], of


class Block:
    """One block of documents and what its anchors are."""

    def __init__(self, search: Search, docs: pa.Table, buckets: int):
        import numpy as np

        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # shuffles deal rows in any order
        self.search, self.buckets, self.docs = search, np.uint64(buckets), docs
        ids = docs.column("doc_id").cast(pa.int64()) if docs.num_rows else pa.chunked_array([[]], pa.int64())
        self.ids = ids.fill_null(NONE).to_numpy().astype(np.int64)
        self.texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
        self.sym, self.off = search.symbols(self.texts)
        self._anchors()

    def _anchors(self) -> None:
        import numpy as np

        length, k, n = self.search.window, self.search.gram, len(self.sym)
        starts = np.zeros(0, np.int64)
        if n >= length:
            room = np.repeat(self.off[1:], np.diff(self.off))[: n - length + 1]
            starts = np.flatnonzero(np.arange(n - length + 1) + length <= room)
        if not len(starts):
            empty = np.zeros(0, np.int64)
            self.start = self.end = self.doc = empty
            self.gram = self.span = self.win = np.zeros(0, np.uint64)
            self._level0()
            return
        gram, self.win = self.search.names(self.sym)
        low = np.uint64(0xFFFF)
        key = (gram & ~low) | (np.arange(len(gram), dtype=np.uint64) & low)  # equal grams: one of them, by position
        least = least_of(key, length - k + 1)[starts]
        at = starts + ((least & low).astype(np.int64) - starts & 0xFFFF)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        self.start, self.end, self.anchor = starts[first], starts[last], at[first]
        self.gram = gram[self.anchor]
        shape = (self.end - self.start).astype(np.uint64) << np.uint64(20) | (self.anchor - self.start).astype(np.uint64)
        span = self.win[self.start] * np.uint64(0xA24BAED4963EE407) + self.win[self.end] * np.uint64(0x9E3779B97F4A7C15)
        self.span = mix(span + shape * np.uint64(0xC2B2AE3D27D4EB4F))
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self._level0()

    def bucket_of(self, names):
        import numpy as np

        return ((names >> np.uint64(32)) % self.buckets).astype(np.int64)

    def _level0(self) -> None:
        """names0: the distinct grams by bucket; of0: the place of each anchor's gram in them."""
        import numpy as np

        names, of, times = np.unique(self.gram, return_inverse=True, return_counts=True)
        order = np.argsort(self.bucket_of(names), kind="stable")
        self.names0, self.bucket0, self.twice0 = names[order], self.bucket_of(names)[order], times[order] > 1
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of0 = place[of] if len(of) else np.zeros(0, np.int64)

    def read0(self, replies: dict[int, bytes]) -> None:
        """What round 0 said: the anchors that are left, and which of them are hot."""
        import numpy as np

        shared, hot = unpacked(self.bucket0, replies, 2)
        left = (shared | self.twice0)[self.of0]
        for name in ("start", "end", "gram", "span", "doc"):
            setattr(self, name, getattr(self, name)[left])
        self.hot = hot[self.of0[left]]
        self._level1()

    def _value(self, doc):
        """What an occurrence adds to a name's value: its document, or one."""
        import numpy as np

        return self.ids[doc] if self.search.earlier else np.ones(len(doc), np.int64)

    def _merged(self, first, value):
        """value per group of consecutive entries, groups beginning at first: least document, or a count up to 2."""
        import numpy as np

        if not len(first):
            return np.zeros(0, np.int64)
        if self.search.earlier:
            return np.minimum.reduceat(value, first)
        return np.minimum(np.add.reduceat(value, first), 2)

    def _level1(self) -> None:
        import numpy as np

        bucket = self.bucket_of(np.where(self.hot, self.span, self.gram))
        order = np.lexsort((self.span, self.gram, bucket))
        g, s, b = self.gram[order], self.span[order], bucket[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (b[1:] != b[:-1])][: len(order)]
        first = np.flatnonzero(new)
        self.gram1, self.span1, self.bucket1, self.hot1 = g[first], s[first], b[first], self.hot[order][first]
        self.value1 = self._merged(first, self._value(self.doc[order]))
        self.of1 = np.empty(len(order), np.int64)
        self.of1[order] = np.cumsum(new) - 1

    def read1(self, replies: dict[int, bytes]) -> None:
        """What round 1 said: whether a span is settled, and whether this block opens it."""
        self.settled1, self.opens1 = unpacked(self.bucket1, replies, 2)
        self._level2()

    def _answered(self, settled, value, doc):
        """Settled by another block, or, of texts in one block, by the one with the least id."""
        return settled | (value < doc) if self.search.earlier else settled

    def _level2(self) -> None:
        """The windows of one occurrence of each span that this block opens."""
        import numpy as np

        mine = self.opens1[self.of1] & ((self.ids[self.doc] == self.value1[self.of1]) if self.search.earlier else True)
        which = np.flatnonzero(mine)
        _, one = np.unique(self.of1[which], return_index=True)
        self.opened = which[one]
        at, of = ranges(self.start[self.opened], self.end[self.opened])
        entry = self.of1[self.opened]
        value = self.value1[entry] if self.search.earlier else np.where(self.settled1[entry], 2, 1)
        names, value = self.win[at], value[of]
        bucket = self.bucket_of(names)
        order = np.lexsort((names, bucket))
        names, bucket = names[order], bucket[order]
        new = np.r_[True, names[1:] != names[:-1]][: len(order)]
        first = np.flatnonzero(new)
        self.names2, self.bucket2, self.value2 = names[first], bucket[first], self._merged(first, value[order])

    def read2(self, replies: dict[int, bytes]) -> None:
        import numpy as np

        (settled,) = unpacked(self.bucket2, replies, 1)
        order = np.argsort(self.names2)
        self.sorted2, self.settled2, self.least2 = self.names2[order], settled[order], self.value2[order]

    def removed(self):
        """A mask over the symbols: those covered by a repeated window."""
        import numpy as np

        n, length = len(self.sym), self.search.window
        edges = np.zeros(n + 1, np.int64)
        doc = self.ids[self.doc]
        covered = self._answered(self.settled1[self.of1], self.value1[self.of1], doc)
        edges += np.bincount(self.start[covered], minlength=n + 1)
        edges -= np.bincount(self.end[covered] + length, minlength=n + 1)
        rest = np.flatnonzero(~covered & self.opens1[self.of1])
        at, of = ranges(self.start[rest], self.end[rest])
        if len(at):
            entry = np.searchsorted(self.sorted2, self.win[at])
            at = at[self._answered(self.settled2[entry], self.least2[entry], doc[rest][of])]
        edges += np.bincount(at, minlength=n + 1)
        edges -= np.bincount(at + length, minlength=n + 1)
        return np.cumsum(edges)[:n] > 0


def send(buckets, *columns) -> pa.Table:
    """bucket, payload: one row per bucket with the columns' entries for it, one column after the other; buckets are sorted."""
    import numpy as np

    number, first = np.unique(buckets, return_index=True)
    cuts = np.r_[first, len(buckets)]
    payload = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"bucket": pa.array(number, pa.int64()), "payload": pa.array(payload, pa.binary())})


def bucket_rows(table: pa.Table, width: int):
    """The payloads of a bucket's rows as memory, and the entries in each; width: bytes an entry takes."""
    import numpy as np

    parts = [memoryview(p) for p in table.column("payload").to_pylist()]
    return parts, np.array([len(p) // width for p in parts], np.int64)


def column(parts, sizes, kind, before: int):
    """The entries of one column of all payloads; before: bytes an entry takes in the columns ahead."""
    import numpy as np

    return np.concatenate([np.frombuffer(p, kind, n, n * before) for p, n in zip(parts, sizes, strict=True)])


def packed(sizes, *masks) -> list[bytes]:
    """The bits of the masks for each payload in turn, each mask padded to whole bytes."""
    import numpy as np

    cuts = np.r_[0, np.cumsum(sizes)]
    return [b"".join(np.packbits(m[a:b]).tobytes() for m in masks) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def unpacked(buckets, replies: dict[int, bytes], masks: int) -> list:
    """The masks of packed(), over all entries of a block; buckets: the bucket of each, sorted."""
    import numpy as np

    out = [[np.zeros(0, bool)] for _ in range(masks)]
    for bucket, n in zip(*np.unique(buckets, return_counts=True), strict=True):
        bits = np.unpackbits(np.frombuffer(replies[bucket], np.uint8)).astype(bool)
        each = len(bits) // masks
        for k in range(masks):
            out[k].append(bits[k * each : k * each + n])
    return [np.concatenate(x) for x in out]


def reply(table: pa.Table, level: int, payloads: list[bytes]) -> pa.Table:
    n = table.num_rows
    return pa.table(
        {"block": table.column("block").cast(pa.int64()), "level": pa.array([level] * n, pa.int32()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array(payloads, pa.binary())}
    )


def shared_names(hot: int):
    """Two bits an entry of 4 bytes: whether another block has it too, and whether `hot` blocks or more have it."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        parts, sizes = bucket_rows(table, 4)
        names = column(parts, sizes, np.uint32, 0)
        _, of, times = np.unique(names, return_inverse=True, return_counts=True)
        times = times[of]
        return reply(table, 0, packed(sizes, times > 1, times >= hot))

    return run


def answer1(search: Search):
    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        parts, sizes = bucket_rows(table, 25)
        gram, span = column(parts, sizes, np.uint64, 0), column(parts, sizes, np.uint64, 8)
        value, hot = column(parts, sizes, np.int64, 16), column(parts, sizes, np.uint8, 24)
        block = np.repeat(table.column("block").to_numpy(), sizes)
        order = np.lexsort((value if search.earlier else block, span, gram))
        g, s = gram[order], span[order]
        new_gram = np.r_[True, g[1:] != g[:-1]]
        new = new_gram | np.r_[True, s[1:] != s[:-1]]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        v = value[order]
        merged = np.minimum.reduceat(v, first) if search.earlier else np.minimum(np.add.reduceat(v, first), 2)
        spans = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))  # different spans of each gram
        mixed = (spans[np.cumsum(new_gram) - 1] > 1) | (hot[order] > 0)
        settled, opens = np.empty(len(order), bool), np.empty(len(order), bool)
        settled[order], opens[order] = merged[of] < v if search.earlier else merged[of] > 1, mixed & new
        return reply(table, 1, packed(sizes, settled, opens))

    return run


def answer2(search: Search):
    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        parts, sizes = bucket_rows(table, 16)
        names, value = column(parts, sizes, np.uint64, 0), column(parts, sizes, np.int64, 8)
        _, of = np.unique(names, return_inverse=True)
        if search.earlier:
            merged = np.full(of.max() + 1, NONE)
            np.minimum.at(merged, of, value)
        else:
            merged = np.minimum(np.bincount(of, value).astype(np.int64), 2)
        return reply(table, 2, packed(sizes, merged[of] < value if search.earlier else merged[of] > 1))

    return run


def remove_repeats(docs: DataFrame, search: Search, finish: Callable[[Block], pa.Table], schema: str, bytes_per_bucket: int = 8 << 20, block_bytes: int = BLOCK) -> DataFrame:
    """finish(block) of every block, with block.removed() at hand; one row per row of docs, as finish makes it.

    The blocks' exchange is one and the same in all rounds, so the texts are
    shuffled once.
    """
    docs = docs.select("doc_id", "text")
    total = text_bytes(docs)
    n_blocks, n_buckets = max(8, math.ceil(total / block_bytes)), max(16, math.ceil(total / bytes_per_bucket))
    # a text without symbols names nothing, so any block will do: however many there are, they are spread
    deal = F.when(F.coalesce("text", F.lit("")) == "", F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "text"))
    blocks = docs.select(F.pmod(deal, F.lit(n_blocks)).alias("block"), "doc_id", "text")
    by_block = blocks.groupBy("block")

    def number(key) -> int:
        return key[0].as_py()

    def sent(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return table.add_column(0, "block", pa.array([number(key)] * table.num_rows, pa.int64()))

    def replies(table: pa.Table) -> list[dict[int, bytes]]:
        out: list[dict[int, bytes]] = [{}, {}, {}]
        for level, bucket, payload in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True):
            out[level][bucket] = payload
        return out

    def ask0(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        b = Block(search, table, n_buckets)
        return sent(key, send(b.bucket0, b.names0.astype(np.uint32)))

    def ask1(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        import numpy as np

        b = Block(search, table, n_buckets)
        b.read0(replies(said)[0])
        return sent(key, send(b.bucket1, b.gram1, b.span1, b.value1, b.hot1.astype(np.uint8)))

    def ask2(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b, r = Block(search, table, n_buckets), replies(said)
        b.read0(r[0])
        b.read1(r[1])
        return sent(key, send(b.bucket2, b.names2, b.value2))

    def last(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        b, r = Block(search, table, n_buckets), replies(said)
        b.read0(r[0])
        b.read1(r[1])
        b.read2(r[2])
        return finish(b)

    said0 = by_block.applyInArrow(ask0, REQUEST).groupBy("bucket").applyInArrow(shared_names(search.hot), REPLY)
    said1 = by_block.cogroup(said0.groupBy("block")).applyInArrow(ask1, REQUEST).groupBy("bucket").applyInArrow(answer1(search), REPLY)
    said01 = said0.unionByName(said1)
    said2 = by_block.cogroup(said01.groupBy("block")).applyInArrow(ask2, REQUEST).groupBy("bucket").applyInArrow(answer2(search), REPLY)
    return by_block.cogroup(said01.unionByName(said2).groupBy("block")).applyInArrow(last, schema)
