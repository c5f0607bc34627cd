"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Each window's polynomial hash comes from prefix sums over word hashes, so a
window of any place and length costs two look-ups. Windows that start at two
positions or more, in one document or several, are merged into maximal
intervals of words, which are removed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from batida.llm.repeats import Block, Search, mix, remove_repeats

WINDOW = 35
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2 ** 64


def prefix_hashes(values):
    """hash(i, n): the polynomial hash of values[i : i + n], for arrays i and n."""
    import numpy as np

    n = len(values)
    up = np.full(n + 1, BASE, np.uint64)
    down = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return lambda i, size: (sums[i + size] - sums[i]) * down[i]


def byte_values():
    import numpy as np

    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(texts: list[bytes]):
    """A hash per word of the texts, and where each text begins among the words."""
    import numpy as np

    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    sym = mix(prefix_hashes(byte_values()[joined])(start, stop - start) + (stop - start).astype(np.uint64))
    return sym, np.r_[0, np.searchsorted(start, ends)].astype(np.int64)


def window_names(window: int, gram: int):
    def names(sym):
        import numpy as np

        at = prefix_hashes(sym)
        of = lambda n: mix(at(np.arange(len(sym) - n + 1), n))
        return of(gram), of(window)

    return names


def search(window: int = WINDOW, gram: int | None = None, **more) -> Search:
    gram = gram or (window + 1) // 2
    return Search(window, gram, words, window_names(window, gram), earlier=False, **more)


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept: the words left, joined by one space; one row per row of docs.

    spans lists the removed runs as first word and word after the last. A
    null text has no words. Texts shorter than the window keep all words.
    Rows that repeat, with equal ids or not, are documents of their own, so
    each is a copy of the other. doc_id must be an integer. Other columns are ignored; an empty table
    gives no rows. With digest, kept_sha256 replaces spans and kept. A
    document must fit a task's memory about a hundred times.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def finish(block: Block) -> pa.Table:
        import numpy as np

        gone = block.removed()
        counts, removed, kept, spans = [], [], [], []
        for i, text in enumerate(block.texts):
            mask = gone[block.off[i] : block.off[i + 1]]
            n = int(mask.sum())
            own = text.split()
            left = own if not n else [own[k] for k in np.flatnonzero(~mask)]
            counts.append(len(own))
            removed.append(n)
            edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))) if n else []
            spans.append([[int(a), int(b)] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(b" ".join(left))
        out = {"doc_id": block.docs.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        if digest:
            return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})
        return pa.table(out | {"spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array([k.decode() for k in kept], pa.string())})

    rest = "kept_sha256 string" if digest else "spans array<array<long>>, kept string"
    return remove_repeats(docs, search(window), finish, f"doc_id {kind}, n_words long, n_removed long, {rest}", **sizes)
