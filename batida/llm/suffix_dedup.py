"""Suffix-array dedup by prefix doubling, for strings up to a threshold.

Every byte position gets a rank that names its prefix. Ranks of length 1 are
the bytes; a rank of length 2m is made of the pair (rank at i, rank at
i + m). Lengths 1 to 32 are doubled within a block, as ranks there depend on
the bytes alone. From then on Spark compares ranks over the corpus: positions
whose rank of length 32 is unique drop out; for the rest the last step, at an
offset of 18, gives the rank of length 50, the threshold. Buckets sort the
(rank, document) pairs and merge equal ranks into the least document. Of the
positions, one anchor per run of windows is compared first (see repeats).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from batida.llm.repeats import PIECE, Block, Search, mix, remove_repeats
from batida.llm.substring_dedup import byte_values

THRESHOLD = 50


def text_bytes_of(texts: list[bytes]):
    import numpy as np

    sym = np.frombuffer(b"".join(texts), np.uint8)
    return sym, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def paired(rank, offset: int):
    """Ranks of the pairs (rank at i, rank at i + offset)."""
    import numpy as np

    out = rank[: len(rank) - offset] * np.uint64(0xA24BAED4963EE407)
    out += rank[offset:]
    out ^= out >> np.uint64(31)
    return out


def doubled(threshold: int):
    """The largest power of two below the threshold, whose doubled offset reaches it."""
    gram = 1
    while 2 * gram < threshold:
        gram *= 2
    return gram


def rank_names(threshold: int):
    gram = doubled(threshold)

    def names(sym):
        import numpy as np

        values = byte_values()
        short, long = np.empty(len(sym) - gram + 1, np.uint64), np.empty(len(sym) - threshold + 1, np.uint64)
        for a in range(0, len(short), PIECE):  # pieces overlap by the longest rank
            rank, m = values[sym[a : a + PIECE + threshold - 1]], 1
            while m < gram:
                rank = paired(rank, m)
                m *= 2
            short[a : a + PIECE] = mix(rank[:PIECE].copy())
            if len(rank) > threshold - gram:
                end = paired(rank, threshold - gram)
                long[a : a + PIECE] = mix(end[:PIECE].copy())
        return short, long

    return names


def search(threshold: int = THRESHOLD, **more) -> Search:
    return Search(threshold, doubled(threshold), text_bytes_of, rank_names(threshold), earlier=True, **more)


def dedup(docs: DataFrame, threshold: int = THRESHOLD, digest: bool = False, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (the bytes left); one row per row of docs.

    A byte goes if a string of `threshold` bytes over it also starts in a
    document with a smaller doc_id. Rows with one doc_id do not remove each
    other's bytes. A null doc_id counts as larger than all others; a null
    text is empty. doc_id must be an integer. Other columns are ignored; an empty table gives no rows.
    With digest, kept_sha256 replaces spans and kept. A document must fit a
    task's memory about a hundred times.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def finish(block: Block) -> pa.Table:
        import numpy as np

        gone = block.removed()
        removed, spans, kept = [], [], []
        for i, text in enumerate(block.texts):
            mask = gone[block.off[i] : block.off[i + 1]]
            n = int(mask.sum())
            edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))) if n else []
            removed.append(n)
            spans.append([[int(a), int(b)] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text)
        long = lambda x: pa.array(x, pa.int64())
        out = {"doc_id": block.docs.column("doc_id"), "n_bytes": long([len(t) for t in block.texts]), "n_removed": long(removed), "n_spans": long([len(s) for s in spans])}
        if digest:
            return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})
        return pa.table(out | {"spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())})

    rest = "kept_sha256 string" if digest else "spans array<array<long>>, kept binary"
    return remove_repeats(docs, search(threshold), finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {rest}", **sizes)
