"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model file is written here, from a vocabulary of ranked byte strings:
each byte is mapped to one printable character, a token becomes the piece of
its mapped bytes, scored by its negative rank, and the normaliser is the
identity. Pre-tokens (matches of the split pattern) are encoded one by one;
decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm.common import add_from_texts

CACHE = 16 << 20  # characters and ids of pre-tokens that one task remembers


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def byte_characters() -> list[str]:
    """One printable character per byte, none of them white space."""
    return [chr(b) if 33 <= b <= 126 else chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes, float or integer."""
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown piece; rank r is piece r + 1."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    # Field numbers and enum values of the public model format.
    piece, score, kind = 1, 2, 3
    unknown = 2
    model_type, bpe, vocab_size = 3, 2, 4
    add_dummy_prefix, remove_extra, escape_white = 3, 4, 5
    out = [_field(1, _field(piece, b"<unk>") + _field(score, 0.0) + _field(kind, unknown))]
    for token, rank in by_rank:
        out.append(_field(1, _field(piece, "".join(chars[b] for b in token).encode()) + _field(score, float(-rank))))
    trainer = _field(model_type, bpe) + _field(vocab_size, len(by_rank) + 1)
    normaliser = _field(1, b"identity") + _field(add_dummy_prefix, 0) + _field(remove_extra, 0) + _field(escape_white, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes one text at a time; made once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, bytes] = {}  # the ids of a pre-token, four bytes each
        self.held = 0

    def encode(self, text: str):
        """The ids of a text, as an array."""
        import numpy as np

        parts, known = self.split(text), self.known
        new = list({p for p in parts if p not in known})
        if new:
            if self.held > CACHE:
                known.clear()
                self.held, new = 0, list(set(parts))
            mapped = ["".join(map(self.chars.__getitem__, p.encode())) for p in new]
            found = self.model.encode(mapped, num_threads=1)
            flat, end = (np.fromiter(chain.from_iterable(found), np.int32) - np.int32(1)).tobytes(), 0
            for part, ids in zip(new, found, strict=True):
                begin, end = end, end + 4 * len(ids)
                known[part] = flat[begin:end]
                self.held += len(part) + end - begin
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, decoded: bool = True) -> DataFrame:
    """The columns of docs with n_tokens, ids and decoded (bytes, if asked for), in the ranks of the file at path.

    A null text counts as empty: no ids, no bytes. Rows with equal ids are
    encoded one by one, and there are no ties; columns that have the names of
    the new ones give way; an empty table gives no rows. A task holds about
    SLICE bytes of text and their ids, or one longer text and its ids.
    """

    def make():
        import numpy as np

        codec = Codec(read_ranks(path), pattern)

        def work(texts: list) -> list:
            ids = [codec.encode(t or "") for t in texts]
            sizes = [len(x) for x in ids]
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
            return [sizes, lists] + ([[codec.decode(x) for x in ids]] if decoded else [])

        return work

    added = {"n_tokens": "long", "ids": "array<int>"} | ({"decoded": "binary"} if decoded else {})
    return add_from_texts(docs, added, make)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents, digested within the task."""

    def make():
        codec = Codec(read_ranks(path), pattern)

        def work(texts: list) -> list:
            n, spoken, back = [], [], []
            for t in texts:
                ids = codec.encode(t or "")
                n.append(len(ids))
                spoken.append(hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return [n, spoken, back]

        return work

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return add_from_texts(docs.select("doc_id", "text"), added, make).drop("text")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; a null list of ids gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [t for t, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {kind}, text string")
