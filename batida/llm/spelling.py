"""Spelling variants: each word's full neighbourhood at one edit, hash-joined to the vocabulary.

Words are counted over whole texts; tasks count slices of text, Spark adds up.
Then every word of the vocabulary makes all distinct strings that one
deletion, replacement or insertion over the observed alphabet gives. These
are enumerated as hashes, from those of a word's beginnings and ends; a
Bloom filter of the vocabulary, of at most MOST_BITS bits however large the
vocabulary is, lets pass those that may be words. What passes is spelled out
and hash-joined to the vocabulary, so equality of strings decides and no
distance is computed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batida.llm.common import materialize

LETTERS = "A-Za-zÀ-ÿ"  # fixed: what a word consists of
DAMAGED = 97  # fixed: one word in so many loses a letter
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2  # of words, and how much more frequent a form is

SLICE = 4 << 20  # bytes of text that are counted at a time
SHORT = 64  # bytes of a word, up to which its crc32 is put together from tables
LONG = 256  # code points; longer words are joined by their digest
BASE = 0x9E3779B97F4A7C15  # of the polynomial hash, odd
SPREAD = 0xD6E8FEB86659FD93
LEAST_BITS, MOST_BITS, BITS_PER_WORD, PROBES = 1 << 16, 1 << 28, 64, 4


def _cuts(text: bytes) -> Iterator[bytes]:
    """text in pieces of about SLICE bytes; no word is cut."""
    import re

    edge = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f\xc2\xc4-\xf4]")  # where a character begins that is no letter
    begin = 0
    while len(text) - begin > SLICE:
        found = edge.search(text, begin + SLICE)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


def _crc_table():
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


def count_slice(parts: list[tuple[str, bytes]]) -> tuple[pa.Array, pa.Array]:
    """Words of at least LEAST_LENGTH code points after the damage, and their counts, of (doc_id, text) parts."""
    import numpy as np

    raw = np.frombuffer(b"\0".join([t for _, t in parts]) + b"\0", np.uint8)
    plain = (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122)
    lead = raw == 0xC3  # leads U+00C0 to U+00FF, all of them letters here
    letter = plain | lead
    letter[1:] |= lead[:-1]
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return pa.array([], pa.string()), pa.array([], pa.int64())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(lower[letter].tobytes())]).dictionary_encode()
    at, known = words.indices.to_numpy(), words.dictionary
    raws = known.cast(pa.large_binary()).to_pylist()
    begins = np.cumsum([0] + [len(t) + 1 for _, t in parts[:-1]])
    doc = np.searchsorted(begins, starts, "right") - 1

    # crc32 of a + b is that of a, moved on by the length of b, xor that of b
    table, heads = _crc_table(), [f"{i}:".encode() for i, _ in parts]
    moved = [np.array([zlib.crc32(h) for h in heads], np.uint32)]
    for _ in range(SHORT):
        moved.append((moved[-1] >> 8) ^ table[moved[-1] & 255])
    own = np.fromiter((zlib.crc32(w) for w in raws), np.uint32, len(raws))
    crc = np.stack(moved)[np.minimum(sizes, SHORT), doc] ^ own[at]
    for k in np.flatnonzero(sizes > SHORT).tolist():
        crc[k] = zlib.crc32(raws[at[k]], int(moved[0][doc[k]]))

    hit = crc % DAMAGED == 0
    counts = np.bincount(at[~hit], minlength=len(raws))
    keep = (counts > 0) & (pc.utf8_length(known).to_numpy(zero_copy_only=False) >= LEAST_LENGTH)
    changed: Counter = Counter()
    for k in np.flatnonzero(hit).tolist():
        word = raws[at[k]].decode()
        lost = int(crc[k]) % len(word)
        changed[word[:lost] + word[lost + 1 :]] += 1
    more = {w: n for w, n in changed.items() if len(w) >= LEAST_LENGTH}
    found = known.filter(pa.array(keep)).cast(pa.string())
    return pa.concat_arrays([found, pa.array(more, pa.string())]), pa.concat_arrays([pa.array(counts[keep], pa.int64()), pa.array(more.values(), pa.int64())])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts, after the damage that crc32 of doc_id:word decides; a null doc_id is written as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*count_slice(parts)], names=["word", "n"])

        for batch in batches:
            parts, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in _cuts(text.as_py() or b""):
                    parts.append((doc_id, piece))
                    held += len(piece)
                    if held >= SLICE:
                        yield counted(parts)
                        parts, held = [], 0
            if parts:
                yield counted(parts)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int):
    import numpy as np

    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])


def _codes(words: list[str]):
    """Code points of words of one length, one row a word."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


class Filter:
    """A Bloom filter of hashes: 64-bit words of bits."""

    def __init__(self, bits):
        self.bits = bits

    @staticmethod
    def places(hashes, n_bits: int) -> list:
        """The bits of each hash; they differ in how the hash is spread."""
        import numpy as np

        shift = np.uint64(64 - (n_bits.bit_length() - 1))
        out, h = [], hashes
        for _ in range(PROBES):
            h = h * np.uint64(SPREAD)
            out.append(h >> shift)
            h = h ^ (h >> np.uint64(29))
        return out

    def passing(self, hashes):
        """Indices into the flat hashes that all probes find."""
        import numpy as np

        one, low = np.uint64(1), np.uint64(63)
        shift = np.uint64(64 - (len(self.bits) * 64).bit_length() + 1)
        at, h = None, hashes
        for _ in range(PROBES):
            h = h * np.uint64(SPREAD)
            place = h >> shift
            found = np.flatnonzero((self.bits[place >> np.uint64(6)] >> (place & low)) & one)
            at = found if at is None else at[found]
            h = h[found]
            h = h ^ (h >> np.uint64(29))
        return at


def _hashes(codes):
    """Polynomial hash of each row, and of each beginning of each row."""
    import numpy as np

    begun = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        begun[:, k + 1] = begun[:, k] * np.uint64(BASE) + codes[:, k]
    return begun[:, -1], begun


def neighbours(words: list[str], alphabet: str, lengths: dict[int, int], known: Filter) -> Iterator[tuple[int, str]]:
    """(index of a word, string) for every distinct string at one edit from it that the filter lets pass.

    lengths: how many words of each length there are; strings of a length that
    no other word has are left out.
    """
    import numpy as np

    letters = np.array([ord(c) for c in alphabet], np.uint64)
    for size, where in _by_length(words).items():
        same, less, more = lengths.get(size, 0) > 1, size - 1 in lengths, size + 1 in lengths
        if not (same or less or more):
            continue
        step = max(1, (1 << 22) // (size + 1))  # words at a time, so that the table of beginnings stays small
        for begin in range(0, len(where), step):
            rows = where[begin : begin + step]
            codes = _codes([words[k] for k in rows])
            whole, begun = _hashes(codes)
            power = _powers(size + 1)
            for i in range(size + 1):
                head, rest = begun[:, i], whole - begun[:, i] * power[size - i]  # rest: from place i on
                if same and i < size:
                    h = whole[:, None] + (letters[None, :] - codes[:, i, None]) * power[size - 1 - i]
                    for w, c in zip(*np.divmod(known.passing(h.ravel()), len(letters)), strict=True):
                        if alphabet[c] != words[rows[w]][i]:
                            yield rows[w], words[rows[w]][:i] + alphabet[c] + words[rows[w]][i + 1 :]
                if more:
                    h = (head * power[size + 1 - i] + rest)[:, None] + letters[None, :] * power[size - i]
                    for w, c in zip(*np.divmod(known.passing(h.ravel()), len(letters)), strict=True):
                        word = words[rows[w]]
                        if i == 0 or word[i - 1] != alphabet[c]:  # else made at the place before
                            yield rows[w], word[:i] + alphabet[c] + word[i:]
                if less and i < size:
                    for w in known.passing(head * power[size - 1 - i] + rest - codes[:, i] * power[size - 1 - i]):
                        word = words[rows[w]]
                        if i == 0 or word[i - 1] != word[i]:
                            yield rows[w], word[:i] + word[i + 1 :]


def _key(word: Column) -> Column:
    """What words are joined by: the word, or the digest of a long one."""
    return F.when(F.length(word) > LONG, F.concat(F.lit("#"), F.sha2(word, 256))).otherwise(word)


def bloom(words: DataFrame, n_words: int) -> Filter:
    """The filter of all words. Its bits are set in tasks and put together by Spark; the driver gets MOST_BITS bits at most."""
    import numpy as np

    n_bits = min(max(LEAST_BITS, 1 << (max(n_words, 1) * BITS_PER_WORD - 1).bit_length()), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch_words = batch.column(0).to_pylist()
            for where in _by_length(batch_words).values():
                whole, _ = _hashes(_codes([batch_words[k] for k in where]))
                place = np.concatenate(Filter.places(whole, n_bits))
                at, back = np.unique(place >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(at), np.uint64)
                np.bitwise_or.at(bits, back, np.uint64(1) << (place & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    parts = words.select("word").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[parts["at"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return Filter(bits)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words at one edit, in both directions. words: word, n, each word once."""
    spark = words.sparkSession
    shape = words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["size"]: r["n"] for r in shape.collect()}  # distinct lengths: as many as the square root of the text's size, at most
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # 90 at most
    known = spark.sparkContext.broadcast(bloom(words, sum(lengths.values())).bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            batch_words = batch.column(0).to_pylist()
            at, keys = [], []

            def out(at=at, keys=keys, batch=batch) -> pa.RecordBatch:
                own = batch.take(pa.array(at, pa.int64()))
                made = pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, pa.string())], names=["word", "n", "key"])
                at.clear(), keys.clear()
                return made

            for k, text in neighbours(batch_words, alphabet, lengths, Filter(known.value)):
                at.append(k)
                keys.append(text if len(text) <= LONG else "#" + hashlib.sha256(text.encode()).hexdigest())
                if len(at) >= 10_000:
                    yield out()
            if at:
                yield out()

    made = words.select("word", "n").mapInArrow(run, "word string, n long, key string")
    vocabulary = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), _key(F.col("word")).alias("key"))
    return made.join(vocabulary, "key").drop("key")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead in the end.

    Each turn doubles the steps that a word has taken. A form is at least
    twice as frequent as its word, so there are no circles.
    """
    ahead = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        after = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ahead.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        ahead = materialize(moved, instead_of=ahead)
        if ahead.where("moved").isEmpty():
            return ahead.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts of docs (doc_id, text).

    Words are at least LEAST_LENGTH code points long and occur LEAST_COUNT
    times or more after the damage. Null and empty texts have no words; ties
    of forms go to the smallest in code-point order; repeated rows count each;
    other columns are ignored; an empty table gives no rows. Texts are counted
    in pieces, so only a single word must fit a task's memory, some fifty
    times.
    """
    words = materialize(word_counts(docs).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = F.when(-F.col("best.less") >= TIMES * F.col("n"), -F.col("best.less"))
    linked = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form_n.isNotNull(), F.col("best.near")).alias("form"), form_n.alias("form_n")
    )
    linked = materialize(linked)
    found = roots(linked.where("form IS NOT NULL"))
    return linked.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for variants(): crc32 byte by byte, neighbours by cutting out each letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{upper}', '{upper.lower()}') AS w FROM documents),
own AS (SELECT w, hex(encode(i || ':' || w)) AS x, count(*) AS n FROM runs GROUP BY ALL),
crc AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM own, bits),
damaged AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
cut AS (SELECT word, n, k, substr(word, 1, k - 1) AS head, substr(word, k + 1) AS tail FROM places),
less AS (SELECT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cut c JOIN words w ON w.word = c.head || c.tail),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT long, long_n, short, short_n FROM less UNION SELECT short, short_n, long, long_n FROM less),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
linked AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
ways AS (SELECT word, word AS root, 0 AS step FROM linked UNION ALL SELECT ways.word, linked.form, step + 1 FROM ways JOIN linked ON linked.word = ways.root WHERE linked.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN roots USING (word)"""
