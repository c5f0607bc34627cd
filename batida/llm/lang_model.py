"""LM scoring by online logistic context mixing.

A token is its bytes and a closing mark, coded bit by bit. Predictors for a
bit are counts of ones and zeros under hashed contexts: the last one, two,
three and five bytes of the word and its whole beginning, each with the bits
of the current byte so far. The predictions are stretched, weighted by a
weight set that a gate picks, summed and squashed; an adaptive table then
refines the result. Weights and table are trained online over the
vocabulary, each word predicted without its own counts. The counts cover
each word that any training text has.

The mixed model spells words; how often known words come is counted exactly.
With d the share that single words leave to unseen ones,

    P(word) = (max(c - d, 0) + d * V * P_spelled(word)) / N

which sums to 1 over all words. Where running text is coded, words that training
has not seen share the chance u = (once + 1) / (N + 2), from how many words came
once, as they are spelled, and a known word has (1 - u) * c / N: no known word
is spelled, and all chances add up to 1 at most. The same is counted for the texts of each
language, resting on P in place of P_spelled. An expert for the order of words
takes the hashed context of the word before: how often training texts go on
with the token after that word, resting on P as well. Where running text is
coded (running), bit_mixer's chance of the token takes its place. These experts and one
for the words of the text itself are mixed online: each has the weight that
its predictions of the text's last MEMORY tokens earned. The language of the
text that is scored is not looked at.

Texts are packed into blocks of tokens where they are read. Blocks send their distinct words to the buckets of the words and
are sent back counts and log probability; distinct pairs of neighbours go to
buckets of their own by 32 bits of their hash, beside the bucket's. So no task
and no driver holds the vocabulary or the pairs, and tables of pairs grow with
the texts.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm import bit_mixer
from batida.llm.common import held_out, text_bytes
from batida.llm.repeats import REQUEST, mix
from batida.llm.substring_dedup import prefix_hashes

FOLDS = 10
BLOCK = 8 << 20  # bytes of text a block holds on average
BUCKET = 32 << 20  # bytes of text per bucket of the vocabulary
PAIR_BUCKET = 8 << 20  # and of pairs
SLOTS = (1 << 16, 1 << 17, 1 << 17, 1 << 17, 1 << 17)  # of each predictor's table; the first is exact
CHUNK = 1 << 16
END = 32  # the byte that closes a word; no word has it
PLACES, SEEN = 4, 6  # gates: place in the word, and how many contexts were seen before
BINS = 33  # of the refining table
STEP = 1 << 14  # bytes of words worked on at a time, so that arrays stay in the processor's cache
TRAINED_AT_ONCE = 1024  # words between two updates of the weights
MEMORY = 20  # tokens that experts are judged by
SLICE = 1 << 15  # tokens whose experts are mixed at a time, so that arrays stay in the processor's cache
HOT_BYTES = 8 << 20  # bytes of text that frequent words are looked up in
HOT_SHARE = 1 << 14  # a word is frequent if it comes more than once in so many bytes
OWN = 0.8  # share of the text's own words in the expert for them
FOLLOW = 0.8  # share of what followed a word in the expert for the order of words
INPUTS = len(SLOTS) + 1  # and a bias
GATES = PLACES * SEEN


def contexts(joined, start, place):
    """A hash per byte and predictor; joined: words, each closed by END."""
    import numpy as np

    n = len(joined)
    before = []
    for k in range(1, 6):
        b = np.full(n, END, np.uint64)
        b[k:] = joined[:-k] if k < n else joined[:0]
        before.append(np.where(place >= k, b, np.uint64(END)))
    out, packed = [], np.zeros(n, np.uint64)
    for k in range(5):
        packed = packed | before[k] << np.uint64(8 * k)
        if k in (0, 1, 2, 4):
            out.append(packed.copy())
    out.append(prefix_hashes(joined.astype(np.uint64) + np.uint64(1))(start, place) + place.astype(np.uint64))
    return out


def coded(words: list[bytes]):
    """joined bytes, word index and place of each byte."""
    import numpy as np

    joined = np.frombuffer(b"".join([w + b" " for w in words]), np.uint8)
    size = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    start = first[word]
    return joined, word, start, np.arange(len(joined)) - start


def steps(words: list[bytes], step: int = STEP):
    """(from, to) runs of words of about `step` bytes."""
    begin = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= step:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(words):
        yield begin, len(words)


def bits(words: list[bytes]):
    """For each of the 8 bits of the bytes: word, place, bit, slots of all predictors."""
    import numpy as np

    joined, word, start, place = coded(words)
    first, *ctx = contexts(joined, start, place)
    byte, first = joined.astype(np.int64), first.astype(np.int64) << 8
    # a context is hashed once; its nodes are apart by an odd factor
    hashed = [(mix(c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 56)) & np.uint64(size - 1)).astype(np.int64) for k, (c, size) in enumerate(zip(ctx, SLOTS[1:], strict=True), 1)]
    for j in range(8):
        node = (1 << j) | byte >> (8 - j)
        slots, base, apart = [first + node], SLOTS[0], node * 0x9E3B
        for h, size in zip(hashed, SLOTS[1:], strict=True):
            slots.append(base + ((h ^ apart) & size - 1))
            base += size
        yield word, place, byte >> (7 - j) & 1, slots


def stretch(n0, n1):
    import numpy as np

    return np.log((n1 + 0.4) / (n0 + 0.4))


def told(n0, n1):
    """stretch() in little room; exactly 0 where there are no counts, and there alone."""
    import numpy as np

    x = stretch(n0, n1).astype(np.float32)
    return np.where((x == 0) & (n0 + n1 > 0), np.float32(1e-9), x)


def mixed(place, inputs, weights):
    """Gate and logit of each bit; inputs: of told(), without the bias."""
    import numpy as np

    gate, w = np.minimum(place, PLACES - 1) * SEEN, weights.astype(np.float32)
    for x in inputs:
        gate += x != 0
    logit = w[:, -1].take(gate)
    for k, x in enumerate(inputs):
        logit += w[:, k].take(gate) * x
    return gate, logit


def refined(gate, logit, table):
    """Logit after the refining table: the mean of both."""
    import numpy as np

    at = np.clip(np.round(logit * 2).astype(np.int64) + BINS // 2, 0, BINS - 1)
    return (logit + table.ravel().take(gate * BINS + at)) / 2


def start_table():
    import numpy as np

    return np.tile((np.arange(BINS) - BINS // 2) / 2.0, (GATES, 1))


def train(words: list[bytes], counts) -> tuple:
    """Weights and refining table after one pass over the words."""
    import numpy as np

    weights = np.full((GATES, INPUTS), 1.2 / len(SLOTS))
    weights[:, -1] = 0
    ones, zeros = np.zeros((GATES, BINS)), np.zeros((GATES, BINS))
    n0, n1 = counts
    without = np.stack([told(np.maximum(n0 - 1, 0), n1), told(n0, np.maximum(n1 - 1, 0))], 1).ravel()  # by slot and bit: without the word itself
    begun, rate = 0, 0.5
    for begin in range(0, len(words), TRAINED_AT_ONCE):
        for _, place, bit, slots in bits(words[begin : begin + TRAINED_AT_ONCE]):
            inputs = [without.take(2 * s + bit) for s in slots]
            gate, logit = mixed(place, inputs, weights)
            miss = bit - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            times = np.maximum(np.bincount(gate, minlength=GATES), 1)
            for k, x in enumerate([*inputs, 1]):
                weights[:, k] += rate * np.bincount(gate, miss * x, GATES) / times / 8
            if begun >= 8:  # the weights have settled somewhat
                at = gate * BINS + np.clip(np.round(logit * 2).astype(np.int64) + BINS // 2, 0, BINS - 1)
                both = np.bincount(at * 2 + bit, minlength=2 * GATES * BINS).reshape(GATES, BINS, 2)
                zeros += both[:, :, 0]
                ones += both[:, :, 1]
        begun, rate = begun + 1, max(0.05, rate * 0.97)
    return weights, ones, zeros


def spelled(words: list[bytes], counts, weights, table):
    """Natural log of P_spelled of each word."""
    import numpy as np

    out = np.zeros(len(words))
    bold = told(*counts)
    for a, b in steps(words):
        for word, place, bit, slots in bits(words[a:b]):
            gate, logit = mixed(place, [bold.take(s) for s in slots], weights)
            logit = np.clip(refined(gate, logit, table), -20, 20)
            out[a:b] -= np.bincount(word, np.log1p(np.exp(np.where(bit == 1, -logit, logit))), b - a)
    return out


def grouped(values, low: int) -> tuple:
    """Distinct values but for their low bits, in order, where the run of each begins, and the places of all values in that order."""
    import numpy as np

    mask = np.uint64((1 << low) - 1)
    both = np.sort((values & ~mask) | np.arange(len(values), dtype=np.uint64))
    high = both & ~mask
    first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]][: len(high)])
    return high[first], first, (both & mask).astype(np.int64)


def packed_texts(docs: pa.Table) -> bytes:
    """The tokens of a block of texts: what is kept of each row, the number of each token's word, and the words; frequent words have small numbers."""
    import numpy as np
    import zstandard

    place: dict[bytes, int] = defaultdict(itertools.count().__next__)
    place[b""]  # the end of a text
    tokens: list[int] = []
    sizes, n_bytes = [], []
    for text in docs.column("text").cast(pa.binary()).to_pylist():
        text = text or b""
        own = text.lower().split()
        tokens += map(place.__getitem__, own)
        tokens.append(0)
        sizes.append(len(own) + 1)
        n_bytes.append(len(text))
    number, words = np.array(tokens, np.int64), list(place)
    order = np.argsort(-np.bincount(number, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    rows = docs.drop_columns(["text"]).append_column("n_tokens", pa.array(sizes, pa.int64())).append_column("n_bytes", pa.array(n_bytes, pa.int64()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    parts = [sink.getvalue().to_pybytes(), squeezed(rank[number]), zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[i] for i in order]))]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def cut_into_blocks(batches, block_bytes: int):
    """Tables of about block_bytes of text, whole rows in the order they come."""
    import numpy as np
    import pyarrow.compute as pc

    rest, most = None, block_bytes * 3 // 2
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, new]) if rest is not None else new
        ends = np.cumsum(pc.binary_length(rest.column("text")).fill_null(0).to_numpy().astype(np.int64))
        begin = 0
        while begin < len(ends) and ends[-1] - (held := ends[begin - 1] if begin else 0) >= most:
            end = int(np.searchsorted(ends, held + block_bytes)) + 1
            yield rest.slice(begin, end - begin)
            begin = end
        rest = rest.slice(begin)
    if rest is not None and rest.num_rows:
        yield rest


class Texts:
    """The tokens of a block: distinct words in a fixed order, dealt into buckets."""

    def __init__(self, payload: bytes, buckets: int, by_path: bool = False):
        """payload: of packed_texts(); by_path: words of one path (bit_mixer) are in one bucket."""
        import numpy as np
        import xxhash
        import zstandard

        at = 24 + np.cumsum(np.r_[0, np.frombuffer(payload, np.int64, 3)])
        rows, tokens, words = (payload[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
        self.rows = pa.ipc.open_stream(rows).read_all()
        words = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
        name = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        bucket = ((name >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24) if by_path else name % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((name, bucket))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.bucket = [words[i] for i in order], bucket[order]
        self.name, self.end = name[order], int(rank[words.index(b"")])
        self.tokens, self.sizes = rank[unsqueezed(tokens)], self.rows.column("n_tokens").to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.held = self.rows.column("held").to_numpy(zero_copy_only=False).astype(bool)

    def counts(self, languages: int):
        """How often the block's training texts have each word, by language."""
        import numpy as np

        language = self.rows.column("language").to_numpy()
        return np.stack([np.bincount(self.tokens[np.repeat(~self.held & (language == k), self.sizes)], minlength=len(self.words)) for k in range(languages)])

    def pairs(self) -> tuple:
        """Hashes of the distinct pairs of neighbours, in order, their training counts, which pair each token ends, and the token before each.

        The end of a text stands before the first token as well. Hashes and
        places are sorted as one number each, the place in its low bits.
        """
        import numpy as np

        before = np.r_[self.end, self.tokens[:-1]]
        before[self.first] = self.end
        hashes = mix(self.name[before] * np.uint64(0xA24BAED4963EE407) + self.name[self.tokens])
        distinct, first, place = grouped(hashes, max(1, (len(hashes) - 1).bit_length()))
        learned = np.repeat(~self.held, self.sizes)[place].astype(np.int64)
        pair = np.empty(len(hashes), np.int64)
        pair[place] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(hashes)]))
        return distinct, np.add.reduceat(learned, first), pair, before

    def nodes(self, hot, buckets: int) -> bit_mixer.Nodes:
        """Contexts and paths of all tokens; hot: hashes of frequent words. The end of a text stands before the first token as well."""
        import numpy as np

        before = np.r_[self.end, self.tokens[:-1]]
        before[self.first] = self.end
        return bit_mixer.Nodes(self.name, self.tokens, before, np.repeat(~self.held, self.sizes), np.isin(self.name, hot), buckets)

    def cuts(self):
        import numpy as np

        number, first = np.unique(self.bucket, return_index=True)
        return number, np.r_[first, len(self.bucket)]


def pair_places(hashes, buckets: int) -> tuple:
    """Bucket and 32-bit key of each hash; in order of the hashes, buckets and their keys are in order."""
    import numpy as np

    at = (hashes >> np.uint64(24)) * np.uint64(buckets)
    return (at >> np.uint64(40)).astype(np.int64), (at >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def squeezed(values) -> bytes:
    """uint32 values, byte by byte of their places, so that high bytes, mostly alike, take no room."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(data: bytes):
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def pair_requests(t: Texts, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, payload) of a block: keys in order, by their differences, and training counts."""
    import numpy as np

    hashes, counts, _, _ = t.pairs()
    bucket, key = pair_places(hashes, buckets)
    out = []
    for b, begin, n in zip(*np.unique(bucket, return_index=True, return_counts=True), strict=True):
        keys = squeezed(np.diff(key[begin : begin + n], prepend=np.uint32(0)))
        out.append((int(b), len(keys).to_bytes(8, "little") + keys + squeezed(np.minimum(counts[begin : begin + n], 0xFFFFFFFF))))
    return out


def pair_answers(table: pa.Table) -> pa.Table:
    """How often each request's pairs come in all training texts."""
    import numpy as np

    keys, counts = [], []
    for payload in table.column("payload").to_pylist():
        n = int.from_bytes(payload[:8], "little")
        keys.append(np.cumsum(unsqueezed(payload[8 : 8 + n]), dtype=np.uint32))
        counts.append(unsqueezed(payload[8 + n :]))
    every = np.concatenate(keys).astype(np.uint64) << np.uint64(32)
    _, first, place = grouped(every, 32)
    sums = np.add.reduceat(np.concatenate(counts).astype(np.int64)[place], first)
    total = np.empty(len(every), np.int64)
    total[place] = np.repeat(sums, np.diff(np.r_[first, len(every)]))
    cuts = np.cumsum([0] + [len(k) for k in keys])
    payloads = [squeezed(np.minimum(total[a:b], 0xFFFFFFFF)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array(payloads, pa.binary())})


def follows(counts, before, pair_counts, rest):
    """Natural log of each token's chance after the word before it; counts: of the distinct words, pair_counts: of each token's pair."""
    import numpy as np

    seen = counts[before]
    # pairs that share a key are taken for one another, so there may be more of them than of the word
    share = np.minimum(pair_counts, seen) / np.maximum(seen, 1)
    return np.log(np.where(seen > 0, FOLLOW * share + (1 - FOLLOW) * rest, rest) + 1e-300)


def opened(payload: bytes) -> tuple:
    """counts by language and words of one block's request."""
    import numpy as np
    import zstandard

    payload = zstandard.ZstdDecompressor().decompress(payload)
    languages, n = np.frombuffer(payload, np.int64, 2).tolist()
    return np.frombuffer(payload, np.uint32, languages * n, 16).reshape(languages, n), payload[16 + 4 * languages * n :].split(b"\n")


def vocabulary(payloads: list[bytes]):
    """Distinct words of all requests, in no order, their counts by language over the corpus, and each request's places."""
    import numpy as np

    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    places, asked = [], []
    for payload in payloads:
        counts, own = opened(payload)
        places.append(np.fromiter(map(index.__getitem__, own), np.int64, len(own)))
        asked.append(counts)
    total = np.zeros((len(asked[0]), len(index)), np.int64)
    for counts, at in zip(asked, places, strict=True):
        total[:, at] += counts
    return list(index), total, places


def leftover(once: int, twice: int) -> float:
    """The share that each word leaves to unseen ones, from how many words came once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def mixed_online(tokens, first, sizes, chances, plain, by_token=()):
    """Natural log probability of each token.

    chances: one array of log probabilities of the distinct words per expert;
    by_token: of the tokens, per further expert; plain: of the distinct words,
    what the expert of the text's own words rests on.
    """
    import numpy as np

    n, text = len(tokens), np.repeat(np.arange(len(first)), sizes)
    low = n.bit_length()
    both = np.sort((text * len(plain) + tokens) << low | np.arange(n))  # by text, token and place
    order = both & (1 << low) - 1
    same = np.r_[False, both[1:] >> low == both[:-1] >> low]
    run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    before = np.empty(n, np.int64)
    before[order] = run  # times the token came in its text so far
    at = np.arange(n) - first[text]
    rest = np.exp(plain[tokens])
    cached = np.log(np.where(at > 0, OWN * before / np.maximum(at, 1) + (1 - OWN) * rest, rest) + 1e-300)
    logs = np.stack([c[tokens] for c in chances] + [np.maximum(cached, plain[tokens] + np.log(1 - OWN)), *by_token])
    sums = np.concatenate([np.zeros((len(logs), 1)), np.cumsum(logs, 1)], 1)
    earned = sums[:, :-1] - sums[:, np.maximum(first[text], np.arange(n) - MEMORY)]
    earned -= earned.max(0)
    both = earned + logs
    top = both.max(0)
    return top + np.log(np.exp((both - top).astype(np.float32)).sum(0)) - np.log(np.exp(earned.astype(np.float32)).sum(0))


def mixed_in_slices(tokens, first, sizes, chances, plain, by_token=()):
    """mixed_online of whole texts, about SLICE tokens at a time."""
    import numpy as np

    out, begin = np.empty(len(tokens)), 0
    ends = first + sizes
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(ends, first[begin] + SLICE, "right")))
        a, b = int(first[begin]), int(ends[end - 1])
        out[a:b] = mixed_online(tokens[a:b], first[begin:end] - a, sizes[begin:end], chances, plain, [x[a:b] for x in by_token])
        begin = end
    return out


def frequent(docs: DataFrame, total: int):
    """Hashes of the words that more than about one token in 2,600 is, and of the end of a text.

    They are looked up in about HOT_BYTES of text. They decide which way counts
    take, not what they are.
    """
    import numpy as np
    import xxhash

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total // HOT_BYTES))) == 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = some.select(F.explode(F.split(F.translate("text", upper, upper.lower()), r"[\x20\x09-\x0D]+")).alias("word"))
    often = words.groupBy("word").count().where(F.col("count") > max(8, min(total, HOT_BYTES) // HOT_SHARE)).collect()
    return np.array([xxhash.xxh3_64_intdigest(w) for w in sorted({b""} | {r["word"].encode() for r in often})], np.uint64)


def gathered(table: pa.Table) -> pa.Table:
    """A bucket's share of the totals (part 0) and of the predictors' counts (one part per chunk); buckets of pairs have none."""
    import numpy as np

    if table.column("bucket")[0].as_py() < 0:
        return pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())]).empty_table()
    words, by_language, _ = vocabulary(table.column("payload").to_pylist())
    known = [words[i] for i in np.flatnonzero(by_language.sum(0))]
    size = sum(SLOTS)
    n = np.zeros((size, 2), np.int64)
    for a, b in steps(known, 8 * STEP):  # counting costs a table's size
        parts: list[list] = [[] for _ in SLOTS]
        for c, d in steps(known[a:b]):
            for _, _, bit, slots in bits(known[a + c : a + d]):
                for k, at in enumerate(slots):
                    parts[k].append((at * 2 + bit).astype(np.int32))
        base = 0
        for own, part in zip(SLOTS, parts, strict=True):
            n[base : base + own] += np.bincount(np.concatenate(part) - 2 * base, minlength=2 * own).reshape(own, 2)
            base += own
    n = n.T
    each = np.concatenate([by_language.sum(0)[None], by_language])
    totals = np.stack([each.sum(1), (each > 0).sum(1), (each == 1).sum(1), (each == 2).sum(1)], 1)
    parts = [totals.tobytes()] + [n[:, k : k + CHUNK].tobytes() for k in range(0, size, CHUNK)]
    own = pa.array([table.column("bucket")[0].as_py()] * len(parts), pa.int64())
    return pa.table({"bucket": own, "part": pa.array(range(len(parts)), pa.int64()), "payload": pa.array(parts, pa.binary())})


def summed(table: pa.Table) -> pa.Table:
    """The sum of the payloads of one part of the model, and of one lot of buckets."""
    import numpy as np

    total = 0
    for chunk in table.column("payload").chunks:
        for payload in chunk:
            total = total + np.frombuffer(payload.as_buffer(), np.int64)
    return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int64()), "lot": table.column("lot").slice(0, 1).cast(pa.int64()), "payload": pa.array([total.tobytes()], pa.binary())})


def model_of(table: pa.Table):
    """totals (of all and of each language), counts, and the mean weights and refining table, from a bucket's model rows."""
    import numpy as np

    rows = dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True))
    chunks = [np.frombuffer(rows[k], np.int64).reshape(2, -1) for k in sorted(k for k in rows if k > 0)]
    counts = np.concatenate(chunks, 1).astype(np.float64)
    fitted = np.frombuffer(rows[-1], np.float64) if -1 in rows else None
    return np.frombuffer(rows[0], np.int64).reshape(-1, 4), counts, fitted


def packed(fitted):
    """Weights and refining table from the mean over buckets of what train() gave."""
    n = GATES * INPUTS
    ones, zeros = fitted[n : n + GATES * BINS], fitted[n + GATES * BINS :]
    table = start_table()
    bold = stretch(zeros, ones).reshape(GATES, BINS)
    sure = ((ones + zeros) / (ones + zeros + 30.0)).reshape(GATES, BINS)
    return fitted[:n].reshape(GATES, INPUTS), table * (1 - sure) + bold * sure


def score(docs: DataFrame, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET, running: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte; one row per row of docs.

    Tokens are the words of the text with A-Z lower-cased, then one end.
    Texts learned from: those whose crc32(doc_id) is no multiple of FOLDS. A
    null text is empty and has its end alone; a null doc_id is learned from.
    Each language of the table has an expert. running: the expert for the order
    of words codes running text bit by bit (bit_mixer), in place of the share of
    each pair; the query does. Blocks are cut from rows in the order they are read: with
    running, scores depend on them a little. Texts are read in whole: a block
    of about BLOCK bytes, or one longer text, and about fifty times its size
    fit a task's memory.
    Repeated rows count each. Other columns are ignored; an empty table gives
    no rows. Without training tokens every known count is 0 and the spelling
    model has no counts.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = []
    if "lang" in docs.columns:
        names = sorted(r["lang"] for r in docs.where(F.col("lang").isNotNull()).select("lang").distinct().collect())
    languages = len(names) + 1  # the last one: texts without a language
    language = F.lit(len(names))
    for k, name in enumerate(names):
        language = F.when(F.col("lang") == name, k).otherwise(language)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), FOLDS).alias("held"), language.cast("int").alias("language"))
    total = text_bytes(docs)
    n_buckets = max(8, math.ceil(total / bucket_bytes))
    n_pairs = max(8, math.ceil(total / PAIR_BUCKET))
    hot = frequent(docs, total) if running else None

    def pack(batches):
        task = TaskContext.get().partitionId()
        for k, block in enumerate(cut_into_blocks(batches, block_bytes)):
            block = block.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # weights are updated from text to text
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([packed_texts(block)], pa.binary())], names=["block", "payload"])

    by_block = docs.mapInArrow(pack, "block long, payload binary").groupBy("block")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        t = Texts(table.column("payload")[0].as_py(), n_buckets, running)
        number, cuts = t.cuts()
        counts = t.counts(languages)
        squeeze = zstandard.ZstdCompressor(level=1)
        payloads = [squeeze.compress(np.array([languages, b - a]).tobytes() + counts[:, a:b].astype(np.uint32).tobytes() + b"\n".join(t.words[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        number = number.tolist()
        for bucket, payload in bit_mixer.requests(t.nodes(hot, n_pairs), squeezed) if running else pair_requests(t, n_pairs):  # their buckets are counted down from -2
            number.append(-2 - bucket)
            payloads.append(payload)
        block = pa.array([key[0].as_py()] * len(number), pa.int64())
        return pa.table({"block": block, "bucket": pa.array(number, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    def learn(requests: pa.Table, model: pa.Table) -> pa.Table:
        import numpy as np

        schema = pa.schema([("n", pa.float64()), ("fitted", pa.list_(pa.float64()))])
        if not requests.num_rows or requests.column("bucket")[0].as_py() < 0:
            return schema.empty_table()
        words, counts, _ = vocabulary(requests.column("payload").to_pylist())
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # so that the order of blocks counts for nothing
        known = np.flatnonzero(counts.sum(0)[order])
        pick = order[known[np.argsort(mix(known.astype(np.uint64) + np.uint64(1)))]]  # in no order of spelling
        weights, ones, zeros = train([words[i] for i in pick], model_of(model)[1])
        fitted = np.concatenate([weights.ravel(), ones.ravel(), zeros.ravel()])
        return pa.table({"n": [float(len(pick))], "fitted": [fitted.tolist()]}, schema=schema)

    def answer(requests: pa.Table, model: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        if not requests.num_rows:
            return pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())]).empty_table()
        if requests.column("bucket")[0].as_py() < 0:
            return bit_mixer.bucket_answers(requests, unsqueezed) if running else pair_answers(requests)
        words, counts, places = vocabulary(requests.column("payload").to_pylist())
        totals, table, fitted = model_of(model)
        new = np.flatnonzero(counts.sum(0) == 0) if running else np.arange(len(words))
        natural = np.zeros(len(words), np.float32)
        natural[new] = spelled([words[i] for i in new], table, *packed(fitted))
        # a word's part of the training tokens that share its path
        part = (bit_mixer.shares(words, counts.sum(0)) if running else np.ones(len(words))).astype(np.float32)
        squeeze = zstandard.ZstdCompressor(level=1)
        # byte by byte of their places, so that high bytes, mostly alike, take no room
        payloads = [squeeze.compress(b"".join([np.ascontiguousarray(x.view(np.uint8).reshape(x.size, -1).T).tobytes() for x in (counts[:, at].ravel(), natural[at], part[at])])) for at in places]
        out = pa.table({"block": requests.column("block").cast(pa.int64()), "bucket": requests.column("bucket").cast(pa.int64()), "payload": pa.array(payloads, pa.binary())})
        if b"" in words:  # every block asks for the end of a text, and so is told the totals once
            own = [totals.tobytes()] * out.num_rows
            out = pa.concat_tables([out, pa.table({"block": out.column("block"), "bucket": pa.array([-1] * len(own), pa.int64()), "payload": pa.array(own, pa.binary())})])
        return out

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        t = Texts(table.column("payload")[0].as_py(), n_buckets, running)
        rows = dict(zip(said.column("bucket").to_pylist(), said.column("payload").to_pylist(), strict=True))
        totals = np.frombuffer(rows[-1], np.int64).reshape(-1, 4).tolist()
        number, cuts = t.cuts()
        open_ = zstandard.ZstdDecompressor()
        own = [(np.frombuffer(open_.decompress(rows[k]), np.uint8), m) for k, m in zip(number.tolist(), np.diff(cuts).tolist(), strict=True)]
        whole = lambda x, size, kind: np.ascontiguousarray(x.reshape(size, -1).T).view(kind).ravel()
        by_language = np.concatenate([whole(x[: 8 * languages * m], 8, np.int64).reshape(languages, m) for x, m in own], 1)
        natural = np.concatenate([whole(x[-8 * m : -4 * m], 4, np.float32) for x, m in own]).astype(np.float64)
        part = np.concatenate([whole(x[-4 * m :], 4, np.float32) for x, m in own]).astype(np.float64)
        counts = by_language.sum(0)
        (n, v, once, _), chances, every = totals[0], [], [counts, *by_language]
        if running:  # words that training has not seen share the chance of those that it has seen once
            unseen = (once + 1) / (n + 2)
            chances = [np.where(counts > 0, math.log1p(-unseen) + np.log(np.maximum(counts, 1) / max(n, 1)), math.log(unseen) + natural)]
        for (all_, known, once, twice), c in zip(totals[len(chances) :], every[len(chances) :], strict=True):
            under = chances[0] if chances else natural
            if all_:
                share = leftover(once, twice)
                rest = math.log(share * known / all_) + under
                chances.append(np.logaddexp(rest, np.log(np.maximum(c - share, 1e-300) / all_)))
            elif not chances:
                chances.append(natural)
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        per_text = lambda x: np.add.reduceat(x, t.first)
        if running:
            nodes = t.nodes(hot, n_pairs)
            cells = nodes.cells(bit_mixer.opened(nodes, lambda b: rows[-2 - b]))
            # a word that came once has no counts but its own
            learned = np.repeat(~t.held, t.sizes) & (counts[t.tokens] > 1)
            path = bit_mixer.scored(cells, nodes.pair, t.first, t.sizes, learned)
            known = np.log(np.maximum(part, 1e-300)) + math.log1p(-unseen)
            after = np.where(counts[t.tokens] > 0, path + known[t.tokens], chances[0][t.tokens])
        else:
            hashes, _, pair, before = t.pairs()
            bucket, _ = pair_places(hashes, n_pairs)
            pair_counts = np.concatenate([unsqueezed(rows[-2 - b]) for b in np.unique(bucket).tolist()])
            after = follows(counts, before, pair_counts[pair], np.exp(chances[0][t.tokens]))
        logs = per_text(mixed_in_slices(t.tokens, t.first, t.sizes, chances, chances[0], [after])) / math.log(10)
        size = t.rows.column("n_bytes").to_numpy()
        return pa.table(
            {
                "doc_id": t.rows.column("doc_id"), "held_out": t.rows.column("held"), "n_tokens": pa.array(t.sizes, pa.int64()), "n_known": pa.array(per_text((counts > 0).astype(np.int64)[t.tokens]), pa.int64()),
                "train_tokens": pa.array([n] * len(size), pa.int64()), "base_score": pa.array(per_text(base[t.tokens])), "score": pa.array(logs),
                "n_bytes": pa.array(size, pa.int64()), "bits_per_byte": pa.array(-logs / math.log10(2) / np.maximum(size, 1)),
            }
        )

    requests = by_block.applyInArrow(ask, REQUEST)
    by_bucket = requests.groupBy("bucket")
    # in two levels, each over the square root of the buckets: a task holds one sum and reads payloads one by one
    kind_of = "part long, lot long, payload binary"
    lots = F.pmod(F.xxhash64("bucket"), F.lit(math.ceil(math.sqrt(n_buckets))))
    each = by_bucket.applyInArrow(gathered, "bucket long, part long, payload binary").select("part", lots.alias("lot"), "payload")
    halfway = each.groupBy("part", "lot").applyInArrow(summed, kind_of).withColumn("lot", F.lit(0).cast("long"))
    counted = halfway.groupBy("part", "lot").applyInArrow(summed, kind_of).drop("lot")
    each_bucket = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_buckets - 1).cast("long"))).alias("bucket")
    model = counted.select(each_bucket, "part", "payload")
    learned = by_bucket.cogroup(model.groupBy("bucket")).applyInArrow(learn, "n double, fitted array<double>")
    one = learned.select("n", F.posexplode("fitted").alias("k", "x"))
    is_weight = F.col("k") < GATES * INPUTS
    mean = one.groupBy("k").agg(F.when(F.first(is_weight), F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("x")), F.sum("n")), F.avg("x"))).otherwise(F.sum("x")).alias("x"))
    fitted = mean.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("all")).where(F.size("all") > 0)
    as_bytes = fitted.select(F.transform("all", lambda s: s["x"]).alias("fitted")).mapInArrow(_double_bytes, "part long, payload binary")
    full = model.unionByName(as_bytes.select(each_bucket, "part", "payload"))
    answers = by_bucket.cogroup(full.groupBy("bucket")).applyInArrow(answer, REQUEST)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def _double_bytes(batches):
    import numpy as np

    for batch in batches:
        payload = [np.array(x, np.float64).tobytes() for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(payload), pa.int64()), pa.array(payload, pa.binary())], names=["part", "payload"])
