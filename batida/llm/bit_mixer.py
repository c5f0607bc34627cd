"""Bits of running text, predicted under contexts of counts and mixed online.

A word is a path of DEPTH bits, the top bits of its hash, through a binary
tree; at each node the next bit is predicted. Two contexts count how often
training texts took either branch: none (all tokens) and the word before. The
two predictions are stretched, weighted by a weight set that a gate picks (how
much either context has seen there, whether it has seen one branch only, and
how many of the text's last WINDOW words training texts had after the word
before them), summed and squashed; an adaptive table then refines the result. Words that
share a whole path are told apart by their counts. A branch without a known
word has no chance, so the chances of all known words add up to 1.

Counts of all nodes follow from how often words come after each other: sorted
by context and path, the words below a node lie side by side. A block of texts
sends each distinct pair of context and path once, with its count, to the
bucket of the context, and is sent back one number a node that stands for both
counts. Contexts are hashed to CONTEXT bits beside the bucket's, so tables
grow with the texts. The context of a frequent word, and that of none, is dealt
by the first HEAD bits of the path; pairs of it and HEAD bits go to a bucket of
their own.

Weights are updated as texts are scored, first after FIRST tokens, then after
twice as many each time, up to BATCH, from the tokens of training texts, each predicted without its own counts. Which nodes
look alike to the mixer is one of CODES * CODES cells a state, so a batch is summed up
by cells and then mixed cell by cell.
"""

from __future__ import annotations

import pyarrow as pa

from batida.llm.repeats import mix

DEPTH, HEAD, CONTEXT = 24, 8, 22
FIRST, BATCH = 1 << 11, 1 << 16  # tokens between two updates, in the beginning and later on
WINDOW = 16  # words that the state of a text is judged by
STATES = (4, 8, 12, 15)  # least number of these that were known pairs, of each state but the first
FEW = 7  # counts up to it are told apart
LEVELS = (8, 16, 64, 1024)  # least counts of the coarser levels
STRETCHES = 15  # steps of 1/2 on either side of 0; beside them: all, and none
AGAIN = 255  # in an answer: the number that follows most often, Codes.then
TRUST = 30.0  # how often a cell must come until the table counts as much as the mixer
RIDGE = 20.0  # and how firm the starting weights are
_SPAN = 2 * STRETCHES + 3
_EXACT = 1 + sum(n + 1 for n in range(1, FEW + 1))
CODES = _EXACT + len(LEVELS) * _SPAN
_TABLE = 64  # counts below it are looked up
PIECE = 1 << 13  # tokens worked on at a time, so that arrays stay in the processor's cache


def coded(taken, n):
    """The number that stands for a node: taken of its n tokens went the way that is asked for."""
    import numpy as np

    few = 1 + (n - 1) * (n + 2) // 2 + taken
    level = np.searchsorted(np.array(LEVELS[1:]), n, "right")
    step = np.clip(np.round(2 * np.log((taken + 0.4) / (n - taken + 0.4))), -STRETCHES, STRETCHES) + STRETCHES
    step = np.where(taken == n, _SPAN - 2, np.where(taken == 0, _SPAN - 1, step))
    return np.where(n == 0, 0, np.where(n <= FEW, few, _EXACT + level * _SPAN + step)).astype(np.uint8)


class Numbers:
    """coded() by a table, for the small counts that most nodes have."""

    def __init__(self):
        import numpy as np

        n, taken = np.divmod(np.arange(_TABLE * _TABLE), _TABLE)
        self.table = coded(np.minimum(taken, n), n)

    def __call__(self, taken, n):
        import numpy as np

        out = self.table.take(np.minimum(n, _TABLE - 1) * _TABLE + np.minimum(taken, _TABLE - 1))
        large = np.flatnonzero(n >= _TABLE)
        out[large] = coded(taken[large], n[large])
        return out


class Codes:
    """What the numbers mean, by number: stretched prediction, gate, all or some went this way, one branch only, the other way, without one token, next node if it has one branch."""

    def __init__(self):
        import numpy as np

        self.stretch, self.seen = np.zeros(CODES), np.zeros(CODES, np.int64)
        self.all, self.some, self.one = np.zeros(CODES, bool), np.zeros(CODES, bool), np.zeros(CODES, bool)
        self.other, self.without, self.then = np.zeros(CODES, np.int64), np.arange(CODES), np.zeros(CODES, np.uint8)
        for n in range(1, FEW + 1):
            for k in range(n + 1):
                c = 1 + (n - 1) * (n + 2) // 2 + k
                self.stretch[c], self.seen[c] = np.log((k + 0.4) / (n - k + 0.4)), min(n, 3)
                self.all[c], self.some[c], self.one[c] = k == n, k > 0, k in (0, n)
                self.other[c] = c + n - 2 * k
                if k:
                    self.then[c] = 1 + (k - 1) * (k + 2) // 2 + k
                    self.without[c] = 1 + (n - 2) * (n + 1) // 2 + k - 1 if n > 1 else 0
        for level, least in enumerate(LEVELS):
            base = _EXACT + level * _SPAN
            sure = np.log(least * 1.4 + 0.4) - np.log(0.4)
            self.stretch[base : base + _SPAN] = [*((np.arange(_SPAN - 2) - STRETCHES) / 2), sure, -sure]
            self.seen[base : base + _SPAN] = 4 + level
            self.then[base : base + _SPAN - 1] = base + _SPAN - 2
            self.all[base + _SPAN - 2] = True
            self.some[base : base + _SPAN - 1] = True
            self.one[base + _SPAN - 2 : base + _SPAN] = True
            self.other[base : base + _SPAN] = [*(base + np.arange(_SPAN - 2)[::-1]), base + _SPAN - 1, base + _SPAN - 2]


class Mixer:
    """Weights and refining table over cells (number of no context * CODES + number of the word before) of each state."""

    def __init__(self):
        import numpy as np

        c = Codes()
        a, b = np.divmod(np.arange(CODES * CODES), CODES)
        self.x = np.stack([c.stretch[a], c.stretch[b]], 1)
        self.gate = (np.minimum(c.seen[a], 4) * 8 + c.seen[b]) * 2 + c.one[b]
        self.sure = c.all[a]  # no known word on the other branch: nothing to code
        self.other = c.other[a] * CODES + c.other[b]
        self.without = (c.without[a] * CODES + c.without[b]).astype(np.uint16)
        gates, states = 5 * 8 * 2, len(STATES) + 1
        self.weights = np.tile([0.7, 0.4], (states, gates, 1))
        self.weights[-1] = [0.3, 1.2]  # a text that goes on as others do
        self.bend = np.tile(np.eye(2) * RIDGE, (states, gates, 1, 1))
        self.came = np.zeros((states, CODES * CODES))

    def mixed(self, state: int):
        """Chance of the way taken, by cell, before the table."""
        import numpy as np

        w = self.weights[state]
        logit = np.clip(w[:, 0].take(self.gate) * self.x[:, 0] + w[:, 1].take(self.gate) * self.x[:, 1], -20, 20)
        return 1 / (1 + np.exp(-logit))

    def chances(self, state: int):
        """Natural log of the chance of the way taken, by cell."""
        import numpy as np

        came = self.came[state]
        p = (came + TRUST * self.mixed(state)) / (came + came[self.other] + TRUST)
        return np.where(self.sure, 0.0, np.log(p)).astype(np.float32)

    def learn(self, state: int, came):
        """One online step; came: how often each cell came."""
        import numpy as np

        came = np.where(self.sure, 0, came)
        p, gates, bend = self.mixed(state), self.weights.shape[1], self.bend[state]
        at = np.flatnonzero(came)
        gate, x, n, p = self.gate[at], self.x[at], came[at], p[at]
        slope = np.stack([np.bincount(gate, n * (1 - p) * x[:, k], gates) for k in range(2)], 1)
        for i in range(2):
            for j in range(2):
                bend[:, i, j] += np.bincount(gate, n * p * (1 - p) * x[:, i] * x[:, j], gates)
        self.weights[state] += np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        self.came[state] += came


def states(known, first, sizes):
    """The state of the text before each token; known: tokens whose pair training texts have. Words before the text's beginning count half."""
    import numpy as np

    n, begin = len(known), np.repeat(first, sizes)
    sums = np.r_[0, np.cumsum(known)]
    since = np.maximum(begin, np.arange(n) - WINDOW)
    return np.searchsorted(np.array(STATES), sums[:-1] - sums[since] + (WINDOW - np.arange(n) + since) / 2, "right").astype(np.int8)


def scored(cells, pair, first, sizes, learned):
    """Natural log of the chance of each token's path.

    cells: a row per distinct pair; pair: of each token; first,
    sizes: of the texts; learned: tokens that the mixer learns from.
    """
    import numpy as np

    c, last = Codes(), cells[:, -1] % CODES
    now = states(c.some[last].take(pair), first, sizes)
    alone = states(c.some[c.without[last]].take(pair), first, sizes)
    out, mixer, begin, size = np.empty(len(pair)), Mixer(), 0, FIRST
    while begin < len(pair):
        own = slice(begin, begin + size)
        begin, size = begin + size, min(2 * size, BATCH)
        counted = []
        for state in range(len(STATES) + 1):
            at = own.start + np.flatnonzero(now[own] == state)
            chances = mixer.chances(state)
            for piece in np.split(at, range(PIECE, len(at), PIECE)):
                out[piece] = chances.take(cells.take(pair[piece], 0)).sum(1)
            mine, came = pair[own][(alone[own] == state) & learned[own]], np.zeros(CODES * CODES, np.int64)
            for piece in np.split(mine, range(PIECE, len(mine), PIECE)):
                came += np.bincount(mixer.without.take(cells.take(piece, 0)).ravel(), minlength=CODES * CODES)
            counted.append(came)
        for state, came in enumerate(counted):
            mixer.learn(state, came)
    return out


def paths(names):
    """The path of each word, from its hash."""
    import numpy as np

    return (names >> np.uint64(64 - DEPTH)).astype(np.int64)


def shares(words: list[bytes], counts):
    """Each word's part of the training tokens that share its path; a path's words must all be there."""
    import numpy as np
    import xxhash

    _, place = np.unique(paths(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)), return_inverse=True)
    return counts / np.maximum(np.bincount(place, counts)[place], 1)


def entries(before, path, hot, buckets: int):
    """(bucket, context, path) as one number each; before: hash of the context's word; hot: dealt by the head of the path."""
    import numpy as np

    head = np.where(hot, (path >> (DEPTH - HEAD)) + 1, 0).astype(np.uint64)
    h = mix(before * np.uint64(0xA24BAED4963EE407) + head * np.uint64(0x9E3779B97F4A7C15))
    bucket = (h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    context = h >> np.uint64(8) & np.uint64((1 << CONTEXT) - 1)
    return (bucket << np.uint64(CONTEXT) | context) << np.uint64(DEPTH) | path.astype(np.uint64)


def distinct(values):
    """np.unique with the inverse. Values are sorted with their place in the low bits, then, if these took the room of some of theirs, once more, which is quick by then."""
    import numpy as np

    n, values = len(values), values.astype(np.uint64)
    low = max(1, n.bit_length())
    over = np.uint64(max(0, int(values.max()).bit_length() + low - 64) if n else 0)
    order = (np.sort(values >> over << np.uint64(low) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << low) - 1)).astype(np.int64)
    if over:
        order = order[np.argsort(values[order], kind="stable")]
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][:n]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


class Nodes:
    """The distinct entries of a block: of its words, of its pairs, and of the heads of hot contexts."""

    NONE = 0x5851F42D4C957F2D  # in place of a word's hash: the context of no word

    def __init__(self, names, tokens, before, learned, hot, buckets: int):
        """names, hot: of the distinct words; tokens, before: words of the tokens and of those before them; learned: tokens of training texts."""
        import numpy as np

        path = paths(names)
        heads = path >> (DEPTH - HEAD) << (DEPTH - HEAD)
        none = np.full(len(names), self.NONE, np.uint64)
        # distinct pairs of words first, as all else follows from them
        both, self.pair = distinct(before * len(names) + tokens)
        first, then = np.divmod(both.astype(np.int64), len(names))
        count = np.bincount(self.pair[learned], minlength=len(both))
        of_word = np.bincount(tokens[learned], minlength=len(names))
        warm = hot[first]
        keys = np.concatenate(
            [
                entries(names[first], path[then], warm, buckets),
                entries(names[first[warm]], heads[then[warm]], np.zeros(int(warm.sum()), bool), buckets),
                entries(none, path, np.ones(len(names), bool), buckets),
                entries(none, heads, np.zeros(len(names), bool), buckets),
            ]
        )
        self.keys, place = distinct(keys)
        self.counts = np.bincount(place, np.concatenate([count, count[warm], of_word, of_word]), len(self.keys)).astype(np.int64)
        n, m = len(both), int(warm.sum())
        self.tail, self.head = place[:n], place[:n].copy()
        self.head[warm] = place[n : n + m]
        self.word_tail, self.word_head, self.then = place[n + m : n + m + len(names)], place[n + m + len(names) :], then

    def cells(self, codes):
        """The mixer's cell at each bit of each distinct pair; codes: DEPTH rows, a column per entry."""
        import numpy as np

        rows = np.empty((len(self.keys), DEPTH), np.uint8)  # a row per entry: what a pair needs lies together
        for begin in range(0, len(rows), PIECE):
            rows[begin : begin + PIECE] = codes[:, begin : begin + PIECE].T
        none = rows.take(self.word_tail, 0).astype(np.uint16)
        none[:, :HEAD] = rows.take(self.word_head, 0)[:, :HEAD]
        none *= np.uint16(CODES)
        out = np.empty((len(self.then), DEPTH), np.uint16)
        for begin in range(0, len(out), PIECE):
            piece = slice(begin, begin + PIECE)
            head, tail = self.head[piece], self.tail[piece]
            after, warm = rows.take(tail, 0), np.flatnonzero(head != tail)
            after[warm, :HEAD] = rows.take(head[warm], 0)[:, :HEAD]
            np.add(none.take(self.then[piece], 0), after, out=out[piece])
        return out


def answers(keys, counts):
    """The numbers of the entries, DEPTH rows; keys: distinct entries in order; counts: how often training texts have them."""
    import numpy as np

    out, then, number_of = np.full((DEPTH, len(keys)), AGAIN, np.uint8), Codes().then, Numbers()
    active, n = np.arange(len(keys)), counts  # entries whose path is shared below the node, and the node's count
    context, guess = keys >> np.uint64(DEPTH), np.full(len(keys), AGAIN, np.uint8)
    run = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(keys)])
    n = np.repeat(np.add.reduceat(counts, run), np.diff(np.r_[run, len(keys)])) if len(keys) else counts
    for d in range(DEPTH):
        node = keys[active] >> np.uint64(DEPTH - d - 1)
        run = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
        if not len(run):
            break
        size = np.diff(np.r_[run, len(node)])
        first = active[run]
        taken = np.add.reduceat(counts[active], run)
        number = number_of(taken, n[first])
        out[d, active] = np.repeat(np.where(number == guess[first], AGAIN, number), size)
        n[active], guess[active] = np.repeat(taken, size), np.repeat(then[number], size)
        # an entry by itself goes on with one branch, of which one more number may be needed
        alone = np.repeat(size == 1, size)
        if d + 1 < DEPTH:
            own = active[alone]
            number = number_of(n[own], n[own])
            out[d + 1, own] = np.where(number == guess[own], AGAIN, number)
        active = active[~alone]
    return out


def shared(keys):
    """How many bits of the path each entry has in common with the one before it; -1 in another context."""
    import numpy as np

    differ = keys[1:] ^ keys[:-1]
    length = np.frexp((differ & np.uint64((1 << DEPTH) - 1)).astype(np.float64))[1]
    return np.r_[-1, np.where(differ >> np.uint64(DEPTH) > 0, -1, DEPTH - length)][: len(keys)].astype(np.int8)


def packed(codes, keys) -> bytes:
    """The numbers of one request's entries, bit by bit, but for those that the entry before tells: of shared nodes, and of the node where two part."""
    import numpy as np
    import zstandard

    common = shared(keys)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([row[common < d].tobytes() for d, row in enumerate(codes)]))


def unpacked(payloads: list[bytes], first, keys):
    """All numbers of a block's entries, DEPTH rows; first: where each payload's entries begin."""
    import numpy as np
    import zstandard

    c, common, n, open_ = Codes(), shared(keys), len(keys), zstandard.ZstdDecompressor()
    then, other = c.then, c.other.astype(np.uint8)
    data = [np.frombuffer(open_.decompress(p), np.uint8) for p in payloads]
    at = np.cumsum([0] + [len(x) for x in data[:-1]])  # what of each payload comes next
    data = np.concatenate(data)
    out = np.empty((DEPTH, n), np.uint8)
    for d in range(DEPTH):
        mine = common < d
        told, size = np.flatnonzero(mine), np.add.reduceat(mine, first, dtype=np.int64)
        number = data.take(np.arange(len(told)) + np.repeat(at - np.cumsum(size) + size, size))
        at = at + size
        if d:
            number = np.where(number == AGAIN, then.take(out[d - 1].take(told)), number)
        row = out[d] = np.repeat(number, np.diff(np.r_[told, n]))
        ways = np.flatnonzero(common <= d)
        turned = np.flatnonzero(np.repeat(common.take(ways) == d, np.diff(np.r_[ways, n])))
        out[d, turned] = other.take(row.take(turned))
    return out


def requests(nodes: Nodes, squeezed) -> list[tuple[int, bytes]]:
    """(bucket, payload) of a block: entries in order, by their differences, and training counts."""
    import numpy as np

    shift = np.uint64(CONTEXT + DEPTH)
    bucket, key = nodes.keys >> shift, nodes.keys & np.uint64((1 << (CONTEXT + DEPTH)) - 1)
    out = []
    for b, begin, n in zip(*np.unique(bucket, return_index=True, return_counts=True), strict=True):
        step = np.diff(key[begin : begin + n], prepend=np.uint64(0))
        parts = [squeezed(step & np.uint64(0xFFFFFFFF)), squeezed(step >> np.uint64(32)), squeezed(np.minimum(nodes.counts[begin : begin + n], 0xFFFFFFFF))]
        out.append((int(b), np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)))
    return out


def bucket_answers(table: pa.Table, unsqueezed) -> pa.Table:
    """The numbers of each request's entries, after the counts of all requests."""
    import numpy as np

    keys, counts = [], []
    for payload in table.column("payload").to_pylist():
        at = 24 + np.cumsum(np.r_[0, np.frombuffer(payload, np.int64, 3)])
        low, high, count = (unsqueezed(payload[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
        keys.append(np.cumsum(high.astype(np.uint64) << np.uint64(32) | low, dtype=np.uint64))
        counts.append(count.astype(np.int64))
    every = np.sort(np.concatenate(keys))
    every = every[np.r_[True, every[1:] != every[:-1]]]
    places = [np.searchsorted(every, k) for k in keys]
    total = np.zeros(len(every), np.int64)
    for place, count in zip(places, counts, strict=True):
        total[place] += count
    codes = answers(every, total)
    payloads = [packed(codes.take(place, 1), k) for place, k in zip(places, keys, strict=True)]
    return pa.table({"block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64()), "payload": pa.array(payloads, pa.binary())})


def opened(nodes: Nodes, answer):
    """The numbers of a block's entries, DEPTH rows; answer: bucket to payload."""
    import numpy as np

    bucket, first = np.unique(nodes.keys >> np.uint64(CONTEXT + DEPTH), return_index=True)
    out = np.empty((DEPTH, len(nodes.keys)), np.uint8)
    # about 4 * PIECE entries at a time
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(first // (4 * PIECE)) > 0][: len(first)]), len(first)]
    ends = np.r_[first, len(nodes.keys)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = slice(ends[a], ends[b])
        out[:, own] = unpacked([answer(k) for k in bucket[a:b].tolist()], first[a:b] - ends[a], nodes.keys[own])
    return out
