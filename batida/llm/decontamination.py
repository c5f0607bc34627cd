"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of canonical
tokens are hash-joined between benchmark items and documents, and items that
such windows can't cover are joined whole. A document leaks an item if an
occurrence in it covers enough of the item's tokens and its placeholders were
filled consistently: one value of the item always became the same value there.
So a question asked with other numbers or names is caught too, also beside
further copies of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.llm.common import materialize
from batida.llm.substring_dedup import prefix_hashes

WINDOW = 6  # canonical tokens
LEAST_LITERALS = 4  # of a window's tokens, that are no placeholders
LEAST_TOKENS = 3  # of an item that is looked for whole
LEAST_COVER = 0.5  # of an item's tokens, by matched windows
LEAST_CONSISTENT = 0.8  # distinct item values over distinct (item value, document value) pairs
SALT = 16  # parts of a hot window or item
MOST_SENT = 1 << 20  # distinct benchmark windows (8 MB) up to which they are sent to the scan of the documents
CACHE = 300_000  # words that a task remembers, of up to LONGEST bytes
LONGEST = 64
SLICE = 1 << 20

# Number words and units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = (
    "% ° $ € £ cm cents day days degrees dollars euros feet foot g gallons gram grams h hour hours inch inches kg kilogram kilograms kilometers km "
    "l lb liter liters litres m meter meters metres mg mile miles min minute minutes ml mm month months mph ounces pound pounds second seconds "
    "ton tons week weeks yard yards year years"
).split()

NUM, UNIT, CAP, STOP, EMPTY = 1, 2, 4, 8, 16


class Canon(dict):
    """Raw token -> (hash, shape bits), remembered per task."""

    def __missing__(self, raw: bytes) -> tuple[int, int]:
        import xxhash

        text = raw.decode("utf-8", "replace")
        core = "".join(c for c in text if c.isalnum() or c in "%°$€£")
        low = core.lower()
        bits = STOP if text[-1:] in (".", "!", "?", ":") else 0
        if not core:
            bits |= EMPTY
        elif any(c.isdigit() for c in core) or low in self.numbers:
            bits |= NUM
        elif low in self.units:
            bits |= UNIT
        elif core[0].isupper() and core[1:] == core[1:].lower():
            bits |= CAP
        out = xxhash.xxh3_64_intdigest(low), bits
        if len(self) > CACHE:
            self.clear()
        if len(raw) <= LONGEST:
            self[raw] = out
        return out

    numbers = frozenset(NUMBERS)
    units = frozenset(UNITS)


def canonical(texts: list[bytes], canon: Canon):
    """hash, shape bits, placeholder mask, places among the raw words, raw words and offsets of the texts' canonical tokens."""
    import numpy as np

    words: list[bytes] = []
    sizes = []
    for text in texts:
        own = text.split()
        words += own
        sizes.append(len(own))
    found = [canon[w] for w in words]
    name = np.array([f[0] for f in found], np.uint64)
    bits = np.array([f[1] for f in found], np.int64)
    off = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    opens = np.r_[True, (bits[:-1] & STOP) > 0][: len(bits)]
    opens[off[:-1][np.diff(off) > 0]] = True
    keep = (bits & EMPTY) == 0
    kept = np.r_[0, np.cumsum(keep)][off]
    at = np.flatnonzero(keep)
    name, bits, opens = name[keep], bits[keep], opens[keep]
    number = (bits & NUM) > 0
    after = np.r_[False, number[:-1]][: len(number)]
    after[kept[:-1][np.diff(kept) > 0]] = False
    unit = ((bits & UNIT) > 0) & after
    person = ((bits & CAP) > 0) & ~opens
    for mask, value in ((number, 1), (unit, 2), (person, 3)):
        name[mask] = value
    return name, bits, number | unit | person, at, words, kept


def windows(texts: list[bytes], canon: Canon, lengths: Iterable[int] | None = None, sent: Sent | None = None):
    """(text, place, whole, hash, slots, sizes) of all windows.

    whole is 0 for windows of WINDOW tokens. lengths are those of items to
    look for whole, and then whole is the length; with None, the texts are
    items, and one whose windows may not cover enough is also a window whole.
    slots[i] gives the raw values of the placeholders of window i, in lower case.
    """
    import numpy as np

    name, bits, held, at, words, off = canonical(texts, canon)
    hashes = prefix_hashes(name)
    sizes = np.diff(off)
    room = np.repeat(off[1:], sizes)
    place = np.arange(len(name))
    literal = np.r_[0, np.cumsum(~held)]
    start = np.flatnonzero(place + WINDOW <= room)
    start = start[literal[start + WINDOW] - literal[start] >= LEAST_LITERALS]
    parts = [(0, start, hashes(start, np.full(len(start), WINDOW)), None)]
    if lengths is None:
        parts += _alone(start, name, bits, off, hashes)
    else:
        for n in lengths:
            start = np.flatnonzero(place + n <= room)
            parts.append((n, start, hashes(start, np.full(len(start), n)), None))
    found = []
    for whole, start, value, first in parts:
        if sent is not None:
            pick = sent.pick(whole, value)
            start, value = start[pick], value[pick]
        span = whole or WINDOW
        raw = lambda i: "".join(c for c in words[at[i]].decode("utf-8", "replace").lower() if c.isalnum())
        slots = [[raw(i) for i in range(k, k + span) if held[i] or (i == k and first)] for k in start.tolist()]
        found.append((start, np.full(len(start), whole, np.int64), value, slots))
    start, whole, value = (np.concatenate([f[i] for f in found]) for i in range(3))
    text = np.searchsorted(off, start, "right") - 1
    return text, start - off[text], whole, value, [x for f in found for x in f[3]], sizes


def _alone(start, name, bits, off, hashes):
    """(length, [start], [hash], first) of items whose windows may not reach LEAST_COVER of their tokens.

    The first token opens its text and counts as literal there. In a document
    it may stand inside a sentence or after a number, as a name or a unit: such
    items get a form for that too (first is True), and their first window is
    not relied on.
    """
    import numpy as np

    filled = off[:-1][np.diff(off) > 0]
    other = filled[(bits[filled] & (CAP | UNIT)) > 0]
    sure = start[~np.isin(start, other)]
    edge = np.zeros(len(name) + 1, np.int64)
    np.add.at(edge, sure, 1)
    np.add.at(edge, sure + WINDOW, -1)
    reached = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= LEAST_TOKENS and reached[b] - reached[a] < LEAST_COVER * (b - a):
            own = hashes(np.array([a]), np.array([b - a]))
            yield b - a, np.array([a]), own, None
            for mask, value in ((UNIT, 2), (CAP, 3)):
                if bits[a] & mask:  # the first token has the factor 1
                    yield b - a, np.array([a]), own - name[a : a + 1] + np.uint64(value), True


class Sent:
    """The benchmark's windows: a small table that most windows of other texts miss."""

    LOW = (1 << 22) - 1

    def __init__(self, names: dict):
        import numpy as np

        self.names = names  # whole -> sorted hashes
        self.seen = np.zeros(self.LOW + 1, bool)
        for of in names.values():
            self.seen[of & np.uint64(self.LOW)] = True

    def pick(self, whole: int, value):
        import numpy as np

        pick = np.flatnonzero(self.seen[value & np.uint64(self.LOW)])
        return pick[np.isin(value[pick], self.names[whole])] if whole in self.names else pick[:0]


def slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE bytes, with the index of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def window_rows(rows: DataFrame, key: str, lengths: list[int] | None = None, names: dict | None = None) -> DataFrame:
    """key, row, place, whole, name, slots, n_tokens per window; row: a hash of the text.

    lengths as in windows(); names: whole -> sorted hashes to keep.
    """
    schema = f"{key} {dict(rows.dtypes)[key]}, row long, place long, whole long, name long, slots array<string>, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        canon = Canon()
        sent = None if names is None else Sent(names)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for begin, part in slices(texts):
                text, place, whole, name, slots, sizes = windows(part, canon, lengths, sent)
                if len(name):
                    row = {k: xxhash.xxh3_64_intdigest(part[k]) for k in set(text.tolist())}
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(text + begin)), pa.array(np.array([row[k] for k in text.tolist()], np.uint64).astype(np.int64)),
                            pa.array(place, pa.int64()), pa.array(whole, pa.int64()), pa.array(name.astype(np.int64)),
                            pa.array(slots, pa.list_(pa.string())), pa.array(sizes[text], pa.int64()),
                        ],
                        names=[key, "row", "place", "whole", "name", "slots", "n_tokens"],
                    )

    return rows.select(key, "text").mapInArrow(run, schema)


def consistent(pairs: set) -> bool:
    return len({a for a, _ in pairs}) >= LEAST_CONSISTENT * len(pairs)


def best_occurrence(matches: list[dict], n_tokens: int) -> tuple[int, float, int, int] | None:
    """n_windows, coverage, n_slots, n_changed of the best occurrence of one item in one document, or None.

    Matches of one text with one distance between their places in document and
    item are a piece of one occurrence. Words put in or left out shift the
    rest, so pieces shifted by less than the item's length are added, the
    nearest first, where values stay consistent. All pieces together, and the
    largest that fit each other, are tried as well: an item may be scattered.
    """
    from bisect import bisect_left, bisect_right

    pieces: dict = {}
    for m in matches:
        offsets, pairs = pieces.setdefault((m["row"], m["place"] - m["offset"]), (set(), set()))
        offsets.add((m["offset"], m["whole"]))
        pairs.update(zip(m["asked"], m["slots"], strict=True))
    keys = sorted(pieces)
    masks, sets, seats = [], [], []
    for key in keys:
        offsets, pairs = pieces[key]
        mask = 0
        for offset, whole in offsets:
            mask |= ((1 << (whole or WINDOW)) - 1) << offset
        masks.append(mask)
        sets.append(pairs)
        seats.append(offsets)
    best = None

    def joined(order) -> None:
        mask, pairs, offsets = 0, set(), set()
        for j in order:
            if not sets[j] <= pairs and not consistent(pairs | sets[j]):
                continue
            mask, pairs, offsets = mask | masks[j], pairs | sets[j], offsets | seats[j]
        rate(mask, pairs, offsets)

    def rate(mask, pairs, offsets) -> None:
        nonlocal best
        coverage = mask.bit_count() / n_tokens
        if coverage >= LEAST_COVER and consistent(pairs):
            changed = sum(a != b for a, b in pairs)
            rank = (coverage, len(offsets), -changed, len({a for a, _ in pairs}))
            if best is None or rank > best:
                best = rank

    every = range(len(keys))
    rate(reduce(or_, masks, 0), set().union(*sets), set().union(*seats))
    if len(keys) > 1:
        joined(sorted(every, key=lambda j: (-masks[j].bit_count(), j)))
        for i in every:
            row, shift = keys[i]
            rate(masks[i], sets[i], seats[i])
            near = range(bisect_right(keys, (row, shift - n_tokens)), bisect_left(keys, (row, shift + n_tokens)))
            if len(near) > 1:
                joined(sorted(near, key=lambda j: (abs(keys[j][1] - shift), j)))
    return None if best is None else (best[1], best[0], best[3], -best[2])


def salted(rows: DataFrame, *by: str) -> DataFrame:
    """rows with a salt, which deals the rows of a hot key into SALT parts."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int"))


def resalted(rows: DataFrame) -> DataFrame:
    """rows once for each salt: for rows of the benchmark alone."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def pair_counts(held: DataFrame, asked: DataFrame) -> DataFrame:
    """whole, name, n_pairs: the pairs of a document and an item that a window of both would give."""
    docs = held.groupBy("whole", "name").agg(F.count("*").alias("n_docs"))
    items = asked.groupBy("whole", "name").agg(F.count("*").alias("n_items"))
    return docs.join(items, ["whole", "name"]).select("whole", "name", (F.col("n_docs") * F.col("n_items")).alias("n_pairs"))


def leads(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, whole, name: windows of which every leaking document has one.

    An occurrence covers LEAST_COVER of an item's tokens. So windows that cover
    less than that together may be left out, those that would give the most
    pairs first: a phrase that many documents and items share gives no pairs
    where the rest of the item has to be there as well.
    """
    group = asked.join(counts, ["whole", "name"], "left").groupBy("item_id", "item_row", "n_tokens")
    own = group.agg(F.collect_set(F.struct(F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "offset", "whole", "name")).alias("own"))
    kind = dict(asked.dtypes)["item_id"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            at, kept = [], []
            for k, (n, windows_) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                covered, total = np.zeros(n, bool), 0
                for w in sorted(windows_.as_py(), key=lambda w: (-w["n_pairs"], w["offset"])):
                    span = covered[w["offset"] : w["offset"] + (w["whole"] or WINDOW)]
                    more = len(span) - int(span.sum())
                    if total + more < LEAST_COVER * n:
                        span[:] = True
                        total += more
                    else:
                        at.append(k)
                        kept.append((w["whole"], w["name"]))
            columns = [pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["item_id", "whole", "name"])

    # a window may stand at several places, or be left out at one of them alone
    return own.select("item_id", "n_tokens", "own").mapInArrow(choose, f"item_id {kind}, whole long, name long").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, n_changed of each document and item it leaks.

    The counts are those of the best occurrence. Items that windows can't
    cover, being short or mostly placeholders, are found where all their tokens
    stand in a row; one without any literal token asks nothing, and is found
    with its own values only. Items of fewer than LEAST_TOKENS tokens can't be
    found. Null texts leak nothing; rows with a null id are left out; rows that repeat an id count as
    one document or item; empty tables give no rows. Ties don't arise: every
    pair that qualifies is returned. A document and an item are paired once they
    share a lead window (see leads), and only then are all windows of both
    compared; a hot window's or item's rows are dealt into SALT parts. Texts
    are read in whole, about SLICE bytes at a time or one longer text. The
    matches of one document and one item meet in one row: a text with 4,000
    copies of an item took 6 s.
    """
    import numpy as np

    items = window_rows(benchmark.where(F.col("item_id").isNotNull()), "item_id")
    few = items.select("whole", "name").distinct().limit(MOST_SENT + 1).collect()
    sent = len(few) <= MOST_SENT
    if sent:
        lengths = sorted({r["whole"] for r in few} - {0})
        names = {n: np.sort(np.array([r["name"] for r in few if r["whole"] == n], np.int64).astype(np.uint64)) for n in (0, *lengths)}
    else:
        lengths, names = sorted(r["whole"] for r in items.where("whole > 0").select("whole").distinct().collect()), None
    found = window_rows(docs.where(F.col("doc_id").isNotNull()), "doc_id", lengths, names).drop("n_tokens")
    asked = items.select("item_id", F.col("row").alias("item_row"), F.col("place").alias("offset"), "whole", "name", F.col("slots").alias("asked"), "n_tokens")
    if not sent:
        found = salted(found, "doc_id", "place").join(resalted(asked.select("whole", "name").distinct()), ["whole", "name", "salt"], "left_semi").drop("salt")
    hits = materialize(found)
    held = hits.select("doc_id", "whole", "name").distinct()
    meets = salted(held, "doc_id").join(resalted(leads(asked, pair_counts(held, asked))), ["whole", "name", "salt"]).select("doc_id", "item_id").distinct()
    wanted = salted(meets, "doc_id").join(resalted(asked), ["item_id", "salt"]).drop("salt")
    says = (F.size("asked") < F.col("whole")) | (F.col("whole") == 0) | (F.col("asked") == F.col("slots"))
    pairs = hits.join(wanted, ["doc_id", "whole", "name"]).where((F.size("slots") == F.size("asked")) & says)
    each = pairs.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("row", "item_row", "place", "offset", "whole", "asked", "slots", "n_tokens")).alias("matches"))
    kinds = dict(each.dtypes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rated = [], []
            for k, matches in enumerate(batch.column(2)):
                own: dict = {}  # rows that repeat an item's id may differ
                for m in matches.as_py():
                    own.setdefault((m["n_tokens"], m["item_row"]), []).append(m)
                best = [x for (n, _), found in own.items() if (x := best_occurrence(found, n))]
                if best:
                    at.append(k)
                    rated.append(max(best, key=lambda x: (x[1], x[0], -x[3], x[2])))
            columns = [pa.array([r[i] for r in rated], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=["doc_id", "item_id", "n_windows", "coverage", "n_slots", "n_changed"])

    return each.mapInArrow(judge, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_windows long, coverage double, n_slots long, n_changed long")
