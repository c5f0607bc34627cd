"""Secret scans in DataFrame functions alone.

Three patterns give the base spans. The entropy rule adds candidate strings
of one character class whose sliding window has a high Shannon entropy: a
table of counts takes in the character that enters the window and gives up
the one that leaves, and the sum of n * log2(n) follows those two counts.
Allow-listed shapes are suppressed. Positions are code points, ends exclusive.

Work is linear in the length of a text and the number of its matches: what
accumulates over an array does so within groups of GROUP items and then over
the groups, and no character is looked up by counting from the text's start.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in Java's syntax.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # greedy runs: the same matches as AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=.-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
WINDOW = 20
FIELD, PACKED = 5, 12  # bits of a count of a window, which is at most WINDOW; counts in a long
#: (name, the class as a full match, least window entropy in bits); the first class that fits holds.
CLASSES = (("hex", "[0-9a-fA-F]+", 2.9), ("base32", "[A-Z2-7]+=*", 3.3), ("base64", "[A-Za-z0-9+/_=.-]+", 3.7))
# Shapes that are no secrets.
ALLOWED = (
    r"[^0-9]+",  # words and dotted or dashed names without a digit
    r"[0-9._/+=-]+",  # numbers, dates, card and telephone numbers
    r"[A-Za-z]+[._/-]?[0-9]{1,4}",  # a name with a short number
)
# Paths, versions and dashed names have none of these, and a separator.
NO_PATH = r"[A-Za-z0-9]{13}|[._/-]{2}|[+=]|^[._/-]|[._/-]$"
SEPARATOR = "[._/-]"

SPAN = "array<struct<kind:int,start:int,end:int>>"
GROUP = 256  # items that are accumulated one by one
PIECE = 1024  # characters of a piece of text that is cut into


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def before_each(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each item, what merge() makes of 0 and the values of the items before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct(merge(s["at"], value(x)).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int")), lambda k: F.slice(items, k * GROUP + 1, GROUP))
    each = F.transform(groups, lambda group: F.aggregate(group, zero, step))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,out:array<int>>>").alias("out"))
    carried = F.aggregate(
        each, begin, lambda s, x: F.struct(merge(s["at"], x["at"]).cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("base"), x["out"].alias("out")))).alias("out")), lambda s: s["out"]
    )
    return F.flatten(F.transform(carried, lambda g: F.transform(g["out"], lambda v: merge(g["base"], v).cast("int"))))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, match>> of all leftmost non-overlapping matches.

    split and regexp_extract_all find the same matches, so the lengths of
    gaps and matches add up to positions.
    """
    none = F.array().cast("array<struct<start:int,match:string>>")

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), matches.alias("match"))
        return once(parts, lambda ps: once(before_each(ps, lambda x: x["gap"] + F.length(x["match"]), lambda a, b: a + b), lambda at: F.transform(ps, lambda x, i: F.struct((F.get(at, i) + x["gap"]).alias("start"), x["match"].alias("match")))))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def spans_of(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).cast("int").alias("end")),
    )


def hot_windows(token: Column, least: Column) -> Column:
    """struct<first, last>: where the first and last window of at least that entropy begin; nulls without one.

    The state has the counts of the window's characters, the sum of
    n * log2(n) over them, and the two places. A count is at most WINDOW, so
    it takes FIELD bits, and PACKED of them share a long.
    """
    words = len(ALPHABET) // PACKED + 1
    begin = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    term = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 2)]
    added = F.array(*[F.lit(term[n] - term[n - 1] if n else 0.0) for n in range(WINDOW + 2)])  # to the sum, by a count that becomes n
    units = F.array(*[F.lit(1 << FIELD * k).cast("long") for k in range(PACKED)])

    def seat(code: Column) -> Column:
        """Where the count of a character is: which long, the bits below it, and one in its place; null without a character."""
        at = (code % PACKED).cast("int")
        return F.when(code.isNotNull(), F.struct(F.floor(code / PACKED).cast("int").alias("word"), (at * FIELD).alias("bits"), F.get(units, at).alias("unit")))

    def count(counts: Column, seat: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, seat["word"]), seat["bits"]).bitwiseAND(F.lit((1 << FIELD) - 1).cast("long")).cast("int")

    def over(known: Column) -> Column:
        codes, bound = known["codes"], known["least"]

        def move(state: Column, x: Column) -> Column:
            comes, goes, i = x["comes"], x["goes"], x["i"]
            change = lambda n, k: n + F.when(k == comes["word"], comes["unit"]).otherwise(0) - F.when(k == goes["word"], goes["unit"]).otherwise(0)
            counts = F.when(x["same"], state["counts"]).otherwise(F.transform(state["counts"], change))
            gone = F.coalesce(F.get(added, count(state["counts"], goes)), F.lit(0.0))
            total = F.when(x["same"], state["sum"]).otherwise(state["sum"] - gone + F.get(added, count(state["counts"], comes) + 1))
            hot = (i >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW >= bound - 1e-9)
            found = F.when(hot, (i - WINDOW + 1).cast("int"))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.coalesce(state["first"], found).alias("first"), F.coalesce(found, state["last"]).alias("last"))

        # a character that leaves as the same one enters changes nothing
        both = lambda c, i, out: F.struct(seat(c).alias("comes"), seat(out).alias("goes"), F.coalesce(c == out, F.lit(False)).alias("same"), i.alias("i"))
        moves = F.transform(codes, lambda c, i: both(c, i, F.get(codes, i - WINDOW)))
        return F.aggregate(moves, begin, move, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return once(F.struct(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)).alias("codes"), least.alias("least")), over)


def entropy_spans(found: Column) -> Column:
    """Spans of the candidates' hot windows; allow-listed candidates give none."""
    least = lambda token: F.coalesce(*[F.when(token.rlike(f"^(?:{shape})$"), F.lit(bits)) for _, shape, bits in CLASSES])
    allowed = lambda token: token.rlike("^(?:" + "|".join(ALLOWED) + ")$") | (token.rlike(SEPARATOR) & ~token.rlike(NO_PATH))
    usable = F.filter(found, lambda m: ~allowed(m["match"]))

    def span(m: Column) -> Column:
        return once(hot_windows(m["match"], least(m["match"])), lambda hot: F.struct(F.lit(3).alias("kind"), (m["start"] + hot["first"]).alias("start"), (m["start"] + hot["last"] + WINDOW).alias("end")))

    return F.filter(F.transform(usable, span), lambda s: s["start"].isNotNull())


def ordered(spans: Column) -> Column:
    """By start, then kind."""
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))), lambda x: F.struct(x["kind"], x["start"], x["end"])).cast(SPAN)


def outside_base(spans: Column) -> Column:
    """spans, ordered, without the entropy spans that lie within one base span: those that begin no earlier and end no later."""
    reach = before_each(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0), F.greatest)
    return once(reach, lambda ends: F.transform(F.filter(F.transform(spans, lambda s, i: F.struct(s.alias("s"), F.get(ends, i).alias("to"))), lambda x: (x["s"]["kind"] < 3) | (x["to"] < x["s"]["end"])), lambda x: x["s"]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), sorted by start, then kind.

    An entropy span that lies within a base span is left out, as that text is
    found already; one that reaches beyond is kept, as more may be secret
    there. A null text counts as empty. Rows are scanned one by one, repeated
    ones too, and the work grows with the length of a text, however long its
    tokens are or many its matches. Two counts a character of a candidate are
    held at once, some hundreds of bytes: a single token of 4 MB took 38 s in a
    heap of 4 GB. Other columns are ignored; an empty table gives no rows. keep names columns of docs to carry along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", *keep, located(text, ASSIGN).alias("f_assign"), located(text, ACCESS).alias("f_access"), located(text, HEX).alias("f_hex"), located(text, CANDIDATE).alias("f_other"))
    value = lambda m: F.length(F.regexp_extract(m["match"], "^(?:" + ASSIGN + ")$", 2)) >= LEAST_ASSIGNED
    base = F.concat(spans_of(F.filter("f_assign", value), "assign"), spans_of(F.col("f_access"), "access"), spans_of(F.col("f_hex"), "hex"))
    some = found.select("doc_id", *keep, ordered(base).alias("base"), entropy_spans(F.col("f_other")).alias("other"))
    both = once(ordered(F.concat(F.col("base"), F.col("other").cast(SPAN))), outside_base)
    return some.select("doc_id", *keep, "base", F.when(F.size("other") > 0, both).otherwise(F.col("base")).cast(SPAN).alias("spans"))


def spoken(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spoken(F.col("base")).cast("binary"), 256).alias("base_sha256"), spoken(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """The columns of docs, with every span of text replaced by the mark; overlapping spans give one mark.

    A null text stays null; texts without a span, empty ones too, stay as they
    are. Rows that repeat are redacted one by one; an empty table gives no
    rows; columns of any other name are carried along.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def cut(pieces: Column, begin: Column, end: Column) -> Column:
        """The characters from begin to before end, out of the pieces they are in."""
        first = F.floor(begin / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return F.substring(near, begin - first * PIECE + 1, end - begin)

    def clean(pieces: Column) -> Column:
        done = before_each(F.col("spans"), lambda s: s["end"], F.greatest)
        gap = lambda s, at: F.when((at > 0) & (s["start"] < at), "").otherwise(F.concat(cut(pieces, at, s["start"]), F.lit(mark)))
        gaps = once(done, lambda ends: F.transform("spans", lambda s, i: gap(s, F.get(ends, i))))
        rest = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(gaps, ""), cut(pieces, rest, F.length("text")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    new = F.when(F.size("spans") > 0, once(pieces, clean)).otherwise(F.col("text"))
    return scan(packed, ("text", "_row")).select(*[new.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
