"""Dates, weekdays, times and numbers of a time card, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batida.functions.text import literal
from batida.model import DATE, DELIMITERS_A, DOTTED, MISSING, PREFIX, SATURDAYS, SPECIAL_A, TIME, WEEKDAYS, WEEKDAYS_FROM_SUNDAY


def _list(values) -> Column:
    return F.array(*map(F.lit, values))


def _once(value: Column, make) -> Column:
    """make(value), with value worked out once however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def date_text(line: Column) -> Column:
    """The first d/m/y as written, or ''; neither bounded nor checked."""
    return F.regexp_extract(line, f"({DATE})", 1)


def weekday_tag(line: Column) -> Column:
    """The first of the list that the line contains, in the list's order; a spelling of Saturday gives Sab; else ''."""
    found = F.get(F.filter(_list(WEEKDAYS), lambda w: F.contains(line, w)), F.lit(0))
    return F.coalesce(found, F.when(line.rlike("|".join(SATURDAYS)), "Sab"), F.lit(""))


def after_date(line: Column, date: Column, weekday: Column) -> Column:
    """What follows the date, or the weekday where that comes later."""
    at, day = F.position(date, line), F.position(weekday, line)
    begin = F.when((weekday != "") & (day > at), day + F.length(weekday)).otherwise(at + F.length(date))
    return F.substring(line, begin, F.length(line))


def before_delimiter(tail: Column, tokens=DELIMITERS_A) -> Column:
    """Cut before the first token, in the list's order, that the upper-cased text contains.

    One pass looks at each place for the tokens that begin with its letter,
    in the list's order; the least in that order over all places is the first.
    """
    letters = dict.fromkeys(k[0] for k in tokens)
    branches = [literal(x) + "(?:" + "|".join(literal(k[1:]) for k in tokens if k[0] == x) + ")" for x in letters]
    found = lambda up: F.array_distinct(F.regexp_extract_all(up, F.lit("(?=(" + "|".join(branches) + "))"), F.lit(1)))
    seat = lambda up: F.transform(found(up), lambda k: F.struct(F.array_position(_list(tokens), k).alias("order"), F.position(k, up).alias("at")))
    at = _once(F.upper(tail), lambda up: F.array_min(F.filter(seat(up), lambda s: s["at"] <= F.length(tail)))["at"])
    return F.substring(tail, F.lit(1), F.coalesce(at - 1, F.length(tail)))


def times(text: Column) -> Column:
    """All clock times, in order."""
    return F.regexp_extract_all(text, F.lit("(?U)" + TIME), F.lit(1))


def hour(time: Column) -> Column:
    return F.split_part(time, F.lit(":"), F.lit(1)).cast("int")


def normal_times(found: Column) -> Column:
    """The first four, then without hours above 23; midnight as 24:00; two digits an hour."""
    usable = F.filter(F.slice(found, 1, 4), lambda t: hour(t) <= 23)
    return F.transform(usable, lambda t: F.when(F.lpad(t, 5, "0") == "00:00", "24:00").otherwise(F.lpad(t, 5, "0")))


def is_special(line: Column, words=SPECIAL_A) -> Column:
    return F.upper(line).rlike("|".join(map(literal, words)))


def slots(found: Column) -> list[Column]:
    """Four slots, the missing ones '0'."""
    return [F.coalesce(F.get(found, F.lit(i)), F.lit(MISSING)) for i in range(4)]


def valid_pairs(four: list[Column]) -> list[Column]:
    """A pair of entry and exit stays if both are there; else both are '0'."""
    out = []
    for a, b in (four[:2], four[2:]):
        both = (a != MISSING) & (b != MISSING)
        out += [F.when(both, a).otherwise(MISSING), F.when(both, b).otherwise(MISSING)]
    return out


def period(text: Column) -> tuple[Column, Column]:
    """First and last day of the declared period; nulls without one or where a day doesn't exist."""
    named, plain = f"(?U)Período:\\s*({DOTTED})\\s*a\\s*({DOTTED})", f"(?U)({DOTTED})\\s*-\\s*({DOTTED})"

    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    written = F.regexp_extract_all(F.coalesce(found(named), found(plain)), F.lit(f"({DOTTED})"), F.lit(1))
    return tuple(F.try_to_date(F.get(written, F.lit(i)), "d.M.yyyy") for i in (0, 1))


def weekday_name(date: Column) -> Column:
    return F.get(_list(WEEKDAYS_FROM_SUNDAY), F.dayofweek(date) - 1)


def page_bounds(pages: Column) -> tuple[Column, Column]:
    """First and last page of 'a-b' or 'n'; nulls for all pages and for text that is no range, numbers too large for a page included."""
    range_ = r"^\s*[0-9]+\s*-\s*[0-9]+\s*$"
    part = lambda k: F.when(pages.rlike(range_), F.trim(F.split_part(pages, F.lit("-"), F.lit(k)))).when(pages.rlike(r"^\s*[0-9]+\s*$"), F.trim(pages)).try_cast("int")
    return part(1), part(2)


def page_number(pages: Column, i: Column) -> Column:
    """The page that the i-th one read (from 1) is: counted from the start of 'a-b', else i."""
    first, _ = page_bounds(pages)
    return F.when(F.contains(pages, F.lit("-")) & first.isNotNull(), first + i - 1).otherwise(i)


def progress_step(i: Column, total: Column) -> Column:
    return (3 + F.floor(i / total * 5)).cast("int")


def progress_percent(step: Column, steps: Column) -> Column:
    return F.floor(step / steps * 100).cast("int")


def display_name(time: Column, prefix: str = PREFIX) -> Column:
    """The name a result file is offered under."""
    return F.concat(F.lit(f"{prefix}_ponto_extraido_"), F.date_format(time, "yyyyMMdd_HHmmss"), F.lit(".csv"))


def page_count(pages: Column, most: int) -> Column:
    """How many pages are made for a range, up to `most`; one without a range."""
    first, last = page_bounds(pages)
    return F.when(F.contains(pages, F.lit("-")) & first.isNotNull(), F.least(last - first + 1, F.lit(most))).otherwise(1)
