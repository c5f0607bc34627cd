"""Where the table of a page begins and ends, as indices into its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batida.functions.text import first_index, literal, strip, word
from batida.model import END_PHRASES_B, END_WORDS_A, HEADER_A, SPECIAL_B, TIME

DAY = r"^\s*([0-9]{1,2})\s+[A-Z]"


def start_a(ls: Column) -> Column:
    """The first line with a word of both header groups, else 0."""
    day, mark = ("(?U)" + word(g) for g in HEADER_A)
    return F.coalesce(first_index(ls, lambda x, i: x.rlike(day) & x.rlike(mark)), F.lit(0))


def end_a(ls: Column, start: Column) -> Column:
    """From start on, the first line that is blank or has an end word, else the number of lines."""
    ends = "(?iU)" + word(END_WORDS_A)
    return F.coalesce(first_index(ls, lambda x, i: (i >= start) & ((strip(x) == "") | x.rlike(ends))), F.size(ls))


def start_b(ls: Column) -> Column:
    """The first line of a day with a time or a special word, else 0. No header line can match in this layout."""
    special = "(?iU)" + "|".join(map(literal, SPECIAL_B))
    return F.coalesce(first_index(ls, lambda x, i: x.rlike("(?U)" + DAY) & (x.rlike("(?U)" + TIME) | x.rlike(special))), F.lit(0))


def end_b(ls: Column, start: Column) -> Column:
    """From start on, the first line with an end phrase between word boundaries, else the number of lines."""
    ends = "(?iU)" + word(map(literal, END_PHRASES_B))
    return F.coalesce(first_index(ls, lambda x, i: (i >= start) & strip(x).rlike(ends)), F.size(ls))
