"""Lines of a page, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def lines(text: Column) -> Column:
    """Split on line feeds alone; empty ends are kept."""
    return F.split(text, "\n", -1)


def strip(line: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(line, f"(?U)^{SPACE}+|{SPACE}+$", "")


def first_index(array: Column, test) -> Column:
    """0-based index of the first element for which test(element, index) holds, else null."""
    return F.array_min(F.transform(array, lambda x, i: F.when(test(x, i), i)))


def word(options) -> str:
    """A pattern: one of the options as a whole word, Unicode-aware."""
    return r"\b(" + "|".join(options) + r")\b"


def literal(phrase: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()[]{}^$|-&#~" else c for c in phrase)
