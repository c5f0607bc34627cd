"""Page text to punch records, for both layouts. One narrow stage: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batida.functions import scalars as S
from batida.functions.text import lines, strip
from batida.model import SLOTS
from batida.operators.bounds import DAY, end_a, end_b, start_a, start_b

MOST_DAYS = 36_600


def layout_a(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no and the six punch columns: one row per line of the table that has a date."""
    split = pages.select("doc_id", "page_no", lines(F.col("text")).alias("ls"))
    begun = split.select("*", start_a(F.col("ls")).alias("begin"))
    ended = begun.select("*", end_a(F.col("ls"), F.col("begin")).alias("end"))
    table = F.slice("ls", F.col("begin") + 1, F.col("end") - F.col("begin"))
    each = ended.select("doc_id", "page_no", "begin", F.posexplode(table).alias("k", "raw"))
    line = each.select("doc_id", "page_no", (F.col("begin") + F.col("k")).alias("line_no"), strip(F.col("raw")).alias("line"))
    dated = line.select("*", S.date_text(F.col("line")).alias("Dia")).where(F.col("Dia") != "")
    tagged = dated.select("*", S.weekday_tag(F.col("line")).alias("Dia_Semana"))
    tail = tagged.select("*", S.after_date(F.col("line"), F.col("Dia"), F.col("Dia_Semana")).alias("tail"))
    found = tail.select("*", S.normal_times(S.times(S.before_delimiter(F.col("tail")))).alias("found"))
    four = [F.when(S.is_special(F.col("line")), "0").otherwise(c) for c in S.valid_pairs(S.slots(F.col("found")))]
    return found.select("doc_id", "page_no", "line_no", "Dia", "Dia_Semana", *[c.alias(n) for c, n in zip(four, SLOTS, strict=True)])


def layout_b(pages: DataFrame, most_days: int = MOST_DAYS) -> DataFrame:
    """doc_id, page_no, cal_date and the six punch columns: one row per day of the declared period.

    A page without a valid period, with a reversed one or without table lines
    gives no rows. A day takes the first line that begins with its number. A
    period of more than most_days days is an error.
    """
    first, last = S.period(F.col("text"))
    known = pages.select("doc_id", "page_no", "text", first.alias("first"), last.alias("last")).where(F.col("first") <= F.col("last"))
    split = known.select("doc_id", "page_no", "first", "last", lines(F.col("text")).alias("ls"))
    begun = split.select("*", start_b(F.col("ls")).alias("begin"))
    ended = begun.select("*", end_b(F.col("ls"), F.col("begin")).alias("end"))
    day = "(?U)" + DAY
    table = F.transform(F.slice("ls", F.col("begin") + 1, F.col("end") - F.col("begin")), lambda x: strip(x))
    dated = F.transform(F.filter(table, lambda x: x.rlike(day)), lambda x: F.named_struct(F.lit("n"), F.regexp_extract(x, day, 1).cast("int"), F.lit("line"), x))
    days = F.when(F.datediff("last", "first") >= most_days, F.raise_error(F.lit(f"a period has more than {most_days} days"))).otherwise(
        F.sequence("first", "last", F.expr("interval 1 day"))
    )
    # an empty table gives no days, so the bounds are worked out once
    each = ended.select("doc_id", "page_no", dated.alias("dated"), F.explode(F.when(F.col("begin") < F.col("end"), days)).alias("cal_date"))
    hit = F.get(F.filter("dated", lambda p: p["n"] == F.day("cal_date")), F.lit(0))["line"]
    found = each.select("doc_id", "page_no", "cal_date", F.coalesce(S.times(F.regexp_replace(hit, day, "")), F.array().cast("array<string>")).alias("found"))
    four = S.valid_pairs(S.slots(F.slice("found", 1, 4)))
    return found.select(
        "doc_id", "page_no", "cal_date", F.date_format("cal_date", "dd/MM/yyyy").alias("Dia"), S.weekday_name(F.col("cal_date")).alias("Dia_Semana"),
        *[c.alias(n) for c, n in zip(four, SLOTS, strict=True)],
    )


def extract(pages: DataFrame, layout: str) -> DataFrame:
    """Punch records of either layout, in output order where written by the sinks."""
    if layout not in ("A", "B"):
        raise ValueError(f"no such layout: {layout}")
    return layout_a(pages) if layout == "A" else layout_b(pages)
