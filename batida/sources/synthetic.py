"""Rows and pages for tests and demonstrations, made in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batida.functions.scalars import page_count, weekday_name
from batida.sources.pages import page_range

MOST_PAGES, DAYS = 5, 5


def synthetic_for(requests: DataFrame, seed: str, pages: str) -> DataFrame:
    """The columns of requests beside synthetic rows: five days a page, for as many pages as the text in `pages` asks, up to five.

    The numbers follow from the value in `seed` by digests, so any engine makes the same ones.
    """
    number = lambda k: F.conv(F.substring(F.md5(F.concat(F.col(seed).cast("string"), F.lit(k), F.col("_id").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    draw = lambda k, low, high: (number(k) % (high - low + 1) + low).cast("string")
    chance = lambda k: number(k) % 1000 / 1000
    last = page_count(F.col(pages), MOST_PAGES) * DAYS - 1
    base = requests.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_id"))
    day = F.lpad((F.col("_id") % DAYS + 1).cast("string"), 2, "0")
    return base.select(
        *requests.columns,
        F.concat(day, F.lit("/11/2021")).alias("Dia"),
        F.concat(draw("a", 5, 7), F.lit(":"), draw("b", 50, 59), F.lit(" 11:30 12:30 "), draw("c", 17, 19), F.lit(":"), draw("d", 50, 59)).alias("Marcacao_Ponto"),
        F.when(chance("e") > 0.8, "Folga").otherwise("").alias("Faltas"),
        F.lit("").alias("AD_NOT"),
        F.lit("").alias("H_E_100"),
        F.when(chance("f") > 0.7, F.concat(F.lit("00:"), draw("g", 20, 59))).otherwise("").alias("H_E_50"),
        F.lit("").alias("H_NEG"),
        F.lit("").alias("COMP_DIA"),
        F.concat(draw("h", 7, 9), F.lit(":"), draw("i", 10, 50)).alias("SALDO"),
        (F.floor(F.col("_id") / DAYS) + 1).cast("int").alias("Pagina"),
    )


def synthetic_rows(spark: SparkSession, pages: str = "1-5", seed: int = 42) -> DataFrame:
    """The synthetic rows of one request."""
    page_range(pages)
    return synthetic_for(spark.range(1).select(F.lit(seed).alias("_seed"), F.lit(pages).alias("_pages")), "_seed", "_pages").drop("_seed", "_pages")


def day_lines(events: DataFrame) -> DataFrame:
    """user_id, day, times, kinds: the ordered clock times and event types of each user's day."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_type")))
    day = events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_type").groupBy("user_id", "day").agg(ordered.alias("e"))
    return day.select("user_id", "day", F.transform("e", lambda x: F.date_format(x["ts"], "HH:mm")).alias("times"), F.transform("e", lambda x: x["event_type"]).alias("kinds"))


def _page(days: DataFrame, line, head, tail: str) -> DataFrame:
    numbered = days.select("user_id", "day", line.alias("line")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "line"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    return numbered.select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.concat(head, body, F.lit(tail)).alias("text"))


def cards_a(events: DataFrame) -> DataFrame:
    """One layout A page per user: an error makes a day off, a signup puts a delimiter before the last time."""
    days = day_lines(events)
    all_but_last, last = F.slice("times", F.lit(1), F.size("times") - 1), F.element_at("times", -1)
    punched = F.when(F.array_contains("kinds", "signup"), F.concat_ws(" ", F.array_join(all_but_last, " "), F.lit("SALDO"), last)).otherwise(F.array_join("times", " "))
    off = F.when(F.array_contains("kinds", "error"), " FOLGA").otherwise("")
    line = F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit(" "), weekday_name(F.col("day")), off, F.lit(" "), punched)
    return _page(days, line, F.lit("Empresa X - Cartao\nDia Marcação Faltas\n"), "\ntotal 100:00\n10/11/2021 Qua 07:00 11:00")


def cards_b(events: DataFrame) -> DataFrame:
    """One layout B page per user, over the days from their first to their last event."""
    days = day_lines(events)
    line = F.concat(F.date_format("day", "dd"), F.lit(" "), weekday_name(F.col("day")), F.lit(" "), F.array_join("times", " "))
    written = lambda x: F.date_format(x["day"], "dd.MM.yyyy")
    head = F.concat(F.lit("Cartao Y\nPeríodo: "), written(F.element_at("all", 1)), F.lit(" a "), written(F.element_at("all", -1)), F.lit("\nDia Jornada Apontamento\n"))
    return _page(days, line, head, "\nresumo\n02 Sab 07:00 11:00")
