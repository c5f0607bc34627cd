"""Frame operators: conforming, concatenation, calendar joins, page splits, look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batida.model import MISSING, PUNCH_COLUMNS
from batida.operators.order import row_index


def conform(df: DataFrame, columns=PUNCH_COLUMNS, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The columns in order, missing ones '0', nulls and empty cells '0'; before them those to keep as they are, all others dropped."""
    cell = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), MISSING).otherwise(F.col(c).cast("string"))
    return df.select(*keep, *[(cell(c) if c in df.columns else F.lit(MISSING)).alias(c) for c in columns])


def concat(frames: list[DataFrame], order: list[str] | None = None, index: str = "row_index") -> DataFrame:
    """All rows of the frames, nothing dropped. With an order, rows are numbered anew: frame after frame, each by order."""
    if order is None:
        return reduce(lambda a, b: a.unionByName(b), frames)
    marked = [f.withColumn("_frame", F.lit(k)) for k, f in enumerate(frames)]
    return row_index(concat(marked), ["_frame", *order], index).drop("_frame")


def calendar_first(calendar: DataFrame, rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """calendar (keys, cal_date, or keys and periods from d0 to d1) left-joined with the first of rows (keys, day, order, value) of that day of month.

    The relational form of layout B's look-up. First matches are aggregated
    map-side and gathered, 31 of a key at most; periods are joined with them as
    they are, and spread into days afterwards, so no day is shuffled or sorted.
    A period makes many rows of one, so periods are dealt over as many tasks as
    the session shuffles into first; by their size alone they would be few.
    A calendar given day by day is moved once, by key.
    """
    first = rows.where("day IS NOT NULL").groupBy(*keys, "day").agg(F.min_by(value, order).alias(value))
    by_day = first.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("day", value))).alias("_by_day"))
    found = calendar.join(by_day, keys, "left")
    if "cal_date" not in calendar.columns:
        days = F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("cal_date")
        tasks = int(calendar.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = found.repartition(tasks, F.xxhash64(*keys)).select(*[c for c in found.columns if c not in ("d0", "d1")], days)
    return found.withColumn(value, F.col("_by_day")[F.day("cal_date")]).drop("_by_day")


def distinct_pages(df: DataFrame, page: str = "Pagina", order: str | None = None) -> DataFrame:
    """Each page once, in order of its number, or of where it is first seen by a column to order by."""
    if order is None:
        return df.select(page).distinct().orderBy(page)
    return df.groupBy(page).agg(F.min(order).alias("_first")).orderBy("_first", page).select(page)


def page_frame(df: DataFrame, value, page: str = "Pagina") -> DataFrame:
    """One page's rows, without the page column."""
    return df.where(F.col(page) == value).drop(page)


def lookup(df: DataFrame, key: Column) -> DataFrame:
    """The first row that fits."""
    return df.where(key).limit(1)
