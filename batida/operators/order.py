"""Dense row numbers and first-seen order, by prefix sums over partitions.

No window runs over all rows: a partition numbers its own rows, and the
partitions' counts, one number each, are added up. Rows are written once in
their order, so that the partitions that are counted are those that are
numbered, whatever executors are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batida.storage import materialize

PART_BITS = 33  # of a monotonically increasing id: where in its partition the row stands


def _free(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_index(df: DataFrame, order: list[str | Column] | None = None, name: str = "row_index", parts: int | None = None) -> DataFrame:
    """df with a dense index from 0 in the given order, or in the order rows are read if there is none.

    Rows are dealt into sampled ranges of the order (parts of them, or as many
    as the session shuffles into) and sorted there; rows that tie keep the
    order they are read in and are spread over ranges like any others. A column
    of the index's name gives way to it.
    """
    rows = df.drop(name)
    tie, at = _free(rows, "_tie"), _free(rows, "_at")
    if order:
        keys = [*order, tie]
        tied = rows.withColumn(tie, F.monotonically_increasing_id())
        dealt = tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)
        rows = dealt.sortWithinPartitions(*keys).drop(tie)
    numbered = materialize(rows.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, PART_BITS)
    counts = dict(numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    # one row a partition; the names can't clash
    p, b = _free(numbered, "_part"), _free(numbered, "_before")
    table = df.sparkSession.createDataFrame(offsets, f"`{p}` long, `{b}` long")
    joined = numbered.withColumn(p, part).join(F.broadcast(table), p)
    index = F.col(b) + F.col(at).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return joined.withColumn(name, index).drop(p, b, at)


def first_seen(df: DataFrame, column: str, index: str, name: str = "rank") -> DataFrame:
    """column, name: each value once, with its place among the values in the order they are first seen by index.

    Partial minima reach the shuffle, one row a value and partition. A null is a value.
    """
    first = df.groupBy(column).agg(F.min(index).alias("_first"))
    return row_index(first, ["_first"], name).select(column, name)
