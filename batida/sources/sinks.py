"""Writers: the six-column CSV in ordered parts, files per page, and workbooks."""

from __future__ import annotations

from datetime import datetime
from typing import BinaryIO

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batida.model import MISSING, PREFIX, PUNCH_COLUMNS, SLOTS
from batida.operators.frames import conform
from batida.operators.order import row_index
from batida.sources.workbook import MOST_ROWS, write_workbook
from batida.storage import file_system, materialize, new_path, remove

ORDER = ("doc_id", "page_no", "line_no", "cal_date")
HEADER = "part-0000-header.csv"  # its name sorts before those of the parts with rows
PARTS = "part-[0-9][0-9][0-9][0-9][0-9]*"
BUFFER = 1 << 20


class EmptyResult(Exception):
    """No table was found in any page."""


def write_csv(punches: DataFrame, path: str, parts: int | None = None) -> dict[str, int]:
    """The conformed columns in output order, ';'-separated, as a folder of part files that follow each other by name.

    Records are extracted once, into a table, and the pass that writes it
    counts them: n_rows and n_times (filled slots) are returned. Sampled ranges
    of the order (parts of them, or as many as the session shuffles into) are
    then sorted and written by a task each. The header is a file of its own,
    the first. Without any rows nothing is left in path, and EmptyResult is
    raised.
    """
    spark = punches.sparkSession
    keys = [c for c in ORDER if c in punches.columns]
    filled = sum((F.col(c) != MISSING).cast("long") for c in SLOTS)
    made = Observation()
    table = materialize(conform(punches, keep=keys).observe(made, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("n_times")))
    counts = made.get
    remove(spark, path)
    if counts["n_rows"] == 0:
        remove(spark, table._batida_path)
        raise EmptyResult("no rows")
    ordered = table
    if keys:
        ordered = (table.repartitionByRange(parts, *keys) if parts else table.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ordered.select(*PUNCH_COLUMNS).write.option("sep", ";").option("header", False).csv(path)
    fs, where = file_system(spark, f"{path}/{HEADER}")
    out = fs.create(where, True)
    out.write(bytearray((";".join(PUNCH_COLUMNS) + "\n").encode()))
    out.close()
    remove(spark, table._batida_path)
    return counts


def read_csv(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """The rows of a folder that write_csv made; with index, numbered from 0 in the order of its files and their lines."""
    schema = ", ".join(f"{c} string" for c in PUNCH_COLUMNS)
    rows = spark.read.option("sep", ";").option("header", False).option("pathGlobFilter", PARTS).schema(schema).csv(path)
    if index is None:
        return rows
    # lines of a file that is read in pieces: pieces by where they begin, lines as they are read
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return row_index(placed, ["_file", "_start"], index).drop("_file", "_start")


def name_single(df: DataFrame, folder: str, target: str) -> None:
    """Joins the part files of a written folder, in order, to one file, target.

    A file system that can concatenate does so without moving bytes; elsewhere
    they are copied part after part, a buffer at a time. target is there when
    it is whole, not before.
    """
    jvm = df.sparkSession.sparkContext._jvm
    fs, where = file_system(df.sparkSession, folder)
    parts = sorted((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if not parts or parts[0].getName() != HEADER:
        raise ValueError(f"{folder} was not written by write_csv")
    whole = parts[0]
    try:
        array = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for k, part in enumerate(parts[1:]):
            array[k] = part
        fs.concat(whole, array)
    except UnsupportedOperationException:
        whole = jvm.org.apache.hadoop.fs.Path(folder, "whole")
        out = fs.create(whole, True)
        for part in parts:
            stream = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BUFFER, False)
            stream.close()
        out.close()
    fs.rename(whole, file_system(df.sparkSession, target)[1])
    fs.delete(where, True)


def display_name(now: datetime, prefix: str = PREFIX) -> str:
    return f"{prefix}_ponto_extraido_{now:%Y%m%d_%H%M%S}.csv"


def workbook_name(now: datetime) -> str:
    return f"TESTE_debug_{now:%Y%m%d_%H%M%S}.xlsx"


def write_by_page(df: DataFrame, path: str, page: str = "Pagina", most_rows: int = 1_000_000) -> None:
    """A folder of CSV files per page, of most_rows rows each at most.

    A page of more rows than that is dealt to as many tasks as it needs files,
    by salts from the pages' counts; any other page is written by one.
    """
    row, salts, known = "_row", "_salts", "_known_page"
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()))
    counts = numbered.groupBy(F.col(page).alias(known)).agg(F.ceil(F.count(F.lit(1)) / most_rows).alias(salts)).where(F.col(salts) > 1)
    dealt = numbered.join(counts, F.col(page).eqNullSafe(F.col(known)), "left")
    salt = F.pmod(F.xxhash64(row), F.coalesce(salts, F.lit(1)))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.withColumn("_salt", salt).repartition(partitions, page, "_salt").drop("_salt", row, salts, known)
    spread.write.mode("overwrite").partitionBy(page).option("maxRecordsPerFile", most_rows).option("sep", ";").option("header", True).csv(path)
    remove(df.sparkSession, numbered._batida_path)


def workbook(df: DataFrame, file: BinaryIO, page: str = "Pagina", most_rows: int = MOST_ROWS) -> int:
    """Writes a spreadsheet file with one sheet per page to an open file; returns the number of sheets."""
    spark = df.sparkSession
    path = new_path(spark, "workbook")
    sheets = write_workbook(df, path, page, most_rows=most_rows)
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    while chunk := stream.readNBytes(BUFFER):
        file.write(bytes(chunk))
    stream.close()
    remove(spark, path)
    return sheets
