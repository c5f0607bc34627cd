"""PDF files to page text. Rasterizing and OCR are pluggable and imported in the workers alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOLUTION = 300
OCR_OPTIONS = "--oem 3 --psm 6 -l por"


def page_range(pages: str | None) -> tuple[int, int] | None:
    """'a-b' and 'n' as bounds, '' as None (all pages). ValueError for anything else, reversed ranges included."""
    if not pages:
        return None
    found = re.fullmatch(r"\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?", pages)
    if not found:
        raise ValueError(f"no page range: {pages!r}")
    first, last = int(found[1]), int(found[2] or found[1])
    if last < first:
        raise ValueError(f"reversed page range: {pages!r}")
    return first, last


def read_file(path: str) -> bytes:
    """A file of any store that pyarrow knows, opened where it is worked on."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    with store.open_input_stream(name) as stream:
        return stream.read()


def count_pages(content: bytes) -> int:
    from pdf2image import pdfinfo_from_bytes

    return int(pdfinfo_from_bytes(content)["Pages"])


def rasterize(content: bytes, page: int):
    """The image of one page, by pdf2image."""
    from pdf2image import convert_from_bytes

    return convert_from_bytes(content, dpi=RESOLUTION, first_page=page, last_page=page)[0]


def read_text(image, binary: str | None = None) -> str:
    """Text of one image, by OpenCV and Tesseract; binary: where Tesseract is, if it is not on the path."""
    import cv2
    import numpy as np
    import pytesseract

    if binary:
        pytesseract.pytesseract.tesseract_cmd = binary
    grey = cv2.cvtColor(np.array(image), cv2.COLOR_RGB2GRAY)
    return pytesseract.image_to_string(cv2.bilateralFilter(grey, 9, 75, 75), config=OCR_OPTIONS)


def attempt(function: Callable, *args, instead=None):
    """function(*args), or `instead` where it fails for the data; a missing library is an error."""
    try:
        return function(*args)
    except ImportError:
        raise
    except Exception:
        return instead


def pdf_pages(
    spark: SparkSession, path: str, pages: str = "", count: Callable[[bytes], int] = count_pages, to_image: Callable = rasterize,
    to_text: Callable = read_text, read: Callable[[str], bytes] = read_file, binary: str | None = None,
) -> DataFrame:
    """doc_id (the path), page_no, text of each PDF's pages.

    A file that can't be read gives no rows, a page that can't be read ''. The
    scan lists names alone; files are counted, then each (file, page) is one
    row, dealt over all tasks, and a task holds one file and renders one page
    at a time. Pages are numbered from the start of a range 'a-b', else from 1.
    ValueError without a path or for a text that is no page range.
    """
    if not path or not path.strip():
        raise ValueError("no path of PDF files")
    bounds = page_range(pages)
    begin = bounds[0] if bounds and "-" in pages else 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path")
    more = (binary,) if binary else ()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                n = attempt(lambda name=name: count(read(name)), instead=0)
                yield pa.RecordBatch.from_pydict({"path": pa.array([name], pa.string()), "pages": pa.array([n], pa.int32())})

    first, last = (F.lit(1), F.col("pages")) if bounds is None else (F.lit(bounds[0]), F.least("pages", F.lit(bounds[1])))
    known = files.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(counted, "path string, pages int")
    planned = known.where(last >= first).select("path", F.explode(F.sequence(first, last)).alias("page"))
    dealt = planned.repartition(spark.sparkContext.defaultParallelism * 4).sortWithinPartitions("path", "page")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, content = None, b""
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != held:
                    held, content = name, attempt(read, name, instead=b"")
                text = attempt(lambda page=page: to_text(to_image(content, page), *more), instead="")
                number = page - (bounds[0] if bounds else 1) + begin
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([name], pa.string()), "page_no": pa.array([number], pa.int32()), "text": pa.array([text], pa.string())})

    return dealt.mapInArrow(texts, "doc_id string, page_no int, text string")


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A relational table, read by as many connections as parts, each a range of the numeric or date column key.

    The ranges are of equal width between the key's least and greatest value,
    which the database finds; without a key, or without values of it, one
    connection reads the table. Filters and column selection reach the database.
    """
    ranges = {}
    if key:
        quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        least, greatest = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({quoted}) AS least, MAX({quoted}) AS greatest FROM {table}", **options).load().first()
        if least is not None:
            ranges = {"partitionColumn": key, "lowerBound": str(least), "upperBound": str(greatest), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options, **ranges).load()


def write_jdbc(df: DataFrame, url: str, table: str, types: str = "", parts: int = 8, **options: str) -> None:
    """Replaces a relational table by df, over as many connections as parts at most. types: the database's column types, where Spark's choice won't do."""
    writer = df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=table, numPartitions=str(parts), **options)
    (writer.option("createTableColumnTypes", types) if types else writer).save()


def users(spark: SparkSession, url: str, table: str = "user", key: str | None = None, **options: str) -> DataFrame:
    """A relational table of users; filters on username reach the database."""
    return jdbc_table(spark, url, table, key, **options)


def create_users(spark: SparkSession, table: str = "users") -> None:
    """The user table, if it is missing. Spark can't enforce unique names."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (id INT, username STRING, password BINARY) USING parquet")
