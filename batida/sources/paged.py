"""Page text in runs of pages, scanned by page range: a data source that opens the runs it needs, and no others.

A folder holds Parquet files per run of page numbers (run=1-64, run=65-128,
...). A scan plans one partition a file, after leaving out the runs beyond the
pages that the reader's option or the query's filters ask for; within a file,
row groups beyond them are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from batida.sources.pages import page_range
from batida.sources.workbook import store

FORMAT = "batida_pages"
RUN = 64  # pages of a run
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
NO_NUMBER = "run=__HIVE_DEFAULT_PARTITION__"
SCHEMA = "doc_id string, page_no int, text string"


def write_pages(pages: DataFrame, path: str, run: int = RUN, most_rows: int = 1_000_000) -> None:
    """pages (doc_id, page_no, text) as runs of `run` page numbers, from 1 on; a run's files have most_rows rows each at most.

    Most documents have early pages, so the first runs are the largest: AQE
    splits such a run over tasks when it rebalances.
    """
    first = F.floor((F.col("page_no") - 1) / run) * run + 1
    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "text")
    marked = rows.withColumn("run", F.concat(first.cast("string"), F.lit("-"), (first + run - 1).cast("string")))
    marked.hint("rebalance", "run").sortWithinPartitions("run", "page_no", "doc_id").write.mode("overwrite").option("maxRecordsPerFile", most_rows).partitionBy("run").parquet(path)


@dataclass
class File(InputPartition):
    path: str

    def __post_init__(self):
        super().__init__(self.path)


class PageReader(DataSourceReader):
    """Pages from self.first to self.last; None for a bound that is not set."""

    def __init__(self, options: dict):
        self.path = options["path"]
        bounds = page_range(options.get("pages", ""))
        self.first, self.last = bounds or (None, None)
        self.empty = False

    def _narrow(self, first: int | None, last: int | None) -> None:
        if first is not None:
            self.first = first if self.first is None else max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("page_no",) or getattr(f, "value", None) is None:
                yield f
            elif isinstance(f, EqualTo):
                self._narrow(f.value, f.value)
            elif isinstance(f, GreaterThanOrEqual):
                self._narrow(f.value, None)
            elif isinstance(f, GreaterThan):
                self._narrow(f.value + 1, None)
            elif isinstance(f, LessThanOrEqual):
                self._narrow(None, f.value)
            elif isinstance(f, LessThan):
                self._narrow(None, f.value - 1)
            elif isinstance(f, In) and all(v is not None for v in f.value) and f.value:
                self._narrow(min(f.value), max(f.value))
                yield f  # the bounds alone are used here
            else:
                yield f

    def _beyond(self, first: int, last: int) -> bool:
        return (self.last is not None and first > self.last) or (self.first is not None and last < self.first)

    def partitions(self) -> list[File]:
        from pyarrow import fs

        files, path = store(self.path)
        out = []
        for folder in files.get_file_info(fs.FileSelector(path)):
            if not folder.base_name.startswith("run="):
                continue
            if folder.base_name == NO_NUMBER:
                if self.first is not None or self.last is not None:
                    continue
            elif self._beyond(*map(int, folder.base_name.removeprefix("run=").split("-"))):
                continue
            out += [File(f.path) for f in files.get_file_info(fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet")]
        return sorted(out, key=lambda f: f.path) or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if not partition.path:
            return
        files, _ = store(self.path)
        with files.open_input_file(partition.path) as raw:
            file = pq.ParquetFile(raw)
            at = file.schema_arrow.names.index("page_no")
            groups = []
            for k in range(file.num_row_groups):
                stats = file.metadata.row_group(k).column(at).statistics
                if not (stats and stats.has_min_max and self._beyond(stats.min, stats.max)):
                    groups.append(k)
            for batch in file.iter_batches(row_groups=groups, columns=["doc_id", "page_no", "text"]):
                page = batch.column("page_no")
                if self.first is not None:
                    batch = batch.filter(pc.greater_equal(page, self.first))
                    page = batch.column("page_no")
                if self.last is not None:
                    batch = batch.filter(pc.less_equal(page, self.last))
                if batch.num_rows:
                    yield batch


class Pages(DataSource):
    """format(FORMAT): option path, and pages ('', 'n' or 'a-b')."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def scan_pages(spark: SparkSession, path: str, pages: str = "") -> DataFrame:
    """doc_id, page_no, text of a folder that write_pages made; pages and filters on page_no decide which files are opened.

    ValueError for a text that is no page range. Filters reach the scan where
    the session allows it (spark.sql.python.filterPushdown.enabled, set here);
    else Spark applies them to what is read.
    """
    page_range(pages)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Pages)
    return spark.read.format(FORMAT).option("pages", pages).load(path)
