"""A table in database files that all processes reach: a data source over SQLite files in the shared folder.

An embedded database is open to one process alone, so a session of several
processes can't read one over JDBC. Here each task writes its range of a key
into a file of its own, and a scan opens one file a task. Filters and the
columns that are asked for reach the database as SQL. Files count from the
commit on, so those of tasks that failed or ran twice are never read.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from batida.sources.paged import PUSHDOWN
from batida.sources.workbook import store

FORMAT = "batida_database"
LIST = "files.json"  # the files that were committed, and the columns
KINDS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS = 10_000  # fetched at once
COPY = 1 << 20
NAN = "NaN"  # SQLite takes a NaN for a null; as a text it is greater than all numbers, as in Spark


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def stored(value):
    return NAN if isinstance(value, float) and math.isnan(value) else value


@dataclass
class Written(WriterCommitMessage):
    name: str


class DatabaseWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], [(f.name, f.dataType.simpleString()) for f in schema]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import sqlite3

        name = f"{uuid.uuid4().hex}.sqlite"
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        with tempfile.TemporaryDirectory() as own:
            base = sqlite3.connect(f"{own}/{name}")
            base.execute("PRAGMA journal_mode = OFF")
            base.execute("CREATE TABLE t (" + ", ".join(f"{quoted(c)} {KINDS[kind]}" for c, kind in self.columns) + ")")
            insert = "INSERT INTO t VALUES (" + ", ".join("?" * len(self.columns)) + ")"
            for batch in iterator:
                base.executemany(insert, zip(*[map(stored, c.to_pylist()) for c in batch.columns], strict=True))
            base.commit()
            base.close()
            with open(f"{own}/{name}", "rb") as file, fs.open_output_stream(f"{folder}/{name}") as out:
                while chunk := file.read(COPY):
                    out.write(chunk)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{LIST}.new") as out:
            out.write(json.dumps({"files": sorted(m.name for m in messages if m), "columns": self.columns}).encode())
        fs.move(f"{folder}/{LIST}.new", f"{folder}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{folder}/{m.name}")


@dataclass
class File(InputPartition):
    name: str

    def __post_init__(self):
        super().__init__(self.name)


class DatabaseReader(DataSourceReader):
    """One partition a file; self.where holds the filters that reached the database, self.values what they compare with."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], [f.name for f in schema]
        self.kinds = [f.dataType.simpleString() for f in schema]
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            known = len(column) == 1 and column[0] in self.names
            if known and isinstance(f, IsNotNull):
                self.where.append(f"{quoted(column[0])} IS NOT NULL")
            elif known and isinstance(f, IsNull):
                self.where.append(f"{quoted(column[0])} IS NULL")
            elif known and type(f) in SIGNS and isinstance(f.value, (int, float, str)):
                self.where.append(f"{quoted(column[0])} {SIGNS[type(f)]} ?")
                self.values.append(stored(f.value))
            else:
                yield f

    def sql(self) -> str:
        return f"SELECT {', '.join(map(quoted, self.names))} FROM t" + (f" WHERE {' AND '.join(self.where)}" if self.where else "")

    def partitions(self) -> list[File]:
        fs, folder = store(self.path)
        with fs.open_input_stream(f"{folder}/{LIST}") as file:
            return [File(name) for name in json.loads(file.read())["files"]] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import sqlite3
        from urllib.parse import quote

        from pyarrow import fs as F

        if not partition.name:
            return
        types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        fs, folder = store(self.path)
        with tempfile.TemporaryDirectory() as own:
            where = f"{folder}/{partition.name}"
            if not isinstance(fs, F.LocalFileSystem):
                with fs.open_input_stream(where) as file, open(f"{own}/t", "wb") as out:
                    while chunk := file.read(COPY):
                        out.write(chunk)
                where = f"{own}/t"
            base = sqlite3.connect(f"file:{quote(where)}?mode=ro&immutable=1", uri=True)
            found = base.execute(self.sql(), self.values)
            while rows := found.fetchmany(ROWS):
                columns = [[float(v) if v == NAN else v for v in c] if kind == "double" else c for c, kind in zip(zip(*rows, strict=True), self.kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, types[kind]) for c, kind in zip(columns, self.kinds, strict=True)], names=self.names)
            base.close()


class Database(DataSource):
    """format(FORMAT): option path; the schema of a scan names the columns to select."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DatabaseReader:
        return DatabaseReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(dict(self.options), schema)


def write_database(df: DataFrame, path: str, key: str, parts: int | None = None) -> None:
    """df (long, int, double and string columns) as database files, each a range of key; as many as parts, or as the session shuffles into.

    A file is built in the task's temporary folder and copied when it is whole.
    ValueError for columns of other types.
    """
    other = [c for c, kind in df.dtypes if kind not in KINDS]
    if other:
        raise ValueError(f"no columns of a database file: {', '.join(other)}")
    df.sparkSession.dataSource.register(Database)
    dealt = df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)
    dealt.write.format(FORMAT).option("path", path).mode("append").save()


def scan_database(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a folder that write_database made, or these columns of them; filters reach the database.

    They do where the session allows it (spark.sql.python.filterPushdown.enabled,
    set here); else Spark applies them to what is read. A filter needs its
    column among those that are asked for.
    """
    fs, folder = store(path)
    with fs.open_input_stream(f"{folder}/{LIST}") as file:
        kinds = dict(json.loads(file.read())["columns"])
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Database)
    return spark.read.format(FORMAT).schema(", ".join(f"`{c}` {kinds[c]}" for c in columns or kinds)).load(path)
