"""Spreadsheet files as a data source of Spark: one sheet per page, written by tasks, committed as a whole.

Rows come range-partitioned and sorted by page. A task streams each page's
rows into a part file, compressed as it goes; the commit lays the compressed
parts of a sheet one behind the other, which makes a valid archive without
unpacking or holding them. An abort leaves neither parts nor a file.
"""

from __future__ import annotations

import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MOST_ROWS = 1_048_575  # of a sheet, as the file format has it, without the header
BUFFER = 1 << 20
FORMAT = "batida_workbook"

# Fixed values of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
CONTROLS = "[\x00-\x08\x0b-\x1f]"  # characters that are written as _xHHHH_


def store(path: str) -> tuple:
    """The pyarrow file system of a path and the path in it."""
    import os

    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings, one behind the other, from theirs and the second's size."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for k, row in enumerate(matrix):
            out ^= row if vector >> k & 1 else 0
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]  # moves a crc on by one zero bit
    bits = size * 8
    while bits:
        if bits & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        bits >>= 1
    return first ^ second


@dataclass
class Part:
    """One page's rows in one task: a file of compressed bytes that end at a byte, without an end mark."""

    page: str
    path: str
    rows: int
    crc: int
    size: int
    packed: int


@dataclass
class Parts(WriterCommitMessage):
    task: int
    parts: list[Part] = field(default_factory=list)


class WorkbookWriter(DataSourceArrowWriter):
    """Takes rows (page string, xml string), sorted by page across tasks."""

    def __init__(self, options: dict):
        self.path, self.header, self.most_rows = options["path"], options["header"], int(options["mostrows"])
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        from pyspark import TaskContext

        context = TaskContext.get()
        done = Parts(context.partitionId())
        fs, folder = store(self.folder)
        fs.create_dir(folder, recursive=True)
        out = packer = part = None
        controls = re.compile(CONTROLS)

        def close() -> None:
            if part is not None:
                part.packed += out.write(packer.flush(zlib.Z_SYNC_FLUSH))
                out.close()

        for batch in iterator:
            for page, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part is None or page != part.page:
                    close()
                    part = Part(page, f"{folder}/{done.task}-{context.taskAttemptId()}-{len(done.parts)}", 0, 0, 0, 0)
                    done.parts.append(part)
                    out, packer = fs.open_output_stream(part.path), zlib.compressobj(6, zlib.DEFLATED, -15)
                raw = controls.sub(lambda m: f"_x{ord(m[0]):04X}_", xml).encode()
                part.rows, part.size, part.crc = part.rows + 1, part.size + len(raw), zlib.crc32(raw, part.crc)
                part.packed += out.write(packer.compress(raw))
                if part.rows > self.most_rows:
                    raise ValueError(f"a sheet has more than {self.most_rows} rows")
        close()
        return done

    def commit(self, messages: list[Parts | None]) -> None:
        sheets: dict[str, list[Part]] = {}
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for part in message.parts:
                sheets.setdefault(part.page, []).append(part)
        for parts in sheets.values():
            if sum(p.rows for p in parts) > self.most_rows:
                raise ValueError(f"a sheet has more than {self.most_rows} rows")
        fs, target = store(self.path)
        with fs.open_output_stream(target + ".new") as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            for number, parts in enumerate(sheets.values(), 1):
                begin = f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{self.header}'.encode()
                self._sheet(fs, z, f"xl/worksheets/sheet{number}.xml", begin, parts, b"</sheetData></worksheet>")
            for name, text in self._around(list(sheets)).items():
                z.writestr(name, text)
        fs.move(target + ".new", target)
        self._clean()

    @staticmethod
    def _sheet(fs, z: zipfile.ZipFile, name: str, begin: bytes, parts: list[Part], end: bytes) -> None:
        """One entry of the archive from bytes that are packed already."""
        first = zlib.compressobj(6, zlib.DEFLATED, -15)
        first_packed = first.compress(begin) + first.flush(zlib.Z_SYNC_FLUSH)
        last = zlib.compressobj(6, zlib.DEFLATED, -15)
        last_packed = last.compress(end) + last.flush()
        crc = zlib.crc32(begin)
        for part in parts:
            crc = joined_crc(crc, part.crc, part.size)
        entry = zipfile.ZipInfo(name)
        entry.compress_type = zipfile.ZIP_DEFLATED
        entry.CRC = joined_crc(crc, zlib.crc32(end), len(end))
        entry.file_size = len(begin) + sum(p.size for p in parts) + len(end)
        entry.compress_size = len(first_packed) + sum(p.packed for p in parts) + len(last_packed)
        entry.header_offset = z.fp.tell()
        z.fp.write(entry.FileHeader())
        z.fp.write(first_packed)
        for part in parts:
            with fs.open_input_stream(part.path) as packed:
                while chunk := packed.read(BUFFER):
                    z.fp.write(chunk)
        z.fp.write(last_packed)
        z.filelist.append(entry)
        z.NameToInfo[name] = entry
        z.start_dir = z.fp.tell()
        z._didModify = True

    @staticmethod
    def _around(pages: list[str]) -> dict[str, str]:
        """The entries that tell a reader of the sheets."""
        from xml.sax.saxutils import quoteattr

        numbers = range(1, len(pages) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}.worksheet+xml"/>' for k in numbers)
        names = "".join(f'<sheet name={quoteattr("Pagina_" + page)} sheetId="{k}" r:id="r{k}"/>' for k, page in zip(numbers, pages, strict=True))
        links = "".join(f'<Relationship Id="r{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        return {
            "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{kinds}</Types>',
            "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
        }

    def abort(self, messages: list[Parts | None]) -> None:
        fs, target = store(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(target + ".new").type != FileType.NotFound:
            fs.delete_file(target + ".new")
        self._clean()

    def _clean(self) -> None:
        from pyarrow.fs import FileType

        fs, folder = store(self.folder)
        if fs.get_file_info(folder).type != FileType.NotFound:
            fs.delete_dir(folder)


@dataclass
class Sheet(InputPartition):
    name: str
    page: str

    def __post_init__(self):
        super().__init__(self.name)


class WorkbookReader(DataSourceReader):
    """One partition a sheet; its rows are read as a stream."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Sheet]:
        import xml.etree.ElementTree as ET

        fs, path = store(self.path)
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
            book = ET.fromstring(z.read("xl/workbook.xml"))
            links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = book.iter(f"{{{MAIN}}}sheet")
        return [Sheet("xl/" + links[s.get(f"{{{LINKS}}}id")], s.get("name").removeprefix("Pagina_")) for s in sheets] or [Sheet("", "")]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        import xml.etree.ElementTree as ET

        if not partition.name:
            return
        code = re.compile("_x([0-9A-Fa-f]{4})_")
        fs, path = store(self.path)
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z, z.open(partition.name) as xml:
            number, top = -1, None
            for event, element in ET.iterparse(xml, ("start", "end")):
                if event == "start" and element.tag == f"{{{MAIN}}}sheetData":
                    top = element
                if event == "end" and element.tag == f"{{{MAIN}}}row":
                    number += 1
                    if number:
                        cells = ["".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t")) for c in element.iter(f"{{{MAIN}}}c")]
                        yield partition.page, number, [code.sub(lambda m: chr(int(m[1], 16)), c) for c in cells]
                    top.clear()


class Workbook(DataSource):
    """format(FORMAT): reads (page, row_no, cells), writes (page, xml) rows as write_workbook makes them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "page string, row_no long, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options))


def _row(cells: list[Column]) -> Column:
    def escaped(v: Column) -> Column:
        v = F.regexp_replace(v, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
        return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    cell = lambda v: F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), escaped(v), F.lit("</t></is></c>"))
    return F.concat(F.lit("<row>"), *[cell(v) for v in cells], F.lit("</row>"))


def write_workbook(df: DataFrame, path: str, page: str = "Pagina", order: list[str] | None = None, parts: int | None = None, most_rows: int = MOST_ROWS) -> int:
    """A spreadsheet file with a sheet of each page, in order of the pages; returns the number of sheets.

    Rows stand in the given order, or as they are read. Cells are text, a null
    is empty. Pages are checked against most_rows by their counts first, so a
    page that is too long is an error before anything is written. A page
    without a name (null) is an empty name.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.agg(F.count(F.lit(1)), F.max("n")).first()
    if (full[1] or 0) > most_rows:
        raise ValueError(f"a sheet has more than {most_rows} rows")
    cells = [c for c in df.columns if c != page]
    body = _row([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cells])
    header = spark.range(1).select(_row([F.lit(c) for c in cells])).first()[0]
    keys = [page, *(order or []), "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = (tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    spark.dataSource.register(Workbook)
    rows = dealt.select(F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), body.alias("xml"))
    rows.write.format(FORMAT).option("path", path).option("header", header).option("mostrows", most_rows).mode("append").save()
    return full[0]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """page, row_no (from 1, below the header), cells of every sheet."""
    spark.dataSource.register(Workbook)
    return spark.read.format(FORMAT).load(path)
