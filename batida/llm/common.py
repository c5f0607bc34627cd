"""Helpers shared by the operators: reading, shared storage, text rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batida.storage import materialize, remove, shared_dir

__all__ = ["BLOCK_BYTES", "SLICE", "add_from_texts", "held_out", "materialize", "remove", "runs", "shared_dir", "table", "text_bytes"]

#: bytes of text that one block of documents holds on average.
BLOCK_BYTES = 2 << 20
#: bytes of text that a task works on at a time.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, to size blocks and buckets by."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, rows) of runs of about SLICE bytes of text, whole texts each."""
    begin, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        held += size
        if held >= SLICE:
            yield begin, i + 1 - begin
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts) - begin


def add_from_texts(docs: DataFrame, added: dict[str, str], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """docs with columns computed from its texts in Arrow batches, without a join.

    added: name -> DDL type. make() is called once per task and gives the
    function from a list of texts (null: None) to one list or array per added
    column; it gets runs of about SLICE bytes of text, whole texts each. A
    column of docs with the name of an added one, in any case, gives way to it.
    """
    taken = {c.lower() for c in added}
    own = [c for c in docs.columns if c.lower() not in taken]
    at = own.index("text")
    kinds = dict(docs.dtypes)
    names = [f"c{i}" for i in range(len(own))] + [f"x{i}" for i in range(len(added))]
    ddl = ", ".join(f"{n} {k}" for n, k in zip(names, [*(kinds[c] for c in own), *added.values()], strict=True))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for begin, n in runs(batch.column(at)):
                part = batch.slice(begin, n)
                new = work(part.column(at).to_pylist())
                fields = [schema.field(len(own) + k) for k in range(len(new))]
                arrays = [part.column(k) for k in range(len(own))] + [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(new, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, ddl)
    return out.toDF(*own, *added)
