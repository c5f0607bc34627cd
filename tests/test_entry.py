"""The registered queries against their SQL twins on the smallest tables."""

import datetime
import os
import sys

import pytest

import __spark_entry__
from batida.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(frame, columns):
    """Sorted rows; a date and a midnight timestamp are the same."""
    plain = lambda v: v.date() if isinstance(v, datetime.datetime) and v.time() == datetime.time() else v
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[-6:] == ["Dia", "Dia_Semana", "Entrada1", "Saida1", "Entrada2", "Saida2"]
    assert out.count() > 0


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_extraction_has_no_shuffle(spark):
    """From pages on, both layouts are one narrow stage without Python."""
    from batida.operators.layouts import extract

    pages = spark.read.schema("doc_id string, page_no int, text string").parquet(f"{SF}/documents.parquet")
    for layout in "AB":
        plan = extract(pages, layout)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def test_entry_without_llm(tmp_path):
    """In a copy without the llm folders the entry imports and lists the engine's own queries, with the pipeline's file and without."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    said = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'layout_a_extract' in q and 'pipeline' not in q"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "copy" / name).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
