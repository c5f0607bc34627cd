"""Order, files, scans, logs and streams: what the registered queries do not show."""

import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from batida.operators import frames
from batida.operators.order import first_seen, row_index
from batida.plans import catalog, tasks
from batida.plans.tasklog import TaskLog
from batida.sources import database, paged, sinks, workbook
from batida.sources import pages as P
from batida.storage import file_system
from batida.streaming.cards import read_pages
from batida.streaming.progress import ProgressLog, read_batches, write_batches

SF = "/root/testdata/sf0.001"


def test_index_is_dense_and_in_order(spark):
    rows = [(k * 7919 % 1000, f"v{k}") for k in range(1000)] + [(None, "n")] * 3
    df = spark.createDataFrame(rows, "k int, v string").repartition(6)
    got = row_index(df, ["k"], parts=5).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(1003))
    assert [r.k for r in got] == [None] * 3 + list(range(1000))


def test_index_of_ties_spreads_them(spark):
    """Rows that are all alike are numbered by several tasks; descending orders, clashing names and no rows at all work too."""
    same = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("k"), F.lit(2).alias("_tie"), F.lit(3).alias("_at"), F.lit(4).alias("row_index"))
    got = row_index(same, ["k"], parts=8)
    assert got.rdd.getNumPartitions() > 1 and got.columns == ["k", "_tie", "_at", "row_index"]
    assert [tuple(r) for r in got.agg(F.min("row_index"), F.max("row_index"), F.count_distinct("row_index")).collect()] == [(0, 19_999, 20_000)]
    down = row_index(spark.range(100).repartition(3), [F.col("id").desc()], "n").orderBy("n").collect()
    assert [r.id for r in down] == list(range(99, -1, -1))
    assert row_index(spark.range(0), ["id"]).collect() == []


def test_index_has_no_single_partition_window(spark):
    df = spark.range(0, 1000, 1, 4)
    plans = row_index(df, ["id"], parts=4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plans and "SinglePartition" not in plans


def test_first_seen(spark):
    df = spark.createDataFrame([(5, "b"), (1, "c"), (9, "b"), (2, None), (3, "c"), (8, "a")], "at long, page string")
    assert [tuple(r) for r in first_seen(df, "page", "at").orderBy("rank").collect()] == [("c", 0), (None, 1), ("b", 2), ("a", 3)]


def test_concat_numbers_frames_in_turn(spark):
    a, b = spark.createDataFrame([(3,), (1,)], "k int"), spark.createDataFrame([(2,), (1,)], "k int")
    assert [r.k for r in frames.concat([a, b], ["k"]).orderBy("row_index").collect()] == [1, 3, 1, 2]


def punches(spark, n=500):
    return spark.range(0, n, 1, 4).select(
        F.lit("d").alias("doc_id"), (F.col("id") % 9).cast("int").alias("page_no"), F.col("id").cast("int").alias("line_no"),
        F.col("id").cast("string").alias("Dia"), F.lit("").alias("Dia_Semana"), F.when(F.col("id") % 2 == 0, "07:00").otherwise("0").alias("Entrada1"),
    )


def test_csv_in_ordered_parts(spark, tmp_path):
    counts = sinks.write_csv(punches(spark), f"{tmp_path}/out", parts=4)
    assert counts == {"n_rows": 500, "n_times": 250}
    parts = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    assert parts[0] == sinks.HEADER and len(parts) == 5
    want = sorted(range(500), key=lambda k: (k % 9, k))
    assert [int(r.Dia) for r in sinks.read_csv(spark, f"{tmp_path}/out", index="i").orderBy("i").collect()] == want
    sinks.name_single(punches(spark), f"{tmp_path}/out", f"{tmp_path}/one.csv")
    lines = (tmp_path / "one.csv").read_text().splitlines()
    assert lines[0] == "Dia;Dia_Semana;Entrada1;Saida1;Entrada2;Saida2" and [int(x.split(";")[0]) for x in lines[1:]] == want
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError):
        (tmp_path / "x").mkdir()
        sinks.name_single(punches(spark), f"{tmp_path}/x", f"{tmp_path}/y.csv")


def test_counting_needs_no_pass_of_its_own(spark, tmp_path):
    """Each page is extracted once: a run calls the source's rows once, counts included."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([("d", k, "Dia Marcação\n01/11/2021 Seg 07:00 11:00") for k in range(20)], "doc_id string, page_no int, text string")
    record = tasks.run(pages.mapInArrow(count, pages.schema), "A", str(tmp_path), "t")
    assert (record["n_pages"], record["n_rows"], record["n_times"], seen.value) == (20, 20, 40, 20)


def test_workbook_of_odd_cells(spark, tmp_path):
    cells = ["a&b<c>\"d\"", " x ", "tab\there\nline", "\x00\x0b\r bell\x07", "_x000B_ as such", "émile 中", "", None]
    df = spark.createDataFrame([(1 + k % 2, k, c) for k, c in enumerate(cells)], "Pagina int, k int, c string")
    assert workbook.write_workbook(df, f"{tmp_path}/b.xlsx", order=["k"], parts=3) == 2
    got = workbook.read_workbook(spark, f"{tmp_path}/b.xlsx").orderBy("page", "row_no").collect()
    want = {"1": [[str(k), c or ""] for k, c in enumerate(cells) if k % 2 == 0], "2": [[str(k), c or ""] for k, c in enumerate(cells) if k % 2]}
    assert {p: [r.cells for r in got if r.page == p] for p in want} == want
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert z.testzip() is None
    assert sorted(os.listdir(tmp_path)) == ["b.xlsx"]


def test_workbook_sheet_of_several_tasks(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 4).select(F.lit("p").alias("Pagina"), F.col("id").alias("n"), F.lit("word ").alias("t"))
    workbook.write_workbook(df, f"{tmp_path}/b.xlsx", order=["n"], parts=4)
    got = workbook.read_workbook(spark, f"{tmp_path}/b.xlsx").select("row_no", F.col("cells")[0].cast("long").alias("n"))
    assert got.where("row_no <> n + 1").isEmpty() and got.count() == 20_000


def test_workbook_abort_leaves_no_file(spark, tmp_path):
    bad = spark.range(0, 1000, 1, 4).select(F.lit(1).alias("Pagina"), F.when(F.col("id") == 990, F.raise_error(F.lit("broken row"))).otherwise("x").alias("c"), "id")
    with pytest.raises(Exception, match="broken row"):
        workbook.write_workbook(bad, f"{tmp_path}/b.xlsx", order=["id"], parts=4)
    spark.dataSource.register(workbook.Workbook)
    rows = spark.range(0, 100, 1, 4).select(F.lit("1").alias("page"), F.lit("<row></row>").alias("xml"))
    with pytest.raises(Exception, match="more than 60 rows"):  # no task has as many, so the commit finds it
        rows.write.format(workbook.FORMAT).option("path", f"{tmp_path}/b.xlsx").option("header", "").option("mostrows", 60).mode("append").save()
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="more than 9 rows"):
        workbook.write_workbook(spark.range(10).withColumn("Pagina", F.lit(1)), f"{tmp_path}/b.xlsx", most_rows=9)


def test_workbook_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "Pagina int, c string")
    assert workbook.write_workbook(none, f"{tmp_path}/b.xlsx") == 0
    assert workbook.read_workbook(spark, f"{tmp_path}/b.xlsx").collect() == []


def paged_rows(spark):
    return spark.createDataFrame([(f"d{d}", p, f"{d}/{p}") for d in range(5) for p in range(1, 101)] + [("n", None, "no number")], "doc_id string, page_no int, text string")


@pytest.mark.parametrize("how", ["option", "filter"])
def test_pages_beyond_the_range_are_not_opened(spark, tmp_path, how):
    path = f"{tmp_path}/runs"
    paged.write_pages(paged_rows(spark), path, run=10)
    for folder in os.listdir(path):
        if folder.startswith("run=") and folder not in ("run=21-30", "run=31-40"):
            for f in os.listdir(f"{path}/{folder}"):
                open(f"{path}/{folder}/{f}", "wb").close()  # reading it would fail
    df = paged.scan_pages(spark, path, "25-33") if how == "option" else paged.scan_pages(spark, path).where("page_no >= 25 AND page_no < 34")
    assert sorted((r.doc_id, r.page_no) for r in df.collect()) == [(f"d{d}", p) for d in range(5) for p in range(25, 34)]
    assert df.rdd.getNumPartitions() == 2


def test_page_scan(spark, tmp_path):
    path = f"{tmp_path}/runs"
    paged.write_pages(paged_rows(spark), path, run=10)
    read = lambda pages, where: sorted((r.doc_id, r.page_no) for r in paged.scan_pages(spark, path, pages).where(where).collect())
    assert len(read("", "true")) == 501
    assert read("7", "true") == [(f"d{d}", 7) for d in range(5)]
    assert read("1-50", "page_no IN (3, 60, 49) AND doc_id = 'd1'") == [("d1", 3), ("d1", 49)]
    assert read("200-300", "true") == [] and read("5-9", "page_no > 9") == []
    assert read("", "page_no IS NULL") == [("n", None)]
    with pytest.raises(ValueError):
        paged.scan_pages(spark, path, "9-5")


def test_a_hot_page_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 10_000, 1, 4).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(1).alias("Pagina"))
    sinks.write_by_page(rows, f"{tmp_path}/out", most_rows=1000)
    files = {f: os.listdir(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.startswith("Pagina=")}
    tasks_of = lambda page: {f.split("-")[1] for f in files[f"Pagina={page}"] if f.startswith("part-")}
    assert len(tasks_of(1)) > 1 and len(tasks_of(10)) == 1
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/out").selectExpr("cast(id AS long) id").distinct().count() == 10_000


def test_task_log(spark, tmp_path):
    log = TaskLog(spark, f"{tmp_path}/log")
    assert log.latest().collect() == []
    pages = spark.createDataFrame([("d", 1, "Dia Marcação\n01/11/2021 Seg 07:00 11:00")], "doc_id string, page_no int, text string")
    tasks.run(pages, "A", str(tmp_path), "good", log=log)
    tasks.run(pages.where("false"), "A", str(tmp_path), "empty", log=log)
    tasks.run(pages, "C", str(tmp_path), "bad", log=log)
    again = TaskLog(spark, f"{tmp_path}/log")  # as another session finds it
    last = {r.task_id: (r.status, r.progress, r.message) for r in again.latest().collect()}
    assert last["good"] == ("completed", 100, tasks.MESSAGES["done"]) and last["empty"] == ("error", 100, tasks.MESSAGES["empty"])
    assert last["bad"][:2] == ("error", 0) and "layout" in last["bad"][2]
    steps = [(r.current_step, r.message) for r in again.states().where("task_id = 'good'").orderBy("seq").collect()]
    assert steps == [(0, tasks.MESSAGES["begin"]), (3, tasks.MESSAGES["pages"]), (9, tasks.MESSAGES["join"]), (10, tasks.MESSAGES["done"])]
    assert again.look_up("unknown").collect() == [] and again.look_up("good").count() == 1
    assert "PushedFilters: [IsNotNull(task_id), EqualTo(task_id,good)]" in again.look_up("good")._jdf.queryExecution().executedPlan().toString()


def test_stream_restarts_repeat_no_row(spark, tmp_path):
    """A batch that was written, but not marked as done before a failure, runs again without repeating a row."""
    source, target, offsets = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/offsets"
    pages = spark.createDataFrame([(f"d{k}", 1, str(k)) for k in range(40)], "doc_id string, page_no int, text string")
    pages.repartition(4).write.parquet(source)
    runs = []

    def failing(batch):
        runs.append(1)
        if len(runs) == 3:
            raise RuntimeError("lost")
        return batch

    log = TaskLog(spark, f"{tmp_path}/log")
    listener = ProgressLog(log, "pages")
    spark.streams.addListener(listener)
    try:
        with pytest.raises(Exception, match="lost"):
            write_batches(read_pages(spark, source, 1), target, offsets, "pages", failing).awaitTermination(120)
        last = sorted(os.listdir(f"{offsets}/commits"))[-1]
        for name in (last, f".{last}.crc"):  # as if the driver was lost between writing and marking the batch
            os.remove(f"{offsets}/commits/{name}")
        write_batches(read_pages(spark, source, 1), target, offsets, "pages").awaitTermination(120)
        write_batches(read_pages(spark, source, 1), target, offsets, "pages").awaitTermination(120)
        got = read_batches(spark, target)
        assert sorted(int(r.text) for r in got.collect()) == list(range(40)) and got.select("batch").distinct().count() == 4
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    states = log.states().collect()
    assert {"started", "all batches are written"} <= {r.message for r in states} and any(r.status == "error" for r in states)
    assert sum(int(r.message.split()[2]) for r in states if r.message.startswith("batch")) >= 40


def test_database_scan_is_parallel_and_pushed_down(spark):
    df = catalog.customers_in_database(spark, SF, parts=3)
    assert df.rdd.getNumPartitions() == 3 and df.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    plan = df.where("c_name = 'Customer#000000007'").select("c_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_name,Customer#000000007)" in plan and "ReadSchema: struct<c_custkey" in plan


def test_database_scan_on_a_cluster(spark, monkeypatch):
    """Where driver and executors are several processes, the query has the same rows, and the database gets its filter."""
    one = sorted(map(tuple, catalog.jdbc_scan(spark, SF).collect()))
    monkeypatch.setattr(catalog, "is_local", lambda _: False)
    many = catalog.jdbc_scan(spark, SF)
    assert one and sorted(map(tuple, many.collect())) == one
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan batida_database" in plan and "BUILDING" not in plan  # Spark filters no more
    assert catalog.customers_in_database(spark, SF, parts=3).rdd.getNumPartitions() == 3


def test_database_files_keep_values(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, nan, "NaN"), (2, None, None, None), (2**62, -5, -inf, "x'\"\0y"), (None, 3, 0.5, ""), (-7, 4, 2.0, "ẞ✓")]
    df = spark.createDataFrame(rows, 'k long, `i"j` int, d double, s string')
    database.write_database(df, f"{tmp_path}/a", "k", 3)
    text = lambda rows: sorted(map(str, map(tuple, rows)))
    got = database.scan_database(spark, f"{tmp_path}/a")
    assert got.dtypes == df.dtypes and text(got.collect()) == text(df.collect())
    for where in ("d > 1", "d = double('NaN')", "d <= 2", "s = 'NaN'", "s >= 'x'", "k < 2 and d is not null", "`i\"j` is null", "s like '%y'", "k in (1, 2)"):
        assert text(got.where(where).collect()) == text(df.where(where).collect()), where
    assert text(database.scan_database(spark, f"{tmp_path}/a", ["s", "k"]).collect()) == text(df.select("s", "k").collect())
    database.write_database(df.where("false"), f"{tmp_path}/none", "k")
    assert database.scan_database(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="when"):
        database.write_database(spark.sql("select 1L k, current_date() when"), f"{tmp_path}/no", "k")


def test_database_scan_of_no_rows(spark):
    url = "jdbc:derby:memory:none;create=true"
    P.write_jdbc(spark.createDataFrame([], "k int"), url, "t", **catalog.DERBY)
    assert P.jdbc_table(spark, url, "t", key="k", **catalog.DERBY).count() == 0


def test_calendar_of_periods_moves_no_days(spark):
    """Periods are spread once they are joined: no exchange and no sort is above the days."""
    plan = catalog.calendar_fill(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < min(plan.index("Exchange"), plan.index("Sort"))
    periods = spark.sql("select * from values ('a', date'2019-01-30', date'2019-03-01'), ('b', date'2019-01-01', date'2019-01-02'), (null, date'2019-01-01', date'2019-01-01'), ('c', null, null) t(k, d0, d1)")
    rows = spark.createDataFrame([("a", 30, 2, "y"), ("a", 30, 1, "x"), ("a", 1, 9, "z"), ("a", None, 0, "n"), (None, 1, 1, "n")], "k string, day int, n int, v string")
    got = {(r.k, str(r.cal_date)): r.v for r in frames.calendar_first(periods, rows, ["k"], "n", "v").collect()}
    assert len(got) == 34 and {at: v for at, v in got.items() if v} == {("a", "2019-01-30"): "x", ("a", "2019-02-01"): "z", ("a", "2019-03-01"): "z"}


def test_shared_folder(spark, tmp_path):
    fs, where = file_system(spark, str(tmp_path))
    assert fs.exists(where)
    shutil.rmtree(tmp_path)
    assert not fs.exists(where)
