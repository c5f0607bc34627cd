"""Golden pages of both layouts and the operators they are made of."""

import io
import itertools
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from batida.functions import scalars as S
from batida.functions.text import lines, strip
from batida.model import CARD_PAGES, DELIMITERS_A, PUNCH_COLUMNS
from batida.operators import frames
from batida.operators.bounds import end_a, start_a
from batida.operators.layouts import extract, layout_b
from batida.plans import tasks
from batida.sources import pages as P
from batida.sources import sinks
from batida.sources.synthetic import synthetic_rows
from batida.streaming.cards import extract_stream

Z = ("0", "0", "0", "0")

A = {
    "main": (
        "Empresa X - Cartao\nDia Marcação Faltas\n01/11/2021 Seg 07:00 11:00 12:00 17:00 SALDO 01:00\n02/11/2021 Ter 7:05 11:00 12:00 H.E.50% 00:30\n"
        "03/11/2021 Qua 07:00\n04/11/2021 Qui FOLGA 07:00 11:00\n05/11/2021 Sáb 08:00 12:00\n06/11/2021 Dom 25:10 07:00 11:00 12:00 17:00\n"
        "07/11/2021 00:00 06:00\n08/11/2021 07:00 11:00 Seg 12:00 17:00\n09/11/2021 Ter 07:00 TOT 11:00 SP 12:00 17:00\n99/99/2021 Qua 07:00 11:00\n"
        "linha sem data 07:00 11:00\ntotal 100:00\n10/11/2021 Qua 07:00 11:00",
        [
            ("01/11/2021", "Seg", "07:00", "11:00", "12:00", "17:00"), ("02/11/2021", "Ter", "07:05", "11:00", "0", "0"), ("03/11/2021", "Qua", *Z), ("04/11/2021", "Qui", *Z),
            ("05/11/2021", "Sab", "08:00", "12:00", "0", "0"), ("06/11/2021", "Dom", "07:00", "11:00", "0", "0"), ("07/11/2021", "0", "24:00", "06:00", "0", "0"),
            ("08/11/2021", "Seg", "12:00", "17:00", "0", "0"), ("09/11/2021", "Ter", "07:00", "11:00", "0", "0"), ("99/99/2021", "Qua", "07:00", "11:00", "0", "0"),
        ],
    ),
    "header ends": ("Dia Marcação Total\n01/11/2021 Seg 07:00 11:00", []),
    "blank start": ("\n01/11/2021 Seg 07:00 11:00", []),
    "form feed": ("01/11/2021 Seg 07:00 11:00\n\x0c\n02/11/2021 Ter 07:00 11:00", [("01/11/2021", "Seg", "07:00", "11:00", "0", "0")]),
    "loose": (
        "123/11/20215 Seg 8:00 12:00h 13:00 17:30\nDia Data 02/11/2021 Qua 07:00 11:00\n03/11/2021 Conferido 07:00 11:00",
        [("23/11/2021", "Seg", "08:00", "13:00", "0", "0"), ("02/11/2021", "Qua", "07:00", "11:00", "0", "0"), ("03/11/2021", "0", *Z)],
    ),
    "many": (
        "04/11/2021 Qui 07:00 11:00 12:00 17:00 18:00 19:00\n04/11/2021 Qui 00:00 0:30 29:59 12:00",
        [("04/11/2021", "Qui", "07:00", "11:00", "12:00", "17:00"), ("04/11/2021", "Qui", "24:00", "00:30", "0", "0")],
    ),
    "empty": ("", []),
    "null": (None, []),
}
DAY = "Período: 01.02.2019 a 02.02.2019\n1 Sex 07:00 11:00\nPeríodo Banco Horas:{}10\n2 Sab 08:00 12:00"
B = {
    "main": (
        "Cartao Y\nPeríodo: 30.01.2019 a 02.02.2019\nDia Jornada Apontamento\n30 Qua 07:00 11:00 12:00 17:00\n31 Qui FOLGA 08:00 12:00\n01 Sex 7:05 11:00 12:00\n01 Sex 06:00 10:00\nresumo\n02 Sab 07:00 11:00",
        [("30/01/2019", "Qua", "07:00", "11:00", "12:00", "17:00"), ("31/01/2019", "Qui", "08:00", "12:00", "0", "0"), ("01/02/2019", "Sex", "7:05", "11:00", "0", "0"), ("02/02/2019", "Sab", *Z)],
    ),
    "second": (
        "16.01.2019 - 18.01.2019\n16 Q29:59 30:00 07:00\n\n18 SEX 1:00 2:00 3:00 4:00 5:00",
        [("16/01/2019", "Qua", "29:59", "07:00", "0", "0"), ("17/01/2019", "Qui", *Z), ("18/01/2019", "Sex", "1:00", "2:00", "3:00", "4:00")],
    ),
    "bad day": ("Período: 31.02.2019 a 02.03.2019\n16 Qua 07:00 11:00", []),
    "reversed": ("Período: 05.02.2019 a 01.02.2019\n1 Qua 07:00 11:00", []),
    "ends at once": ("Período: 01.02.2019 a 01.02.2019\n1 Sex 07:00 11:00 total", []),
    "phrase and space": (DAY.format(" "), [("01/02/2019", "Sex", "07:00", "11:00", "0", "0"), ("02/02/2019", "Sab", "08:00", "12:00", "0", "0")]),
    "phrase": (DAY.format(""), [("01/02/2019", "Sex", "07:00", "11:00", "0", "0"), ("02/02/2019", "Sab", *Z)]),
    "nothing": ("Período: 01.02.2019 a 01.02.2019\nnada", [("01/02/2019", "Sex", *Z)]),
    "no period": ("no period\n1 Sex 07:00 11:00", []),
    "spread": ("Período: 01.02.2019\n a 01.02.2019\n1 Área 07:00 11:00\n 1  Sex 06:00 10:00", [("01/02/2019", "Sex", "06:00", "10:00", "0", "0")]),
    "null": (None, []),
}


def made(spark, cases):
    return spark.createDataFrame([(k, 1, text) for k, (text, _) in cases.items()], CARD_PAGES)


@pytest.mark.parametrize(("layout", "cases"), [("A", A), ("B", B)])
def test_golden_pages(spark, layout, cases):
    rows = extract(made(spark, cases), layout)
    key = "line_no" if layout == "A" else "cal_date"
    got = rows.orderBy("doc_id", "page_no", key).select("doc_id", *PUNCH_COLUMNS).collect()
    for name, (_, expected) in cases.items():
        own = [tuple(v or "0" for v in r[1:]) for r in got if r[0] == name]
        assert own == expected, name


def test_period_over_two_months(spark):
    rows = layout_b(spark.createDataFrame([("d", 1, "Período: 14.01.2019 a 15.02.2019\n15 Ter 07:00 11:00")], CARD_PAGES)).collect()
    assert len(rows) == 33
    assert [(r.Dia, r.Dia_Semana) for r in rows if r.Entrada1 == "07:00"] == [("15/01/2019", "Ter"), ("15/02/2019", "Sex")]


def test_long_period_is_an_error(spark):
    page = spark.createDataFrame([("d", 1, "Período: 01.01.2000 a 01.01.9999\n1 Ter 07:00 11:00")], CARD_PAGES)
    with pytest.raises(Exception, match="more than"):
        layout_b(page).collect()


def test_no_such_layout(spark):
    with pytest.raises(ValueError, match="layout"):
        extract(made(spark, A), "C")


def test_pair_validation(spark):
    masks = [["7:00" if on else "0" for on in m] for m in itertools.product((0, 1), repeat=4)]
    df = spark.createDataFrame(masks, ["a", "b", "c", "d"])
    for before, after in zip(masks, df.select(*S.valid_pairs([F.col(c) for c in "abcd"])).collect(), strict=True):
        pairs = [p if "0" not in p else ["0", "0"] for p in (before[:2], before[2:])]
        assert list(after) == pairs[0] + pairs[1]


def test_times_strip_split(spark):
    df = spark.createDataFrame([("107:00 07:000 11:12:30 7:05 24:00 29:59 00:00 0:00",), ("_07:00",), ("12.07:00",), ("07:00-11:00",), ("07:0011:00",)], ["x"])
    got = [r[0] for r in df.select(S.times(F.col("x"))).collect()]
    assert got == [["11:12", "7:05", "24:00", "29:59", "00:00", "0:00"], [], ["07:00"], ["07:00", "11:00"], []]
    one = spark.createDataFrame([("\x0c\xa0a\xa0\x1c\x85\t", "a\nb\r\n\n\x0c")], ["s", "l"]).select(strip(F.col("s")), lines(F.col("l"))).first()
    assert one[0] == "a" and one[1] == ["a", "b\r", "", "\x0c"]


def test_appending_after_the_end_changes_nothing(spark):
    more = {k: (t + "\n11/11/2021 Qui 07:00 11:00", e) for k, (t, e) in A.items() if k in ("main", "form feed")}
    got = extract(made(spark, more), "A").groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got} == {k: len(e) for k, (_, e) in more.items()}


def test_bounds(spark):
    ls = lines(F.lit("a\nDia Marcação\n\nx"))
    assert spark.range(1).select(start_a(ls), end_a(ls, start_a(ls)), end_a(ls, F.lit(3))).first()[:] == (1, 2, 4)


def test_delimiters():
    assert len(DELIMITERS_A) == 76


def test_page_ranges(spark):
    assert P.page_range("") is None and P.page_range("3") == (3, 3) and P.page_range(" 3 - 5 ") == (3, 5)
    for bad in ("-5", "1-2-3", "x", "10-5"):
        with pytest.raises(ValueError):
            P.page_range(bad)
    df = spark.createDataFrame([("216-272", 1), ("7", 1), ("", 2)], ["p", "i"])
    assert [r[0] for r in df.select(S.page_number(F.col("p"), F.col("i"))).collect()] == [216, 1, 2]


def test_progress(spark):
    df = spark.range(1, 4).select(S.progress_step(F.col("id"), F.lit(3)).alias("s"))
    assert [tuple(r) for r in df.select("s", S.progress_percent(F.col("s"), F.lit(10))).collect()] == [(4, 40), (6, 60), (8, 80)]


def test_conform(spark):
    df = spark.createDataFrame([("", None, 3)], "Dia string, Entrada1 string, Pagina int")
    assert frames.conform(df).first()[:] == ("0",) * 6


def test_calendar_first(spark):
    cal = spark.sql("select 'd' k, explode(sequence(date'2019-01-30', date'2019-02-01')) cal_date")
    rows = spark.createDataFrame([("d", 30, 2, "b"), ("d", 30, 1, "a")], ["k", "day", "n", "v"])
    assert [r.v for r in frames.calendar_first(cal, rows, ["k"], "n", "v").orderBy("cal_date").collect()] == ["a", None, None]


def test_csv(spark, tmp_path):
    rows = extract(made(spark, {"many": A["many"]}), "A")
    sinks.write_csv(rows, f"{tmp_path}/out")
    sinks.name_single(rows, f"{tmp_path}/out", f"{tmp_path}/t.csv")
    text = (tmp_path / "t.csv").read_text(encoding="utf-8")
    assert text == "Dia;Dia_Semana;Entrada1;Saida1;Entrada2;Saida2\n04/11/2021;Qui;07:00;11:00;12:00;17:00\n04/11/2021;Qui;24:00;00:30;0;0\n"
    with pytest.raises(sinks.EmptyResult):
        sinks.write_csv(rows.where("false"), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    assert sinks.display_name(datetime(2024, 1, 2, 3, 4, 5), "X") == "X_ponto_extraido_20240102_030405.csv"


def test_synthetic_and_workbook(spark, tmp_path):
    rows = synthetic_rows(spark, "1-9")
    assert rows.count() == 25 and synthetic_rows(spark, "").count() == 5
    assert rows.where("not Marcacao_Ponto rlike '^[5-7]:5[0-9] 11:30 12:30 1[7-9]:5[0-9]$'").count() == 0
    assert [r[0] for r in frames.distinct_pages(rows).collect()] == [1, 2, 3, 4, 5]
    seen = spark.createDataFrame([(3, 1), (1, 2), (3, 3), (2, 4)], "Pagina int, at int")
    assert [r[0] for r in frames.distinct_pages(seen, order="at").collect()] == [3, 1, 2]
    book = io.BytesIO()
    assert sinks.workbook(rows, book) == 5
    with zipfile.ZipFile(book) as z:
        assert sum(n.startswith("xl/worksheets") for n in z.namelist()) == 5
        assert "Pagina" not in z.read("xl/worksheets/sheet1.xml").decode()
    sinks.write_by_page(rows, f"{tmp_path}/pages")
    assert len(list((tmp_path / "pages").glob("Pagina=*"))) == 5
    with pytest.raises(Exception, match="more than 3 rows"):
        sinks.workbook(rows, io.BytesIO(), most_rows=3)


def test_pdf_adapter(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|three")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def count(content):
        if content == b"bad":
            raise OSError("unreadable")
        return len(content.split(b"|"))

    def image(content, page):
        return content.split(b"|")[page - 1]

    def text(image, binary=""):
        if image == b"two":
            raise RuntimeError("no text")
        return image.decode() + (binary or "")

    read = lambda pages, **more: [(r.page_no, r.text) for r in P.pdf_pages(spark, str(tmp_path), pages, count, image, text, **more).orderBy("page_no").collect()]
    assert read("") == [(1, "one"), (2, ""), (3, "three")]
    assert read("2-9") == [(2, ""), (3, "three")] and read("3-3") == [(3, "three")]
    assert read("3") == [(1, "three")]  # a single page is numbered 1
    assert read("4-5") == [] and read("1-1", binary="!") == [(1, "one!")]
    for path, pages in (("", ""), (None, ""), (str(tmp_path), "x")):
        with pytest.raises(ValueError):
            P.pdf_pages(spark, path, pages)


def test_long_page_numbers_are_no_range(spark):
    assert spark.range(1).select(*S.page_bounds(F.lit("99999999999"))).first()[:] == (None, None)


def test_stream(spark, tmp_path):
    made(spark, A).write.parquet(f"{tmp_path}/in")
    extract_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log", "A").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == sum(len(e) for _, e in A.values())


def test_task_records(spark, tmp_path):
    good = tasks.run(made(spark, A), "A", str(tmp_path), "t1")
    assert (good["status"], good["progress"], good["file_path"]) == ("completed", 100, f"{tmp_path}/t1.csv")
    assert len((tmp_path / "t1.csv").read_text(encoding="utf-8").splitlines()) == 1 + sum(len(e) for _, e in A.values())
    empty = tasks.run(made(spark, {"null": (None, [])}), "B", str(tmp_path))
    assert (empty["status"], empty["progress"], empty["error"]) == ("error", 100, tasks.NO_TABLE)
    bad = tasks.run(made(spark, A), "C", str(tmp_path))
    assert (bad["status"], bad["progress"]) == ("error", 0) and "layout" in bad["error"]


def test_tasks_are_looked_up(spark, tmp_path):
    runs = tasks.Tasks()
    begun = runs.submit(made(spark, A), "A", str(tmp_path))
    assert begun["status"] == "processing" and runs.poll(begun["task_id"])["status"] in ("processing", "completed")
    done = runs.wait(begun["task_id"], 120)
    assert (done["status"], done["progress"], done["file_path"]) == ("completed", 100, f"{tmp_path}/{begun['task_id']}.csv")
    with pytest.raises(KeyError):
        runs.poll("unknown")


def test_user_table(spark):
    P.create_users(spark, "batida_users")
    P.create_users(spark, "batida_users")
    try:
        assert frames.lookup(spark.table("batida_users"), F.col("username") == "x").count() == 0
    finally:
        spark.sql("DROP TABLE batida_users")
