"""Registered queries over the driver's tables, each with its SQL twin.

The twins are DuckDB SQL. Time cards are made from `events` in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batida.functions import scalars as S
from batida.functions.text import lines, strip
from batida.model import DELIMITERS_A, END_PHRASES_B, END_WORDS_A, PUNCH_COLUMNS, SPECIAL_A, SPECIAL_B, WEEKDAYS, WEEKDAYS_FROM_SUNDAY
from batida.operators import frames
from batida.operators.bounds import end_a, end_b, start_a, start_b
from batida.operators.layouts import layout_a, layout_b
from batida.operators.order import first_seen
from batida.plans import tasks
from batida.plans.tasklog import STATES, TaskLog
from batida.sources import pages as sources
from batida.sources import sinks
from batida.sources.database import scan_database, write_database
from batida.sources.paged import scan_pages, write_pages
from batida.sources.synthetic import cards_a, cards_b, day_lines, synthetic_for
from batida.sources.workbook import read_workbook, write_workbook
from batida.storage import is_local, new_path
from batida.streaming.cards import read_pages
from batida.streaming.progress import read_batches, write_batches

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers the function by its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- shared SQL -----------------------------------------------------------

SUNDAY_FIRST = listed(WEEKDAYS_FROM_SUNDAY)
DAYS_SQL = """days AS (
    SELECT user_id, CAST(ts AS DATE) AS day, list(strftime(ts, '%H:%M') ORDER BY ts) AS times, list(event_type) AS kinds
    FROM events GROUP BY ALL)"""
CARDS_A_SQL = f"""{DAYS_SQL},
card_lines AS (SELECT user_id, day, strftime(day, '%d/%m/%Y') || ' ' || {SUNDAY_FIRST}[dayofweek(day) + 1]
    || CASE WHEN list_contains(kinds, 'error') THEN ' FOLGA' ELSE '' END || ' '
    || CASE WHEN NOT list_contains(kinds, 'signup') THEN array_to_string(times, ' ')
       ELSE concat_ws(' ', array_to_string(times[:-2], ' '), 'SALDO', times[-1]) END AS line FROM days),
cards AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, 1 AS page_no, 'Empresa X - Cartao' || chr(10) || 'Dia Marcação Faltas' || chr(10)
    || string_agg(line, chr(10) ORDER BY day) || chr(10) || 'total 100:00' || chr(10) || '10/11/2021 Qua 07:00 11:00' AS text FROM card_lines GROUP BY user_id)"""
CARDS_B_SQL = f"""{DAYS_SQL},
card_lines AS (SELECT user_id, day, strftime(day, '%d') || ' ' || {SUNDAY_FIRST}[dayofweek(day) + 1] || ' ' || array_to_string(times, ' ') AS line FROM days),
cards AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, 1 AS page_no, 'Cartao Y' || chr(10) || 'Período: ' || strftime(min(day), '%d.%m.%Y') || ' a ' || strftime(max(day), '%d.%m.%Y')
    || chr(10) || 'Dia Jornada Apontamento' || chr(10) || string_agg(line, chr(10) ORDER BY day) || chr(10) || 'resumo' || chr(10) || '02 Sab 07:00 11:00' AS text FROM card_lines GROUP BY user_id)"""
LINES_SQL = """ls AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cards)"""
STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
TIME_SQL = "\\b([0-2]?[0-9]:[0-5][0-9])\\b"
BOUNDS_A_SQL = f"""begun AS (SELECT doc_id, page_no, count(*) AS n, coalesce(min(i) FILTER (regexp_matches(line, '\\b(Dia|Data)\\b') AND regexp_matches(line, '\\b(Marcação|Situação)\\b')), 0) AS b FROM ls GROUP BY ALL),
bounds AS (SELECT ls.doc_id, ls.page_no, any_value(b) AS b, coalesce(min(i) FILTER (i >= b AND ({STRIPPED} = '' OR regexp_matches(line, '\\b({"|".join(END_WORDS_A)})\\b', 'i'))), any_value(n)) AS e
    FROM ls JOIN begun USING (doc_id, page_no) GROUP BY ALL)"""
BOUNDS_B_SQL = f"""begun AS (SELECT doc_id, page_no, count(*) AS n, coalesce(min(i) FILTER (regexp_matches(line, '^\\s*[0-9]{{1,2}}\\s+[A-Z]') AND (regexp_matches(line, '{TIME_SQL}') OR regexp_matches(line, '{"|".join(SPECIAL_B)}', 'i'))), 0) AS b FROM ls GROUP BY ALL),
bounds AS (SELECT ls.doc_id, ls.page_no, any_value(b) AS b, coalesce(min(i) FILTER (i >= b AND regexp_matches(line, '\\b({"|".join(p.replace(".", "[.]") for p in END_PHRASES_B)})\\b', 'i')), any_value(n)) AS e
    FROM ls JOIN begun USING (doc_id, page_no) GROUP BY ALL)"""


def weekday_sql(x: str) -> str:
    return f"coalesce(list_filter({listed(WEEKDAYS)}, lambda w: contains({x}, w))[1], CASE WHEN regexp_matches({x}, 'Sáb|SAB|sab|Sabado|sábado') THEN 'Sab' ELSE '' END)"


def cut_sql(x: str) -> str:
    up = f"replace(replace(upper({x}), 'ẞ', 'SS'), 'ß', 'SS')"  # as Java upper-cases it
    return f"coalesce(substr({x}, 1, strpos({up}, list_filter({listed(DELIMITERS_A)}, lambda k: contains({up}, k) AND strpos({up}, k) <= length({x}))[1]) - 1), {x})"


def pairs_sql(a: str) -> str:
    """Four slot columns of the list a."""
    pair = lambda i, j, k: f"CASE WHEN {a}[{i}] IS NOT NULL AND {a}[{j}] IS NOT NULL THEN {a}[{k}] ELSE '0' END"
    return f"{pair(1, 2, 1)} AS Entrada1, {pair(1, 2, 2)} AS Saida1, {pair(3, 4, 3)} AS Entrada2, {pair(3, 4, 4)} AS Saida2"


NORMAL_SQL = "list_transform(list_filter(found[:4], lambda t: CAST(string_split(t, ':')[1] AS INT) <= 23), lambda t: CASE WHEN lpad(t, 5, '0') = '00:00' THEN '24:00' ELSE lpad(t, 5, '0') END)"
SPECIAL_SQL = " OR ".join(f"contains(upper(line), '{w}')" for w in SPECIAL_A)
LINE_A_SQL = f"""dated AS (SELECT doc_id, page_no, i AS line_no, {STRIPPED} AS line FROM ls JOIN bounds USING (doc_id, page_no) WHERE i >= b AND i < e AND regexp_matches(line, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')),
tagged AS (SELECT *, regexp_extract(line, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AS Dia, {weekday_sql("line")} AS Dia_Semana FROM dated),
tails AS (SELECT *, substr(line, CASE WHEN Dia_Semana <> '' AND strpos(line, Dia_Semana) > strpos(line, Dia) THEN strpos(line, Dia_Semana) + length(Dia_Semana) ELSE strpos(line, Dia) + length(Dia) END) AS tail FROM tagged),
timed AS (SELECT *, regexp_extract_all({cut_sql("tail")}, '{TIME_SQL}', 1) AS found FROM tails)"""


# --- extraction ------------------------------------------------------------


@query(f"""WITH {CARDS_A_SQL}, {LINES_SQL}, {BOUNDS_A_SQL}, {LINE_A_SQL},
slots AS (SELECT *, CASE WHEN {SPECIAL_SQL} THEN [] ELSE {NORMAL_SQL} END AS four FROM timed)
SELECT doc_id, page_no, CAST(line_no AS INT) AS line_no, Dia, Dia_Semana, {pairs_sql("four")} FROM slots""")
def layout_a_extract(spark, sf_dir):
    """B1, B2, F1-F15, P7."""
    return layout_a(cards_a(table(spark, sf_dir, "events")))


@query(f"""WITH {CARDS_B_SQL}, {LINES_SQL}, {BOUNDS_B_SQL},
periods AS (SELECT doc_id, page_no, strptime(regexp_extract(text, 'Período: ([0-9.]+) a ([0-9.]+)', 1), '%d.%m.%Y') AS d0, strptime(regexp_extract(text, 'Período: ([0-9.]+) a ([0-9.]+)', 2), '%d.%m.%Y') AS d1 FROM cards),
calendar AS (SELECT doc_id, page_no, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS cal_date FROM periods),
table_lines AS (SELECT doc_id, page_no, i, line, CAST(regexp_extract(line, '^\\s*([0-9]{{1,2}})\\s+[A-Z]', 1) AS INT) AS n FROM ls JOIN bounds USING (doc_id, page_no) WHERE i >= b AND i < e AND regexp_matches(line, '^\\s*[0-9]{{1,2}}\\s+[A-Z]')),
firsts AS (SELECT doc_id, page_no, n, arg_min(line, i) AS line FROM table_lines GROUP BY ALL),
hit AS (SELECT c.doc_id, c.page_no, c.cal_date, regexp_extract_all(regexp_replace(coalesce(line, ''), '^\\s*[0-9]{{1,2}}\\s+[A-Z]', ''), '{TIME_SQL}', 1) AS four FROM calendar c LEFT JOIN firsts f ON f.doc_id = c.doc_id AND f.page_no = c.page_no AND f.n = day(c.cal_date))
SELECT doc_id, page_no, cal_date, strftime(cal_date, '%d/%m/%Y') AS Dia, {SUNDAY_FIRST}[dayofweek(cal_date) + 1] AS Dia_Semana, {pairs_sql("four")} FROM hit""")
def layout_b_extract(spark, sf_dir):
    """F16-F23, B4, B5, J1 in its narrow form."""
    return layout_b(cards_b(table(spark, sf_dir, "events")))


@query(f"WITH {CARDS_A_SQL}, {LINES_SQL}, {BOUNDS_A_SQL} SELECT doc_id, page_no, CAST(b AS INT) AS begin_line, CAST(e AS INT) AS end_line FROM bounds")
def bounds_a(spark, sf_dir):
    """B1, B2."""
    ls = cards_a(table(spark, sf_dir, "events")).select("doc_id", "page_no", lines(F.col("text")).alias("ls"))
    begun = ls.select("*", start_a(F.col("ls")).alias("begin_line"))
    return begun.select("doc_id", "page_no", "begin_line", end_a(F.col("ls"), F.col("begin_line")).alias("end_line"))


@query(f"WITH {CARDS_B_SQL}, {LINES_SQL}, {BOUNDS_B_SQL} SELECT doc_id, page_no, CAST(b AS INT) AS begin_line, CAST(e AS INT) AS end_line FROM bounds")
def bounds_b(spark, sf_dir):
    """B4, B5."""
    ls = cards_b(table(spark, sf_dir, "events")).select("doc_id", "page_no", lines(F.col("text")).alias("ls"))
    begun = ls.select("*", start_b(F.col("ls")).alias("begin_line"))
    return begun.select("doc_id", "page_no", "begin_line", end_b(F.col("ls"), F.col("begin_line")).alias("end_line"))


# --- lines and scalars -------------------------------------------------------


@query("""WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i AS INT) AS line_no, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM ls WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''""")
def split_lines(spark, sf_dir):
    """P1-P4."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "raw"))
    return each.select("doc_id", "line_no", strip(F.col("raw")).alias("line")).where("line <> ''")


@query("""SELECT o_orderkey, regexp_extract('Pedido 1' || strftime(o_orderdate, '%d/%m/%Y') || '7 ' || o_orderpriority, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') AS Dia FROM orders""")
def date_extract(spark, sf_dir):
    """digits around the date are not part of it."""
    text = F.concat(F.lit("Pedido 1"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("7 "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.date_text(text).alias("Dia"))


TAG_SQL = f"{SUNDAY_FIRST}[dayofweek(CAST(ts AS DATE)) + 1] || ' ' || CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Sáb' WHEN 1 THEN 'SAB' WHEN 2 THEN 'Seg' ELSE event_type END"


def tag_text():
    odd = F.when(F.col("event_id") % 5 == 0, "Sáb").when(F.col("event_id") % 5 == 1, "SAB").when(F.col("event_id") % 5 == 2, "Seg").otherwise(F.col("event_type"))
    return F.concat(S.weekday_name(F.to_date("ts")), F.lit(" "), odd)


@query(f"""WITH t AS (SELECT event_id, {TAG_SQL} AS whole, substr({TAG_SQL}, 5) AS tail FROM events)
SELECT event_id, {weekday_sql("whole")} AS of_line, {weekday_sql("tail")} AS of_tail FROM t""")
def weekday_tag(spark, sf_dir):
    """list order beats position; spellings of Saturday as a fallback."""
    t = table(spark, sf_dir, "events").select("event_id", tag_text().alias("whole"))
    return t.select("event_id", S.weekday_tag(F.col("whole")).alias("of_line"), S.weekday_tag(F.expr("substr(whole, 5)")).alias("of_tail"))


@query(f"""WITH t AS (SELECT doc_id AS id, text AS line FROM documents
UNION ALL SELECT -1 - event_id, event_type || ' 07:00 ' || CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'tot 1:00 sp' WHEN 1 THEN 'H.E.50% 00:30' WHEN 2 THEN 'ad.not 1' ELSE '' END FROM events)
SELECT id, {cut_sql("line")} AS head FROM t""")
def delimiter_cut(spark, sf_dir):
    """F6, over whole documents and event lines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("line"))
    k = F.col("event_id") % 4
    more = F.when(k == 0, "tot 1:00 sp").when(k == 1, "H.E.50% 00:30").when(k == 2, "ad.not 1").otherwise("")
    lines_ = table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("id"), F.concat("event_type", F.lit(" 07:00 "), more).alias("line"))
    return docs.unionByName(lines_).select("id", S.before_delimiter(F.col("line")).alias("head"))


TIMES_SQL = "strftime(ts, '%H:%M') || ' 2' || CAST(event_id % 10 AS VARCHAR) || ':15 ' || CAST(event_id % 30 AS VARCHAR) || ':00 07:0011:00'"


def times_text():
    return F.concat(F.date_format("ts", "HH:mm"), F.lit(" 2"), (F.col("event_id") % 10).cast("string"), F.lit(":15 "), (F.col("event_id") % 30).cast("string"), F.lit(":00 07:0011:00"))


@query(f"SELECT event_id, array_to_string(regexp_extract_all({TIMES_SQL}, '{TIME_SQL}', 1), ',') AS times FROM events")
def time_extract(spark, sf_dir):
    """F7."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(S.times(times_text()), ",").alias("times"))


@query(f"WITH t AS (SELECT event_id, regexp_extract_all({TIMES_SQL}, '{TIME_SQL}', 1) AS found FROM events) SELECT event_id, array_to_string({NORMAL_SQL}, ',') AS times FROM t")
def time_normalize(spark, sf_dir):
    """F8-F12."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(S.normal_times(S.times(times_text())), ",").alias("times"))


@query(f"WITH t AS (SELECT doc_id AS id, text AS line FROM documents UNION ALL SELECT -1 - event_id, event_type || ' ' || {listed(SPECIAL_A)}[event_id % 10 + 1] FROM events) SELECT id, ({SPECIAL_SQL}) AS special FROM t")
def special_flag(spark, sf_dir):
    """F13, over whole documents and event lines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("line"))
    word = F.get(F.array(*map(F.lit, SPECIAL_A)), (F.col("event_id") % 10).cast("int"))
    lines_ = table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("id"), F.concat("event_type", F.lit(" "), word).alias("line"))
    return docs.unionByName(lines_).select("id", S.is_special(F.col("line")).alias("special"))


@query(f"WITH {DAYS_SQL}, t AS (SELECT user_id, day, times[:4] AS four FROM days) SELECT user_id, day, {pairs_sql('four')} FROM t")
def pair_validate(spark, sf_dir):
    """F14, F15."""
    four = S.valid_pairs(S.slots(F.slice("times", 1, 4)))
    return day_lines(table(spark, sf_dir, "events")).select("user_id", "day", *[c.alias(n) for c, n in zip(four, PUNCH_COLUMNS[2:], strict=True)])


PERIOD_SQL = """CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Período: ' || strftime(o_orderdate, '%d.%m.%Y') || ' a ' || strftime(o_orderdate + INTERVAL 20 DAY, '%d.%m.%Y')
    WHEN 1 THEN 'x ' || strftime(o_orderdate, '%-d.%-m.%Y') || '-' || strftime(o_orderdate + INTERVAL 40 DAY, '%d.%m.%Y')
    WHEN 2 THEN 'Período: 31.02.2019 a 01.03.2019 ' || strftime(o_orderdate, '%d.%m.%Y') || ' - ' || strftime(o_orderdate, '%d.%m.%Y') ELSE 'none' END"""
PERIODS_SQL = f"""t AS (SELECT o_orderkey, {PERIOD_SQL} AS text FROM orders),
p AS (SELECT o_orderkey, CASE WHEN contains(text, 'Período:') THEN regexp_extract(text, 'Período:\\s*([0-9.]+)\\s*a', 1) ELSE regexp_extract(text, '([0-9.]+)\\s*-', 1) END AS a,
    CASE WHEN contains(text, 'Período:') THEN regexp_extract(text, 'a ([0-9.]+)', 1) ELSE regexp_extract(text, '-\\s*([0-9.]+)', 1) END AS b FROM t),
periods AS (SELECT o_orderkey, CAST(try_strptime(nullif(a, ''), '%d.%m.%Y') AS DATE) AS d0, CAST(try_strptime(nullif(b, ''), '%d.%m.%Y') AS DATE) AS d1 FROM p)"""


def period_text():
    k, day = F.col("o_orderkey") % 4, lambda n, f="dd.MM.yyyy": F.date_format(F.date_add(F.to_date("o_orderdate"), n), f)
    return (
        F.when(k == 0, F.concat(F.lit("Período: "), day(0), F.lit(" a "), day(20)))
        .when(k == 1, F.concat(F.lit("x "), day(0, "d.M.yyyy"), F.lit("-"), day(40)))
        .when(k == 2, F.concat(F.lit("Período: 31.02.2019 a 01.03.2019 "), day(0), F.lit(" - "), day(0)))
        .otherwise("none")
    )


@query(f"WITH {PERIODS_SQL} SELECT o_orderkey, d0, d1 FROM periods")
def period_parse(spark, sf_dir):
    """An impossible day gives no period, without a fallback."""
    a, b = S.period(F.col("text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", period_text().alias("text")).select("o_orderkey", a.alias("d0"), b.alias("d1"))


@query("""WITH span AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS d0, max(o_orderdate) AS d1 FROM orders GROUP BY o_custkey),
calendar AS (SELECT o_custkey, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS cal_date FROM span),
firsts AS (SELECT o_custkey, CAST(day(o_orderdate) AS INT) AS day, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY ALL)
SELECT c.o_custkey, cal_date, o_orderpriority FROM calendar c LEFT JOIN firsts f ON f.o_custkey = c.o_custkey AND f.day = day(cal_date)""")
def calendar_fill(spark, sf_dir):
    """DM9, J1 in its relational form: each day of a customer's period takes the first order of that day of month."""
    orders = table(spark, sf_dir, "orders")
    span = orders.groupBy("o_custkey").agg(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("d0"), F.max("o_orderdate").cast("date").alias("d1"))
    rows = orders.withColumn("day", F.day("o_orderdate"))
    return frames.calendar_first(span, rows, ["o_custkey"], "o_orderkey", "o_orderpriority").select("o_custkey", "cal_date", "o_orderpriority")


RANGE_SQL = "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN page_id || '-' || (page_id + 9) WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN '' ELSE 'x' END"


def range_text():
    k, at = F.col("page_id") % 4, F.col("page_id")
    return F.when(k == 0, F.concat(at.cast("string"), F.lit("-"), (at + 9).cast("string"))).when(k == 1, at.cast("string")).when(k == 2, "").otherwise("x")


@query(f"SELECT page_id, coalesce(try_cast(regexp_extract({RANGE_SQL}, '^([0-9]+)', 1) AS INT), -1) AS first_page, coalesce(try_cast(regexp_extract({RANGE_SQL}, '([0-9]+)$', 1) AS INT), -1) AS last_page FROM pages")
def page_range_parse(spark, sf_dir):
    """S4; -1 where all pages are meant or the text is no range."""
    a, b = (F.coalesce(c, F.lit(-1)) for c in S.page_bounds(F.col("r")))
    return table(spark, sf_dir, "pages").select("page_id", range_text().alias("r")).select("page_id", a.alias("first_page"), b.alias("last_page"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id + 2 ELSE 3 END AS page_no FROM pages")
def page_number(spark, sf_dir):
    """F24, of the third page read."""
    return table(spark, sf_dir, "pages").select("page_id", S.page_number(range_text(), F.lit(3)).cast("long").alias("page_no"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
s AS (SELECT l_orderkey, i, CAST(3 + floor(CAST(i AS DOUBLE) / total * 5) AS INT) AS step FROM n) SELECT l_orderkey, CAST(i AS INT) AS i, step, CAST(floor(CAST(step AS DOUBLE) / 10 * 100) AS INT) AS percent FROM s""")
def progress_math(spark, sf_dir):
    """F25, F26."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("l_orderkey")
    i = F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", i.alias("i"), F.count(F.lit(1)).over(by).alias("total"))
    step = n.select("l_orderkey", "i", S.progress_step(F.col("i"), F.col("total")).alias("step"))
    return step.select("l_orderkey", "i", "step", S.progress_percent(F.col("step"), F.lit(10)).alias("percent"))


# --- frames ------------------------------------------------------------------


FRAMES_SQL = """frames AS (SELECT 0 AS f, * FROM conversations WHERE turn % 2 = 1 UNION ALL SELECT 1 AS f, * FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT 2 AS f, * FROM conversations WHERE turn = 0),
numbered AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY f, conv_id, turn, role, text) - 1 AS row_index FROM frames)"""


def page_frames(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return frames.concat([turns.where("turn % 2 = 1"), turns.where("turn % 2 = 0"), turns.where("turn = 0")], ["conv_id", "turn", "role", "text"])


@query(f"WITH {FRAMES_SQL} SELECT * FROM numbered")
def page_concat(spark, sf_dir):
    """Nothing is dropped, and rows are numbered anew over all frames."""
    return page_frames(spark, sf_dir)


@query("""SELECT c_name AS Dia, CASE WHEN c_nationkey % 3 = 0 THEN '0' ELSE c_mktsegment END AS Dia_Semana, CASE WHEN c_nationkey % 4 = 0 THEN '0' ELSE CAST(c_nationkey AS VARCHAR) END AS Entrada1, '0' AS Saida1, '0' AS Entrada2, '0' AS Saida2 FROM customer""")
def conform_schema(spark, sf_dir):
    """Empty, null and missing cells, and columns to drop."""
    c = table(spark, sf_dir, "customer")
    empty = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    null = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey").cast("string"))
    return frames.conform(c.select(F.col("c_name").alias("Dia"), empty.alias("Dia_Semana"), null.alias("Entrada1"), F.col("c_acctbal").alias("Pagina")))


@query("SELECT conv_id, role, text FROM conversations WHERE turn = 1")
def page_split(spark, sf_dir):
    """The rows of one page, without the page column."""
    return frames.page_frame(table(spark, sf_dir, "conversations"), 1, "turn")


@query("SELECT DISTINCT turn FROM conversations")
def distinct_pages(spark, sf_dir):
    """G1."""
    return frames.distinct_pages(table(spark, sf_dir, "conversations"), "turn")


@query(f"""WITH {FRAMES_SQL}, firsts AS (SELECT turn, min(row_index) AS first FROM numbered GROUP BY turn)
SELECT turn, row_number() OVER (ORDER BY first) - 1 AS rank FROM firsts""")
def pages_first_seen(spark, sf_dir):
    """G1: pages in the order they are first seen in concatenated frames, which have no column to order by."""
    return first_seen(page_frames(spark, sf_dir), "turn", "row_index")


PUNCHES_SQL = f"""WITH {CARDS_A_SQL}, {LINES_SQL}, {BOUNDS_A_SQL}, {LINE_A_SQL},
slots AS (SELECT *, CASE WHEN {SPECIAL_SQL} THEN [] ELSE {NORMAL_SQL} END AS four FROM timed),
punches AS (SELECT doc_id, page_no, line_no, Dia, CASE WHEN Dia_Semana = '' THEN '0' ELSE Dia_Semana END AS Dia_Semana, {pairs_sql("four")} FROM slots)"""


COLUMNS_SQL = ", ".join(PUNCH_COLUMNS)


@query(f"{PUNCHES_SQL} SELECT {COLUMNS_SQL}, row_number() OVER (ORDER BY doc_id, page_no, line_no) - 1 AS row_index FROM punches")
def csv_roundtrip(spark, sf_dir):
    """K1: layout A's records, written as ordered parts, then read back as text; the index is where a row stands in the files."""
    path = new_path(spark, "csv")
    sinks.write_csv(layout_a(cards_a(table(spark, sf_dir, "events"))), path)
    return sinks.read_csv(spark, path, index="row_index")


@query(f"{PUNCHES_SQL} SELECT {COLUMNS_SQL}, true AS named_by_task, 'completed' AS status, 100 AS progress, 10 AS current_step, 10 AS total_steps FROM punches")
def task_file(spark, sf_dir):
    """The one file of a run, which bears its id, beside the run's record."""
    record = tasks.run(cards_a(table(spark, sf_dir, "events")), "A", new_path(spark, "tasks"))
    if record["status"] != "completed":
        raise RuntimeError(record.get("error"))
    rows = spark.read.option("sep", ";").option("header", True).csv(record["file_path"])
    named = F.lit(record["file_path"].endswith(f"/{record['task_id']}.csv"))
    return rows.select(*PUNCH_COLUMNS, named.alias("named_by_task"), *[F.lit(record[c]).alias(c) for c in ("status", "progress", "current_step", "total_steps")])


@query(f"""{PUNCHES_SQL} SELECT (SELECT count(*) FROM cards) AS n_pages, count(*) AS n_rows,
    CAST(sum(CAST(Entrada1 <> '0' AS INT) + CAST(Saida1 <> '0' AS INT) + CAST(Entrada2 <> '0' AS INT) + CAST(Saida2 <> '0' AS INT)) AS BIGINT) AS n_times FROM punches""")
def run_counts(spark, sf_dir):
    """Pages, rows and filled slots of a run, counted by the pass that extracts."""
    record = tasks.run(cards_a(table(spark, sf_dir, "events")), "A", new_path(spark, "tasks"))
    return spark.createDataFrame([(record["n_pages"], record["n_rows"], record["n_times"])], "n_pages long, n_rows long, n_times long")


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type FROM events),
l AS (SELECT task_id, max(seq) AS seq, arg_max(event_type, seq) AS event_type FROM s GROUP BY task_id)
SELECT task_id, seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status, CAST(least(seq, 10) AS INT) AS current_step, 10 AS total_steps,
    CAST(least(seq, 10) * 10 AS INT) AS progress, event_type AS message FROM l""")
def task_states(spark, sf_dir):
    """Every event is a state of its user's task, appended to a log in two turns; the last state of each task."""
    from pyspark.sql.window import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    step = F.least("seq", F.lit(10))
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    named = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), seq.alias("seq"), F.col("ts").alias("at"), "event_type")
    states = named.select("task_id", "seq", "at", status.alias("status"), step.alias("current_step"), F.lit(10).alias("total_steps"), (step * 10).alias("progress"), F.col("event_type").alias("message"))
    log = TaskLog(spark, new_path(spark, "log"))
    log.add(states.where("seq % 2 = 1"))
    log.add(states.where("seq % 2 = 0"))
    return log.latest().select(*[f.name for f in STATES if f.name != "at"])


@query(f"""{PUNCHES_SQL} SELECT doc_id, page_no, CAST(line_no AS INT) AS line_no, {COLUMNS_SQL} FROM punches""")
def stream_extract(spark, sf_dir):
    """C2 as a stream: pages come as files, each batch is written once under its id, also when the stream is started again."""
    source, target, log = new_path(spark, "stream"), new_path(spark, "batches"), new_path(spark, "offsets")
    cards_a(table(spark, sf_dir, "events")).repartition(4, "doc_id").write.parquet(source)
    for _ in range(2):
        conformed = lambda batch: frames.conform(layout_a(batch), keep=["doc_id", "page_no", "line_no"])
        write_batches(read_pages(spark, source, files_per_trigger=1), target, log, each=conformed).awaitTermination()
    return read_batches(spark, target).drop("batch")


@query("SELECT event_id, 'cartao_ponto_extraido_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' AS name FROM events")
def display_names(spark, sf_dir):
    """F27, K3."""
    return table(spark, sf_dir, "events").select("event_id", S.display_name(F.col("ts")).alias("name"))


@query("SELECT conv_id, CAST(CASE WHEN conv_id % 10 = 0 THEN turn ELSE 0 END AS INT) AS turn, role FROM conversations")
def pages_by_folder(spark, sf_dir):
    """Files per page, read back; nine tenths of the rows are of one page, which several tasks write."""
    path = new_path(spark, "pages")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 10 == 0, F.col("turn")).otherwise(0).alias("turn"), "role")
    sinks.write_by_page(rows, path, "turn", most_rows=100)
    return spark.read.option("sep", ";").option("header", True).schema("conv_id long, role string, turn int").csv(path).select("conv_id", "turn", "role")


@query("""SELECT CAST(turn AS VARCHAR) AS page, row_number() OVER (PARTITION BY turn ORDER BY conv_id, role, text) AS row_no, CAST(conv_id AS VARCHAR) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations""")
def workbook_sheets(spark, sf_dir):
    """K6: a workbook with a sheet for each turn, written by tasks, read back sheet by sheet."""
    path = new_path(spark, "workbook")
    write_workbook(table(spark, sf_dir, "conversations").select("turn", "conv_id", "role", "text"), path, "turn", order=["conv_id", "role", "text"])
    cells = lambda k: F.col("cells")[k]
    return read_workbook(spark, path).select("page", "row_no", cells(0).alias("conv_id"), cells(1).alias("role"), cells(2).alias("text"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(p AS INT) AS page_no, substr(text, (p - 1) * 500 + 1, 500) AS text FROM documents, range(2, 10) r(p) WHERE length(text) > (p - 1) * 500""")
def page_range_scan(spark, sf_dir):
    """Every document's text in pages of 500 characters, in runs of four pages; a scan of pages 2 to 9 opens the first three runs alone."""
    path = new_path(spark, "runs")
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    paged = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 500))).alias("page_no"))
    write_pages(paged.select("doc_id", "page_no", F.substring("text", (F.col("page_no") - 1) * 500 + 1, F.lit(500)).alias("text")), path, run=4)
    return scan_pages(spark, path).where("page_no BETWEEN 2 AND 9")


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def customers_in_database(spark, sf_dir, parts: int | None = None):
    """customer in a relational table, and a scan of it by ranges of the key.

    In one process the table is in the embedded database that Spark comes with,
    read over JDBC. Other processes can't open that one, so on a cluster it is
    in database files of the shared folder, written and queried by tasks.
    """
    customers = table(spark, sf_dir, "customer")
    if not is_local(spark):
        path = new_path(spark, "db")
        write_database(customers, path, "c_custkey", parts)
        return scan_database(spark, path)
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:{new_path(spark, 'db').rpartition('/')[2]};create=true"
    sources.write_jdbc(customers, url, "customer", "c_name VARCHAR(64), c_mktsegment VARCHAR(32)", **DERBY)
    return sources.jdbc_table(spark, url, "customer", key="c_custkey", parts=parts or 4, **DERBY)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def jdbc_scan(spark, sf_dir):
    """A table of a database, read in parallel; filter and columns reach the database."""
    found = customers_in_database(spark, sf_dir).where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return found.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("SELECT page_id, CAST(CASE WHEN page_id % 4 = 0 THEN 5 ELSE 1 END AS INT) AS pages_made FROM pages")
def page_clamp(spark, sf_dir):
    """F28."""
    return table(spark, sf_dir, "pages").select("page_id", S.page_count(range_text(), 5).alias("pages_made"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_name = 'Customer#000000007' LIMIT 1")
def point_lookup(spark, sf_dir):
    """The filter reaches the scan."""
    return frames.lookup(table(spark, sf_dir, "customer"), F.col("c_name") == "Customer#000000007").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n_days, CAST(sum(len(list_filter(times[:4], lambda t: t <> '0'))) AS BIGINT) AS n_times FROM (WITH " + DAYS_SQL + " SELECT * FROM days) GROUP BY user_id")
def counts(spark, sf_dir):
    """Rows and filled slots per user."""
    filled = F.size(F.filter(F.slice("times", 1, 4), lambda t: t != "0"))
    return day_lines(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"), F.sum(filled).cast("long").alias("n_times"))


DRAW_SQL = "CAST(('0x' || substr(md5(page_id || '{k}' || id), 1, 7)) AS BIGINT) % {n} + {low}"


def draw_sql(k: str, low: int, high: int) -> str:
    return DRAW_SQL.format(k=k, n=high - low + 1, low=low)


@query(f"""SELECT page_id, '0' || (id % 5 + 1) || '/11/2021' AS Dia,
    ({draw_sql("a", 5, 7)}) || ':' || ({draw_sql("b", 50, 59)}) || ' 11:30 12:30 ' || ({draw_sql("c", 17, 19)}) || ':' || ({draw_sql("d", 50, 59)}) AS Marcacao_Ponto,
    CASE WHEN {draw_sql("e", 0, 999)} > 800 THEN 'Folga' ELSE '' END AS Faltas, '' AS AD_NOT, '' AS H_E_100,
    CASE WHEN {draw_sql("f", 0, 999)} > 700 THEN '00:' || ({draw_sql("g", 20, 59)}) ELSE '' END AS H_E_50, '' AS H_NEG, '' AS COMP_DIA,
    ({draw_sql("h", 7, 9)}) || ':' || ({draw_sql("i", 10, 50)}) AS SALDO, CAST(id // 5 + 1 AS INT) AS Pagina FROM pages, range(25) t(id) WHERE page_id % 4 = 0 OR id < 5""")
def synthetic_cards(spark, sf_dir):
    """Test rows for every request that the table of pages gives, with its page range."""
    requests = table(spark, sf_dir, "pages").select("page_id", range_text().alias("asked"))
    return synthetic_for(requests, "page_id", "asked").drop("asked")
