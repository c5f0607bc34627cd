"""Repair of damaged conversations by the cheapest edits, as one fold in Spark SQL.

Fault flags come from windows over a conversation's turns. Turns are then
collected in order, and ``aggregate`` folds over them with four structs
(cost, audit), one for each state of the role grammar ``(s?(ua)+)?``: nothing
said yet, after the system turn, after a user turn, after an assistant turn.
``least`` on these structs takes the cheaper edits and, at equal costs, the
ASCII-least audit. Two audits of equal cost over the same turns are never
prefixes of each other, so what is least stays least when letters follow.

A fold copies its audits at each turn, so a long conversation is folded in
parts of PART turns, each from every state it may be entered in, and the
parts are folded in turn: time grows with the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = " \t\n\v\f\r"
ENDS = ".!?"
PART = 512  # turns that one fold runs over
NEVER = 1 << 40  # cost of a state that can't be reached

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("start", "system", "user", "assistant")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: damaged rows, as crc32 of conv_id:turn modulo 20 says.

    0 drops the row (it stays here, marked), 1 empties its text, 2 takes its
    marks of sentence ends, 3 repeats it, 4 makes its role user. Nulls are one
    space in the key, the role and the text.
    """
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    keyed = rows.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    hit = keyed.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return hit.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def whole(rows: DataFrame) -> DataFrame:
    """The same columns without damage; nulls of role and text are one space."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", spoken("role"), spoken("text"), F.lit(False).alias("dropped"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows with their place in the conversation, first fault, and whether the pair with the row before is illegal.

    Rows go by turn (nulls first), equal turns by role and text. The windows
    need no exchange where rows are partitioned by conv_id.
    """
    by = Window.partitionBy("conv_id", "dropped").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    last = F.rtrim(F.col("text"), F.lit(SPACES))
    placed = rows.select(
        "*",
        F.row_number().over(by).alias("place"),
        F.substring("role", 1, 1).alias("initial"),
        F.lag(F.substring("role", 1, 1)).over(by).alias("before"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(by).eqNullSafe(F.col("turn")), F.lit(False))).cast("long").alias("new_turn"),
        last.alias("last"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("place")) > 1
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.right("last", F.lit(1)).isin(*ENDS), "truncated").otherwise("")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    return placed.select("conv_id", "turn", "role", "text", "dropped", "place", "initial", "new_turn", fault.alias("fault"), illegal.cast("long").alias("illegal"))


def _state(cost, audit) -> Column:
    return F.struct((cost if isinstance(cost, Column) else F.lit(cost)).cast("long").alias("cost"), (audit if isinstance(audit, Column) else F.lit(audit)).alias("audit"))


def _edit(state: Column, cost, letter: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _all(states: list[Column]) -> Column:
    return F.struct(*[s.alias(n) for s, n in zip(states, STATES, strict=True)])


def _with_inserts(s: list[Column]) -> list[Column]:
    """The states after any turns that are inserted: one for each that the grammar asks for."""
    user = F.least(s[USER], *[_edit(s[k], 2, "I") for k in (START, SYSTEM, ASSISTANT)])
    return [s[START], s[SYSTEM], user, F.least(s[ASSISTANT], _edit(user, 2, "I"))]


def _after(acc: Column, turn: Column) -> Column:
    """The four states after one more turn: it is deleted, kept or given another role."""
    s = [acc[n] for n in STATES]
    gone = [_edit(x, 3, "D") for x in s]
    stays = ~turn["fault"].isin("blank", "duplicate")
    more = (turn["fault"] == "truncated").cast("long")
    said = lambda state, initial: F.when(stays, F.when(turn["initial"] == initial, _edit(state, more, "K")).otherwise(_edit(state, more + 2, "R")))
    opened = F.least(s[START], s[SYSTEM], s[ASSISTANT])
    system = F.when(stays & (turn["initial"] == "s"), _edit(s[START], more, "K"))
    return _all(_with_inserts([gone[START], F.least(gone[SYSTEM], system), F.least(gone[USER], said(opened, "u")), F.least(gone[ASSISTANT], said(s[USER], "a"))]))


def _entered(state: int) -> list[Column]:
    return [_state(0, "") if k == state else _state(NEVER, "") for k in range(4)]


def _fold(turns: Column, state: int) -> Column:
    """The cheapest edits of turns from a state to each of the four."""
    return F.aggregate(turns, _all(_with_inserts(_entered(state))), _after)


def _through(acc: Column, part: Column) -> Column:
    """The states after a part: for each the cheapest way through any state at its beginning."""
    way = lambda a, b: F.when(part[a].isNotNull(), _state(acc[a]["cost"] + part[a][b]["cost"], F.concat(acc[a]["audit"], part[a][b]["audit"])))
    return _all([F.least(*[way(a, b) for a in STATES]) for b in STATES])


def _repaired(rows: Column, audit: Column) -> Column:
    """role:text of the turns that stay or are inserted, joined by newlines; a letter's role follows from its place."""
    letters = F.transform(F.filter(F.split(audit, ""), lambda x: x != ""), lambda x, k: F.struct(k.alias("at"), x.alias("edit")))
    own = F.zip_with(F.filter(letters, lambda x: x["edit"] != "I"), rows, lambda x, r: F.struct(x["at"].alias("at"), x["edit"].alias("edit"), r["role"].alias("role"), r["text"].alias("text")))
    new = F.transform(F.filter(letters, lambda x: x["edit"] == "I"), lambda x: F.struct(x["at"].alias("at"), x["edit"].alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")))
    said = F.array_sort(F.concat(F.filter(own, lambda x: x["edit"] != "D"), new))
    first = F.get(said, F.lit(0))
    shift = F.when((first["edit"] == "K") & first["role"].startswith("s"), 1).otherwise(0)
    turn = lambda x, k: F.concat(F.when(x["edit"] == "K", x["role"]).when((k + shift) % 2 == 0, "user").otherwise("assistant"), F.lit(":"), x["text"])
    return F.array_join(F.transform(said, turn), "\n")


def repair(rows: DataFrame, damaged: bool = False, part: int = PART) -> DataFrame:
    """Faults, the cheapest repair and its text, one row per conv_id of rows (conv_id, turn, role, text).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired. damaged: rows are damaged first, see damage(). A null conv_id is
    a conversation like any other; a null turn comes first and makes no gap;
    null roles and texts are one space, which no repair keeps. Only roles that begin with s, u or a can be kept. Equal turns go by role and text, so that
    repeated rows are neighbours. Without rows after damage all numbers are 0
    and audit and repaired are empty; an empty table gives no rows. Other
    columns are ignored. The turns of a conversation meet in one task, where
    windows read them one by one; its repaired text is one string, so it must
    fit a row (2 GB), as must each text.
    """
    kept = ~F.col("dropped")
    rows = flagged((damage(rows) if damaged else whole(rows)).repartition("conv_id"))
    group = F.when(kept, F.floor((F.col("place") - 1) / part)).otherwise(0)
    turn = F.when(kept, F.struct("place", "initial", "fault", "role", "text"))
    number = lambda c: F.sum(F.when(kept, c).otherwise(0)).cast("long")
    faults = ("blank", "duplicate", "truncated")
    parts = rows.groupBy("conv_id", group.alias("part")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.min(F.when(kept, F.col("turn"))).alias("first_turn"),
        F.max(F.when(kept, F.col("turn"))).alias("last_turn"),
        number(F.col("new_turn")).alias("turns_seen"),
        number(F.col("illegal")).alias("illegal"),
        *[number((F.col("fault") == f).cast("long")).alias(f) for f in faults],
    )
    # a part is entered in any state, the first part only at the start
    folds = F.struct(*[(_fold(F.col("turns"), k) if k == START else F.when(F.col("part") > 0, _fold(F.col("turns"), k))).alias(n) for k, n in enumerate(STATES)])
    folded = parts.withColumn("fold", folds)
    said = F.struct("part", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("rows"), "fold")
    conversations = folded.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(said)).alias("all"),
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns_seen")).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in (*faults, "illegal")],
    )
    ends = F.aggregate(F.transform("all", lambda p: p["fold"]), _all(_entered(START)), _through)
    best = conversations.withColumn("ends", ends).withColumn("best", F.least(F.col("ends")["start"], F.col("ends")["assistant"]))
    return best.select(
        "conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *faults, "illegal",
        F.col("best")["cost"].alias("cost"), F.col("best")["audit"].alias("audit"),
        _repaired(F.flatten(F.transform("all", lambda p: p["rows"])), F.col("best")["audit"]).alias("repaired"),
    )


def repair_digests(rows: DataFrame) -> DataFrame:
    """repair() of damaged rows with the hash of each repaired text in place of the text."""
    out = repair(rows, damaged=True)
    return out.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


def oracle() -> str:
    """DuckDB SQL for repair_digests(): a recursive query takes the turns one by one."""
    states = ("c0", "a0", "c1", "a1", "c2", "a2", "c3", "a3")
    pair = lambda k, cost=0, letter="": f"struct_pack(c := c{k} + {cost}, a := a{k} || '{letter}')"
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
    letter = lambda k, r: f"CASE WHEN must THEN NULL WHEN initial = '{r}' THEN struct_pack(c := c{k} + more, a := a{k} || 'K') ELSE struct_pack(c := c{k} + more + 2, a := a{k} || 'R') END"
    insert = lambda x: f"struct_pack(c := {x}.c + 2, a := {x}.a || 'I')"
    system = "CASE WHEN NOT must AND initial = 's' THEN struct_pack(c := c0 + more, a := a0 || 'K') END"
    chars = " || ".join(f"chr({ord(c)})" for c in SPACES)
    shift = "CASE WHEN first_edit = 'K' AND first_role LIKE 's%' THEN 1 ELSE 0 END"
    return f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(key)), lambda i: CAST(ascii(key[i + 1]) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
    FROM crc, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER w AS place, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before, rtrim(text, {chars}) AS last
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faulty AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN right(last, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
turns AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CAST(fault = 'truncated' AS BIGINT) AS more FROM faulty),
sums AS (SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
folds AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS c0, '' AS a0, CAST({NEVER} AS BIGINT) AS c1, '' AS a1, CAST(2 AS BIGINT) AS c2, 'I' AS a2, CAST(4 AS BIGINT) AS c3, 'II' AS a3 FROM sums
    UNION ALL SELECT conv_id, place, {", ".join(f"s{s[1]}.{s[0]}" for s in states)} FROM (SELECT *, {least("x3", insert("s2"))} AS s3 FROM (SELECT *, x0 AS s0, x1 AS s1, {least("x2", insert("x0"), insert("x1"), insert("x3"))} AS s2 FROM (
        SELECT t.conv_id, t.place, {pair(0, 3, "D")} AS x0, {least(pair(1, 3, "D"), system)} AS x1, {least(pair(2, 3, "D"), letter(0, "u"), letter(1, "u"), letter(3, "u"))} AS x2, {least(pair(3, 3, "D"), letter(2, "a"))} AS x3
        FROM folds f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.place = f.place + 1)))),
best AS (SELECT s.*, list_min([struct_pack(c := c0, a := a0), struct_pack(c := c3, a := a3)]) AS b FROM sums s JOIN folds f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.place = s.n),
letters AS (SELECT conv_id, unnest(string_split(b.a, '')) AS edit, generate_subscripts(string_split(b.a, ''), 1) AS spot FROM best WHERE b.a <> ''),
edits AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY spot) AS k FROM letters),
said AS (SELECT e.*, CASE WHEN edit = 'I' THEN '' ELSE t.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE t.text END AS text FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.place = e.place WHERE edit <> 'D'),
opened AS (SELECT *, first(edit) OVER w AS first_edit, first(role) OVER w AS first_role FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
joined AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - 1 + {shift}) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot) AS repaired FROM opened GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN joined ON joined.conv_id IS NOT DISTINCT FROM o.conv_id"""
