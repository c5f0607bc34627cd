"""Conversation repair against trying all edits."""

import hashlib
import itertools
import re
import zlib

import pytest

from batida.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\v\f\r"


def faults(rows):
    """rows in order -> first fault of each."""
    out, seen = [], set()
    for _, role, text in rows:
        kind = ""
        if not text.strip(BLANKS):
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif text.rstrip(BLANKS)[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """(cost, audit, text) of the cheapest repair, by trying every edit of every row with up to two turns inserted anywhere."""
    kinds, best = faults(rows), None
    inserts = ["", "u", "a", "ua", "au"]
    options = []
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        own = [(3, "D", None)]
        if kind not in ("blank", "duplicate"):
            more = kind == "truncated"
            own += [(more, "K", (role, text)), (2 + more, "R", ("user", text)), (2 + more, "R", ("assistant", text))]
        options.append(own)
    for edits in itertools.product(*options):
        for new in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, said = 0, "", []
            for k, add in enumerate(new):
                cost += 2 * len(add)
                audit += "I" * len(add)
                said += [("user" if x == "u" else "assistant", "") for x in add]
                if k < len(edits):
                    cost, audit = cost + edits[k][0], audit + edits[k][1]
                    said += [edits[k][2]] if edits[k][2] else []
            if best and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in said)) and all(role for role, _ in said):
                best = (cost, audit, "\n".join(f"{role}:{text}" for role, text in said))
    return best


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(rows):
    """conv_id -> the row of repair(), of rows without damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = order([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
        kinds = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, text = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, text)
    return out


ROLES = ["system", "user", "assistant", "tool", None, ""]
TEXTS = ["Yes.", "No", "Why? ", " \t", "", None, "Yes."]


def made():
    """Conversations of up to four rows that meet every fault, tie and null."""
    rows = []
    for conv in range(60):
        for k in range(conv % 5):
            h = zlib.crc32(f"{conv}-{k}".encode())
            rows.append((conv, None if h % 11 == 0 else (h >> 4) % 5, ROLES[(h >> 8) % (3 if h % 3 else 6)], TEXTS[(h >> 12) % (3 if h % 2 else 7)]))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (100, 7, "user", "a."), (100, 7, "user", "a."), (100, 2, "assistant", "b")]
    return rows


@pytest.mark.parametrize("part", [512, 1, 2])
def test_all_edits(spark, part):
    rows = made()
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), part=part).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows)


def test_damage_is_by_key(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in [*range(5), None]] + [(None, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    got = conversations.damage(spark.createDataFrame(rows, SCHEMA)).where("not dropped").drop("dropped").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(40) for t in range(5)} >= {0, 1, 2, 3, 4}


def test_digests_of_conversations_that_lose_all_rows(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    row = conversations.repair_digests(spark.createDataFrame([(gone, 1, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations_and_clashing_columns(spark):
    """20,000 turns in one conversation fold in parts; columns with the names of results are ignored."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(20_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cost int, audit string")
    (row,) = conversations.repair(df).collect()
    assert (row.cost, row.audit) == (0, "K" * 20_000)
    assert row.repaired == "\n".join(f"{r[2]}:{r[3]}" for r in rows)


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.")], SCHEMA).repartition(2)
    plan = conversations.repair(df, damaged=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
