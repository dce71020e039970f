"""Repair and formatting of conversations: against plain dynamic programming, enumeration, and the way back."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from framelake.llm import chat_format, conversation_repair
from framelake.llm.common import table
from framelake.llm.queries import ORACLES, QUERIES
from framelake.llm.turns import conversation_pieces
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
DONE = re.compile(r"(s?(ua)+)?")


def plain_best(rows):
    """Cheapest edits by a table over all prefixes of rows and role strings; no queue, no heuristic."""
    n = len(rows)
    ways = {"": (0, "")}  # role pattern state, spelled by its last letter ("" before any)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(found):
        for _ in range(3):
            for last, (cost, audit) in list(found.items()):
                to = follow[last]
                found[to] = min(found.get(to, (1e9, "")), (cost + 3, audit + "I"))
        return found

    ways = inserted(ways)
    for initial, fault in rows:
        now = {}

        def put(last, cost, audit):
            now[last] = min(now.get(last, (1e9, "")), (cost, audit))

        for last, (cost, audit) in ways.items():
            put(last, cost + 4, audit + "D")
            if fault == "gone":
                continue
            more = 3 if fault == "cut" else 0
            put(follow[last], cost + 3 + more, audit + "R")
            if initial == follow[last] or (initial == "s" and last == ""):
                put(initial, cost + more, audit + "K")
        ways = inserted(now)
    return min(v for k, v in ways.items() if k in ("", "a")), n


def enumerated(rows, most=5):
    """Cheapest edits among all audits of at most ``most`` letters, each tried out."""
    best = None
    for length in range(most + 1):
        for audit in itertools.product("DIKR", repeat=length):
            if sum(x != "I" for x in audit) != len(rows):
                continue
            for roles in itertools.product("ua", repeat=sum(x in "IR" for x in audit)):
                cost, i, spelled, given = 0, 0, "", iter(roles)
                for x in audit:
                    if x == "I":
                        cost, spelled = cost + 3, spelled + next(given)
                        continue
                    initial, fault = rows[i]
                    i += 1
                    if x == "D":
                        cost += 4
                        continue
                    cost += (3 if fault == "cut" else 0) + (3 if x == "R" else 0) + (10**6 if fault == "gone" else 0)
                    spelled += next(given) if x == "R" else initial
                if DONE.fullmatch(spelled) and cost < 10**6:
                    best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
    return best


KINDS = {"ok": conversation_repair.SOUND, "gone": conversation_repair.MUST_GO, "cut": conversation_repair.CUT_OFF}


def searched(rows):
    return next(iter(conversation_repair.search([(i, KINDS[k]) for i, k in rows]).values()))


def test_search_against_enumeration():
    for n in (0, 1, 2):
        for rows in itertools.product(itertools.product("suax", KINDS), repeat=n):
            assert searched(rows) == enumerated(rows), rows


def test_search_against_a_whole_table():
    rng = random.Random(4)
    for _ in range(1500):
        rows = [(rng.choice("suuaax"), rng.choice(["ok", "ok", "ok", "gone", "cut"])) for _ in range(rng.randint(0, 25))]
        assert searched(rows) == plain_best(rows)[0], rows


def by_hand(rows):
    """The report, from plain Python, of rows (conv_id, turn, role, text) as given."""
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        told = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(told).encode()) % 20
        damaged[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: report_of(found) for conv, found in damaged.items()}


def report_of(found):
    found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in found:
        said = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in found if r[0] is not None]
    kinds = {"blank": "gone", "duplicate": "gone", "truncated": "cut", "": "ok"}
    (cost, audit), _ = plain_best([(role[:1], kinds[f]) for (_, role, _), f in zip(found, faults)])
    left, last, i = [], "", 0
    for x in audit:
        asked = "assistant" if last == "u" else "user"
        if x != "I":
            _, role, text = found[i]
            i += 1
        if x != "D":
            left.append((asked, "") if x == "I" else (asked, text) if x == "R" else (role, text))
            last = left[-1][0][0]
    joined = "\n".join(f"{r}:{t}" for r, t in left)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(joined.encode()).hexdigest())


def awkward():
    rng = random.Random(9)
    rows = []
    say = lambda: rng.choice(["Yes.", "No", "", " \t", "a b?", "x!  ", " ", "<|im_end|>", "y" * 3000 + "."]) + rng.choice(["", "", "z."])
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", "tool", None, "a\nb\\n<|x"]), say()))
    rows += [(None, t, r, s) for t, r, s in ((0, "user", "Hi."), (1, "assistant", None), (None, "assistant", "Ho."))]
    rows += [(1000, t, rng.choice(["user", "assistant"]), say()) for t in range(400)]  # a third of all rows
    rows += [(1000, 7, "user", "same."), (1000, 7, "user", "same.")] * 20
    rows += [(2000, None, None, None)] * 3
    return rows


def frame(spark, rows):
    clash = {c: 5 for c in ("part", "piece", "whole", "rows", "first", "again", "cost", "audit", "_text", "_conv", "_kind", "n_turns")}
    out = spark.createDataFrame(rows, SCHEMA)
    for c, v in clash.items():
        out = out.withColumn(c, F.lit(v))
    return out.repartition(3)


def reports(spark, rows, piece_rows, tmp=None):
    from framelake.llm.conversation_repair import damage, repair, report

    told = report(repair(damage(frame(spark, rows)), piece_rows)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len({r.conv_id for r in told}) == len(told)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha(r.repaired_text)) for r in told}


@pytest.mark.parametrize("piece_rows", [1, 7, 512])
def test_repair_in_pieces_of_any_size(spark, piece_rows):
    rows = awkward()
    want = by_hand(rows)
    got = reports(spark, rows, piece_rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {c: got.get(c, nothing) for c in want} == want and set(got) <= set(want)


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == by_hand(rows)


def test_repair_of_nothing(spark):
    assert reports(spark, [], 512) == {}


def test_pieces_keep_all_rows_in_order(spark):
    rows = [(c, t, "user", str(t)) for c in (1, 2) for t in range(300)] + [(3, 0, "user", "x")]
    got = conversation_pieces(spark.createDataFrame(rows, SCHEMA), 64).collect()
    for c in (1, 2):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.part, r.piece))
        assert [x.turn for r in mine for x in r.rows] == list(range(300)) and all(len(r.rows) <= 64 and not r.whole for r in mine)


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "\n", "n", "im_end", "<|im_start|>", "a"]) for _ in range(rng.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        role = chat_format.escape_role(text)
        assert chat_format.unescape_role(role) == text and "<|" not in role and "\n" not in role


@pytest.mark.parametrize("piece_rows", [1, 5, 512])
def test_format_and_read_back(spark, piece_rows):
    rows = awkward()
    made = chat_format.format_conversations(frame(spark, rows), piece_rows=piece_rows)
    got = {r.conv_id: (r.n_turns, r.turns_text, r.loss_text) for r in chat_format.read_back(made).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want[conv] = (len(turns), "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant"))
    assert got == want


def test_mask_covers_assistants_texts_alone():
    template = chat_format.Template(chat_format.BYTE_LEVEL)
    ids, mask = template.assemble([("user", "a <|im_end|>"), ("assistant", "é<|im_start|>"), ("assistant", ""), ("assistant", "b")])
    assert template.learned(ids, mask) == ["é<|im_start|>", "b"]
    assert (ids == template.start).sum() == (ids == template.end).sum() == 4 and not mask[(ids == template.start) | (ids == template.end)].any()


def test_format_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = QUERIES["op12_chat_format"](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op12_chat_format']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and -1 in {r[0] for r in want}
