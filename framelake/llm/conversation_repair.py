"""Repair of conversations: A* on the lattice of edits, and what was wrong with them.

A repaired conversation's roles begin, by their first letters, with an optional
``s`` and go on with any number of ``ua``. Rows are kept, given another role, deleted or inserted.
The search runs over pieces of at most 512 rows; a longer conversation's pieces
are searched from every state and joined at the cheapest states between them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import ASCII_SPACE, materialise
from framelake.llm.turns import PIECE_ROWS, conversation_pieces

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, MUST_GO, CUT_OFF = 0, 1, 2
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that a state asks for next, and the state after it.
ASKED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Rows to insert so that a conversation may end in a state.
MISSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")


def after(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role; None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    role, then = ASKED[state]
    return then if initial == role[0] else None


def search(rows: list[tuple[str, int]], entry: int = START, last: bool = True) -> dict[int, tuple[int, str]]:
    """Exit state -> (cost, audit) of the cheapest edits of (initial, fault) rows from ``entry``, ties by the least audit.

    The heuristic sums, over the rows to come, 4 for each that must go and 3 for
    each cut-off one: no edit of such a row costs less, so the first time a node
    leaves the queue, it has its least (cost plus heuristic, audit). Two audits
    of equal cost that end in the same node are never one the other's beginning
    (only insertions could follow, and they cost), so the lesser one stays the
    lesser whatever follows. Where more rows follow (``last`` false), insertions
    after the last row belong to what follows, and every exit is searched for;
    otherwise only the best end.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + {SOUND: 0, MUST_GO: DELETE, CUT_OFF: TRUNCATED}[rows[i][1]]
    queue = [(ahead[0], "", 0, entry, 0)]
    settled, exits = set(), {}
    while queue:
        _, audit, i, state, cost = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and not last:
            exits[state] = (cost, audit)
            continue
        if i == n and state in ENDS:
            return {state: (cost, audit)}
        steps = [(INSERT, "I", i, ASKED[state][1])]
        if i < n:
            initial, fault = rows[i]
            steps.append((DELETE, "D", i + 1, state))
            if fault != MUST_GO:
                extra = TRUNCATED if fault == CUT_OFF else 0
                steps.append((REROLE + extra, "R", i + 1, ASKED[state][1]))
                if (kept := after(state, initial)) is not None:
                    steps.append((extra, "K", i + 1, kept))
        for price, letter, to, then in steps:
            if (to, then) not in settled:
                heapq.heappush(queue, (cost + price + ahead[to], audit + letter, to, then, cost + price))
    return exits


def edited(rows: list[tuple[str, str]], audit: str, entry: int = START) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit's edits leave; an audit names every role."""
    out, state, i = [], entry, 0
    for letter in audit:
        role, then = ASKED[state]
        if letter == "I":
            out.append((role, ""))
            state = then
            continue
        if letter == "K":
            out.append(rows[i])
            state = after(state, rows[i][0][:1])
        elif letter == "R":
            out.append((role, rows[i][1]))
            state = then
        i += 1
    return out


def fault_of(row: dict) -> tuple[str | None, int]:
    """A row's first fault and what it means for the edits."""
    said = row["text"].rstrip(ASCII_SPACE)
    if not said:
        return "blank", MUST_GO
    if row["again"] or not row["first"]:
        return "duplicate", MUST_GO
    if said[-1] not in ".!?":
        return "truncated", CUT_OFF
    return None, SOUND


_REPAIRED = "array<struct<role string, text string>>"
_FOUND = (
    "part int, piece long, whole boolean, n_rows long, least long, most long, turns long, opens long, closes long, before string, behind string, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, costs array<long>, ranks array<int>, audits array<string>"
)


def _found(rows: list[dict], whole: bool) -> dict:
    """A piece's faults and turns, and its search: to the end where it is a whole conversation, else from every state to every state."""
    faults = [fault_of(r) for r in rows]
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out = {
        "n_rows": len(rows),
        "least": turns[0] if turns else None,
        "most": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "opens": rows[0]["turn"],
        "closes": rows[-1]["turn"],
        "before": initials[0],
        "behind": initials[-1],
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False)),
    }
    out |= {name: sum(f == name for f, _ in faults) for name in ("blank", "duplicate", "truncated")}
    steps = [(a, kind) for a, (_, kind) in zip(initials, faults, strict=True)]
    if whole:
        out["cost"], out["audit"] = next(iter(search(steps).values()))
    else:
        ways = [search(steps, entry, last=False) for entry in range(4)]
        out["costs"] = [w.get(e, (None, None))[0] for w in ways for e in range(4)]
        out["audits"] = [w.get(e, (None, None))[1] for w in ways for e in range(4)]
        places = [sorted(audit for _, audit in w.values()) for w in ways]
        out["ranks"] = [places[k].index(w[e][1]) if e in w else -1 for k, w in enumerate(ways) for e in range(4)]
    return out


def _routes(pieces: pd.DataFrame) -> pd.DataFrame:
    """The states between a conversation's pieces, from the last piece back, and what adjoining pieces share.

    Each piece has 16 costs and 16 ranks, whatever its rows. Audits of one piece
    from one entry to two exits are never one the other's beginning, so their
    ranks alone break ties.
    """
    pieces = pieces.sort_values(["part", "piece"], ignore_index=True)
    best = {e: (INSERT * MISSING[e], 0) for e in range(4)}
    choice = []
    for costs, ranks in zip(reversed(pieces.costs.tolist()), reversed(pieces.ranks.tolist()), strict=True):
        now = {}
        for entry in range(4):
            ways = [(costs[4 * entry + e] + best[e][0], ranks[4 * entry + e], e) for e in range(4) if ranks[4 * entry + e] >= 0]
            now[entry] = (min(ways)[0], min(ways)[2])
        choice.append([now[e][1] for e in range(4)])
        best = now
    state, entries, exits = START, [], []
    for exit_of in reversed(choice):
        entries.append(state)
        state = exit_of[state]
        exits.append(state)
    n = len(pieces)
    opens, closes = pieces.opens, pieces.closes.shift()
    pairs = pieces.behind.shift() + pieces.before
    return pd.DataFrame(
        {
            "part": pieces.part,
            "piece": pieces.piece,
            "entry": entries,
            "exit": exits,
            "is_last": [i == n - 1 for i in range(n)],
            "shared_turns": (opens.notna() & (opens == closes)).astype("int64"),
            "joint_illegal": [int(i > 0 and p not in LEGAL_PAIRS) for i, p in enumerate(pairs)],
        }
    )


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of repaired conversations: conv_id, part, piece, whole, counts of faults, cost, audit, repaired rows.

    ``rows`` has conv_id, turn, role and text; further columns are not read. A null
    role or text counts as one space. Rows are taken by turn
    (null first), rows of one turn by role and text. Each row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated. ``audit``
    has a letter for each edit: Keep, Rerole, Delete, Insert; ``repaired`` is
    the array of rows left. A role without a letter can't be kept as it is. A
    conversation that isn't ``whole`` continues in its pieces, ordered by (part,
    piece): ``report`` adds them up. An empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    given = rows.select("conv_id", "turn", space("role"), space("text")).withColumn("_text", F.sha2(F.col("text").cast("binary"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = given.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_text").alias("_said")).agg(F.min(turn).alias("_at"))
    # A key holds one row of firsts and the equal rows of one turn.
    seen = (
        given.join(
            firsts,
            F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_said")) & F.col("turn").eqNullSafe(F.col("_at.turn")),
            "left",
        )
        .select("conv_id", "turn", "role", "text", F.col("_at").isNotNull().alias("first"))
    )
    pieces = conversation_pieces(seen, piece_rows)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in batch.to_pylist():
                found = piece | _found(piece["rows"], piece["whole"])
                said = [(r["role"], r["text"]) for r in piece["rows"]]
                kept = edited(said, found["audit"]) if piece["whole"] else said
                out.append(found | {"repaired": [{"role": a, "text": b} for a, b in kept]})
            yield pa.RecordBatch.from_pylist(out, schema=_solved_schema(batch.schema.field("conv_id")))

    conv = pieces.schema["conv_id"].dataType.simpleString()
    solved = materialise(pieces.mapInArrow(solve, f"conv_id {conv}, {_FOUND}, repaired {_REPAIRED}"))
    cut = solved.filter(~F.col("whole"))
    return (
        solved.filter("whole")
        .select(*_COLUMNS)
        .unionByName(_joined(cut, conv).select(*_COLUMNS))
    )


_COLUMNS = ["conv_id", "part", "piece", "whole", "n_rows", "least", "most", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def _solved_schema(conv: pa.Field) -> pa.Schema:
    longs = lambda *names: [(n, pa.int64()) for n in names]
    return pa.schema(
        [
            conv,
            ("part", pa.int32()),
            ("piece", pa.int64()),
            ("whole", pa.bool_()),
            *longs("n_rows", "least", "most", "turns", "opens", "closes"),
            ("before", pa.string()),
            ("behind", pa.string()),
            *longs("blank", "duplicate", "truncated", "illegal", "cost"),
            ("audit", pa.string()),
            ("costs", pa.list_(pa.int64())),
            ("ranks", pa.list_(pa.int32())),
            ("audits", pa.list_(pa.string())),
            ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
        ]
    )


def _joined(cut: DataFrame, conv: str) -> DataFrame:
    """Pieces of conversations in several, each with the edits between the states that the cheapest way passes."""
    narrow = cut.select("conv_id", "part", "piece", "costs", "ranks", "opens", "closes", "before", "behind")
    routes = narrow.groupBy("conv_id").applyInPandas(
        _routes, "part int, piece long, entry int, exit int, is_last boolean, shared_turns long, joint_illegal long"
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("repaired").to_pylist()
            ways = zip(batch.column("audit").to_pylist(), batch.column("entry").to_pylist(), said, strict=True)
            kept = [edited([(r["role"], r["text"]) for r in rows], audit, entry) for audit, entry, rows in ways]
            at = batch.schema.get_field_index("repaired")
            yield batch.set_column(at, batch.schema.field(at), pa.array([[{"role": a, "text": b} for a, b in k] for k in kept], batch.schema.field(at).type))

    way = F.col("entry") * 4 + F.col("exit") + 1
    missing = F.when(F.col("is_last"), F.element_at(F.array(*(F.lit(MISSING[e]) for e in range(4))), F.col("exit") + 1)).otherwise(0)
    chosen = cut.drop("cost", "audit").join(routes, ["part", "piece"]).select(
        "conv_id", "part", "piece", "whole", "n_rows", "least", "most", "blank", "duplicate", "truncated", "repaired", "entry",
        (F.col("turns") - F.col("shared_turns")).alias("turns"),
        (F.col("illegal") + F.col("joint_illegal")).alias("illegal"),
        (F.element_at("costs", way) + INSERT * missing).alias("cost"),
        F.concat(F.element_at("audits", way), F.repeat(F.lit("I"), missing)).alias("audit"),
    )
    return chosen.mapInArrow(apply, chosen.schema)


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s pieces: n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_text.

    ``repaired_text`` has a line ``role:text`` for each row left, as the audit is
    one string by its nature: only these two meet in one row, and only for conversations that aren't whole.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r.role, F.lit(":"), r.text)), "\n")
    flat = pieces.select("*", lines.alias("lines"), F.size("repaired").alias("left"))
    gaps = lambda most, least, turns: F.coalesce(most - least + 1 - turns, F.lit(0)).alias("gaps")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    whole = flat.filter("whole").select("conv_id", "n_rows", gaps(F.col("most"), F.col("least"), F.col("turns")), *counts, "audit", F.col("lines").alias("repaired_text"))
    inner = F.sort_array(F.collect_list(F.struct("part", "piece", "audit", "left", "lines")))
    cut = (
        flat.filter(~F.col("whole"))
        .groupBy("conv_id")
        .agg(F.sum("n_rows").alias("n_rows"), F.max("most").alias("_most"), F.min("least").alias("_least"), F.sum("turns").alias("_turns"), *(F.sum(c).alias(c) for c in counts), inner.alias("_p"))
        .select(
            "conv_id", "n_rows", gaps(F.col("_most"), F.col("_least"), F.col("_turns")), *counts,
            F.array_join(F.transform("_p", lambda p: p.audit), "").alias("audit"),
            F.array_join(F.transform(F.filter("_p", lambda p: p.left > 0), lambda p: p.lines), "\n").alias("repaired_text"),
        )
    )
    return whole.unionByName(cut)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults that depend on nothing but conv_id and turn, so that reruns agree.

    Null role and text become one space, and so does a null in the name
    ``conv_id:turn``, whose CRC-32 modulo 20 decides: 0 drops the row, 1 empties
    its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a user row.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    named = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).filter(F.col("_kind") != 0)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
