"""Conversations with faulty turns, repaired by the cheapest edits.

A conversation's turns are good if the initials of their roles are none, or an optional
``s`` and then pairs ``ua``. A turn is kept (0), made a user's or assistant's (3) or
deleted (4, and it must be if it is blank or repeats an earlier one); empty turns may be
inserted anywhere (3); a truncated turn that stays costs 3 more. A backward pass over turns
and four states of the grammar gives the cost to go; a forward walk then takes, of the edits
that lose nothing, the one whose initial comes first: D, I, K, R.

One conversation may hold any share of all turns, so none is gathered. Equal turns of one
place are counted first. Turns are then dealt by ranges of (conversation, turn), which cuts
a long one over many tasks, and are cut into blocks of at most BLOCK turns or BYTES of text.
A conversation that lies within one block of one task is repaired there. For all others a
block is summed up as the least cost from each state to each other (min-plus matrices of 4
x 4); a pass over matrices from the last block to the first gives each block's cost to go,
blocks then say where each state would leave them, and a pass from the first block to the
last gives the state in which each is entered. Only then do blocks walk, each by itself.
These passes see a row a block. A digest of a whole conversation has no such parts:
one task reads the conversation's repaired blocks as a stream and holds nothing else of
them than the running hash and the edits' initials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepool.llm import store

#: Most turns and bytes of text of a block; one longer turn is a block of its own.
BLOCK, BYTES = 4096, 1 << 22
#: Rows of a batch that is handed on.
OUT = 512
#: Costs of edits, and the pairs of initials that may stand side by side.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: States: nothing yet, after a system's, a user's and an assistant's turn. The state after the turn that may be inserted in each, and after one that is kept.
INSERTED = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ROLES = {2: "user", 3: "assistant"}
#: Cost to go after the last turn, and more than any cost.
END, FAR = [0, 6, 3, 0], 1 << 60
SPACE = " \t\n\v\f\r"

#: initial: null if the run's first turn must go; cost of keeping it; gone: turns after it that must go.
RUN = "struct<initial:string,cost:int,gone:bigint,role:string,text:string>"
COUNTS = "low long, high long, n_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
PIECE = f"part int, seq long, whole boolean, {COUNTS}, cost long, audit string, turns array<struct<role:string,text:string>>"


def _closed(f: list[int]) -> list[int]:
    """Costs to go if turns may be inserted first."""
    after_user = min(f[2], INSERT + f[3])
    return [min(f[0], INSERT + after_user), min(f[1], INSERT + after_user), after_user, min(f[3], INSERT + after_user)]


def _before(run: dict, after: list[int]) -> list[int]:
    """Costs to go before a run of turns, from those after it."""
    after = [x + DELETE * run["gone"] for x in after]
    if run["initial"] is None:
        return after
    keeps = KEPT.get(run["initial"], (None,) * 4)
    out = []
    for q in range(4):
        best = min(after[q] + DELETE, after[INSERTED[q]] + REROLE + run["cost"])
        out.append(best if keeps[q] is None else min(best, after[keeps[q]] + run["cost"]))
    return _closed(out)


def _values(runs: list[dict], after: list[int]) -> list[list[int]]:
    """Costs to go before each run and after the last."""
    out = [after]
    for run in reversed(runs):
        out.append(_before(run, out[-1]))
    return out[::-1]


def walk(runs: list[dict], values: list[list[int]], state: int, last: bool) -> tuple[str, list[dict], int, int]:
    """(initials of the edits, turns that result, cost, state at the end); ``last``: nothing follows, so what is lacking is inserted."""
    audit: list[str] = []
    turns: list[dict] = []
    cost = 0

    def insert() -> None:
        nonlocal state, cost
        state = INSERTED[state]
        cost += INSERT
        audit.append("I")
        turns.append({"role": ROLES[state], "text": ""})

    for run, now, then in zip(runs, values, values[1:], strict=False):
        while run["initial"] is not None:
            after = [x + DELETE * run["gone"] for x in then]
            new = INSERTED[state]
            keep = KEPT.get(run["initial"], (None,) * 4)[state]
            if after[state] + DELETE == now[state]:
                cost += DELETE
                audit.append("D")
            elif now[new] + INSERT == now[state]:
                insert()
                continue
            elif keep is not None and after[keep] + run["cost"] == now[state]:
                state = keep
                cost += run["cost"]
                audit.append("K")
                turns.append({"role": run["role"], "text": run["text"]})
            else:
                state = new
                cost += REROLE + run["cost"]
                audit.append("R")
                turns.append({"role": ROLES[new], "text": run["text"]})
            break
        audit.append("D" * run["gone"])
        cost += DELETE * run["gone"]
    while last and values[-1][state]:
        insert()
    return "".join(audit), turns, cost, state


class _Piece:
    """What is known so far of the turns of a block."""

    def __init__(self, conv: object) -> None:
        self.conv, self.runs, self.bytes, self.rows = conv, [], 0, 0
        self.of = dict.fromkeys(("low", "high", "first_turn", "last_turn", "first_initial", "last_initial"))
        self.of |= dict.fromkeys(("n_turns", "blank", "duplicate", "truncated", "illegal"), 0)

    def add(self, r: dict) -> None:
        n, of = r["n"], self.of
        if not n:  # of a conversation that is known by its id alone
            return
        self.rows += 1
        self.bytes += len(r["text"])
        if (turn := r["turn"]) is not None:
            of["n_turns"] += turn != of["last_turn"]
            if of["low"] is None:
                of["low"] = of["first_turn"] = turn
            of["high"] = of["last_turn"] = turn
        if of["first_initial"] is None:
            of["first_initial"] = r["initial"]
        else:
            of["illegal"] += (of["last_initial"], r["initial"]) not in LEGAL
        of["illegal"] += n - 1
        of["last_initial"] = r["initial"]
        if r["blank"]:
            of["blank"] += n
        else:
            of["duplicate"] += n - 1 + r["later"]
            of["truncated"] += r["truncated"] and not r["later"]
        if r["blank"] or r["later"]:
            self.runs.append({"initial": None, "cost": 0, "gone": n, "role": None, "text": None})
        else:
            self.runs.append({"initial": r["initial"], "cost": TRUNCATED * r["truncated"], "gone": n - 1, "role": r["role"], "text": r["text"]})

    def row(self, whole: bool) -> dict:
        out = {"conv": self.conv, "whole": whole, **self.of}
        if whole:
            out["audit"], out["turns"], out["cost"], _ = walk(self.runs, _values(self.runs, END), 0, True)
        else:
            columns = [_values(self.runs, [0 if q == to else FAR for q in range(4)])[0] for to in range(4)]
            out |= {"runs": self.runs, "matrix": [min(FAR, columns[to][q]) for q in range(4) for to in range(4)]}
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(t["text"] or "") for t in r.get("turns") or r.get("runs") or ())
        if len(held) >= OUT or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stream(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """A generator over the rows of each partition."""
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), arrow), schema)


def _cut(rows: Iterator[dict], block: int) -> Iterator[dict]:
    """Pieces of the conversations of one range, in order; the first and the last one may go on in other ranges."""
    part, seq = TaskContext.get().partitionId(), 0
    piece: _Piece | None = None
    inner = False  # the conversation began in this range and isn't cut yet
    for r in rows:
        if piece is None:
            piece = _Piece(r["conv"])
        elif (other := r["conv"] != piece.conv) or piece.rows and (piece.rows >= block or piece.bytes + len(r["text"]) > BYTES):
            yield {**piece.row(inner and other), "part": part, "seq": seq}
            piece, seq, inner = _Piece(r["conv"]), seq + 1, other
        piece.add(r)
    if piece is not None:
        yield {**piece.row(False), "part": part, "seq": seq}


def _backward(rows: Iterator[dict]) -> Iterator[dict]:
    """Costs to go after each block, from the last block of each conversation to its first."""
    conv: object = None
    after: list[int] | None = None
    for r in rows:
        last = after is None or r["conv"] != conv
        if last:
            conv, after = r["conv"], END
        yield {"part": r["part"], "seq": r["seq"], "after": after, "last": last}
        m = r["matrix"]
        after = [min(m[4 * q + to] + after[to] for to in range(4)) for q in range(4)]


def _leaving(rows: Iterator[dict]) -> Iterator[dict]:
    """The state in which a walk leaves the block, for each state in which it may enter."""
    for r in rows:
        values = _values(r["runs"], r["after"])
        yield {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "leaves": [walk(r["runs"], values, q, False)[3] for q in range(4)]}


def _forward(rows: Iterator[dict]) -> Iterator[dict]:
    """The state in which each block is entered, from the first block of each conversation on."""
    conv: object = None
    state: int | None = None
    for r in rows:
        if state is None or r["conv"] != conv:
            conv, state = r["conv"], 0
        yield {"part": r["part"], "seq": r["seq"], "state": state}
        state = r["leaves"][state]


def _walked(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        audit, turns, cost, _ = walk(r["runs"], _values(r["runs"], r["after"]), r["state"], r["last"])
        yield {**r, "audit": audit, "turns": turns, "cost": cost}


def repair(turns: DataFrame, copies: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pieces of all repaired conversations: (conv_id, part, seq, whole, counts, cost, audit, turns).

    ``turns`` has conv_id, turn, role and text, and maybe a column ``copies``: how often a row
    is there; a conversation whose rows are there 0 times has one piece without turns. Pieces
    of a conversation are ordered by (part, seq) and have at most ``block`` places of turns;
    ``whole``: it is the only one. Rows are
    ordered by turn (nulls first), role and text, so repeated rows stand side by side. A null
    role or text is one space, a null conv_id a conversation; other columns are dropped; an
    empty table gives an empty one.
    """
    n = F.coalesce(F.col(copies).cast("long"), F.lit(0)) if copies else F.lit(1).cast("long")
    there = n > 0
    given = turns.select(
        F.col("conv_id").alias("conv"),
        F.when(there, F.col("turn").cast("long")).alias("turn"),
        F.when(there, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
        F.when(there, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"),
        n.alias("n"),
    )
    # equal rows of one place become one before they are moved
    rows = given.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    id_ = F.sha2("text", 256)
    known = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.where("n > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("o"), id_.alias("i")).agg(F.min(known).alias("first"), F.count("*").alias("places")).where("places > 1")
    joined = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("o")) & (id_ == F.col("i")), "left")
    stripped = F.rtrim("text", F.lit(SPACE))
    judged = joined.select(
        "conv",
        "turn",
        "role",
        "text",
        "n",
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"),
        (stripped == "").alias("blank"),
        ((stripped != "") & ~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.substring("role", 1, 1).alias("initial"),
    )
    # the start of a text keeps the bounds of ranges small; equal starts stay in one range
    ranged = judged.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    piece = T.StructType([rows.schema["conv"], *T.StructType.fromDDL(PIECE).fields])
    cut = store.keep(_stream(ranged, lambda rows: _cut(rows, block), T.StructType([*piece.fields, *T.StructType.fromDDL(f"runs array<{RUN}>, matrix array<long>").fields])), "turns-cut")
    open_ = cut.where("NOT whole")
    backward = open_.select("conv", "part", "seq", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    after = _stream(backward, _backward, T.StructType.fromDDL("part int, seq long, after array<long>, last boolean"))
    leaving = _stream(open_.select("conv", "part", "seq", "runs").join(after, ["part", "seq"]), _leaving, T.StructType([rows.schema["conv"], *T.StructType.fromDDL("part int, seq long, leaves array<int>").fields]))
    entered = _stream(leaving.repartition("conv").sortWithinPartitions("conv", "part", "seq"), _forward, T.StructType.fromDDL("part int, seq long, state int"))
    walked = _stream(open_.drop("matrix", "cost", "audit", "turns").join(after, ["part", "seq"]).join(entered, ["part", "seq"]), _walked, piece)
    return cut.where("whole").select(*piece.names).unionByName(walked).withColumnRenamed("conv", "conv_id")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(rows: Iterator[dict]) -> Iterator[dict]:
    """One row for each conversation from its pieces in order."""
    out: dict | None = None
    for r in rows:
        if out is not None and r["conv_id"] != out["conv_id"]:
            yield _finished(out)
            out = None
        if out is None:
            out = {"conv_id": r["conv_id"], "low": None, "high": None, "n": 0, "initial": None, "sha": hashlib.sha256(), "any": False, "said": []}
            out |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
            out[k] += r[k]
        if r["low"] is not None:
            out["n"] += r["n_turns"] - (r["first_turn"] == out["high"])
            out["low"], out["high"] = r["low"] if out["low"] is None else out["low"], r["high"]
        if r["first_initial"] is not None:
            out["illegal"] += out["initial"] is not None and (out["initial"], r["first_initial"]) not in LEGAL
            out["initial"] = r["last_initial"]
        out["said"].append(r["audit"])
        for t in r["turns"]:
            out["sha"].update((("\n" if out["any"] else "") + t["role"] + ":" + t["text"]).encode())
            out["any"] = True
    if out is not None:
        yield _finished(out)


def _finished(out: dict) -> dict:
    gaps = 0 if out["low"] is None else out["high"] - out["low"] + 1 - out["n"]
    return {**out, "gaps": gaps if abs(gaps) < 1 << 63 else None, "audit": "".join(out["said"]), "repaired_sha256": out["sha"].hexdigest()}


def digest(pieces: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of each conversation, from the pieces of ``repair``; gaps beyond 64 bits are null."""
    gaps = F.expr("CASE WHEN low IS NULL THEN 0L ELSE try_cast(CAST(high AS decimal(38,0)) - low + 1 - n_turns AS bigint) END")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    names = [f.name for f in T.StructType.fromDDL(RESULT)]
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *names[1:-1], F.sha2(text, 256).alias("repaired_sha256"))
    parts = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(_stream(parts, _summed, T.StructType([pieces.schema["conv_id"], *T.StructType.fromDDL(RESULT).fields])))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32("conv_id:turn") % 20, nulls being one space: (conv_id, turn, role, text, copies)."""

    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )
