"""Repaired conversations against a search over whole strings of edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from tidepool.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def best(turns):
    """(cost, audit, repaired turns) by trying every edit; turns: (must go, truncated, role, text). At most one more insertion than a good conversation may lack in a row."""

    @cache
    def go(i, state, inserted):
        options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[nxt]
        if inserted < 3:
            c, s, t = go(i, nxt, inserted + 1)
            options.append((c + 3, "I" + s, ((name, ""), *t)))
        if i < len(turns):
            must, short, role, text = turns[i]
            c, s, t = go(i + 1, state, 0)
            options.append((c + 4, "D" + s, t))
            if not must:
                if role[:1] == nxt or (role[:1] == "s" and state == ""):
                    c, s, t = go(i + 1, role[:1], 0)
                    options.append((c + 3 * short, "K" + s, ((role, text), *t)))
                c, s, t = go(i + 1, nxt, 0)
                options.append((c + 3 + 3 * short, "R" + s, ((name, text), *t)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return go(0, "", 0)


def brute(rows):
    """All columns of each conversation of damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults, turns = set(), [], []
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            turns.append((fault in ("blank", "duplicate"), fault == "truncated", role, text))
        known = [r[1] for r in own if r[1] is not None]
        illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(own))
        cost, audit, fixed = best(tuple(turns))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def got(df, block=turn_repair.BLOCK):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    rows = turn_repair.digest(turn_repair.repair(turn_repair.damaged(df), copies="copies", block=block)).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def made(rng, convs, most):
    texts = ["Yes.", "No!", "why", "Why?", "", "  \n", "a longer text. ", "end.\t\n", "日本。", "one", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, most)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {turn}."
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn + 3, -turn]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_repairs_are_the_cheapest_and_least(spark, seed):
    rows = made(random.Random(seed), 120, 14)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_conversations_cut_anywhere(spark, block):
    """Blocks of a few turns: nearly all conversations go the way of those that no task holds."""
    rows = made(random.Random(block), 60, 25)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), block) == brute(rows)


def test_one_conversation_with_most_turns(spark):
    rng = random.Random(2)
    hot = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["ok.", f"text {i}.", "cut off", ""])) for i in range(30_000)]
    rows = hot + [r for r in made(rng, 30, 8) if r[0] != 7]
    pieces = turn_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(6))
    sizes = [r["n"] for r in pieces.where("conv_id = 7").selectExpr("size(turns) AS n").collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * turn_repair.BLOCK
    plain = turn_repair.digest(pieces).where("conv_id = 7").first()
    seen, runs = set(), []
    for _, _, role, text in hot:
        must = not text or (role, text) in seen
        seen.add((role, text))
        runs.append({"initial": None if must else role[0], "cost": 3 * (text == "cut off"), "gone": int(must), "role": role, "text": text})
    audit, turns, cost, _ = turn_repair.walk(runs, turn_repair._values(runs, turn_repair.END), 0, True)
    assert (plain["audit"], plain["cost"], plain["gaps"]) == (audit, cost, 0)
    assert plain["repaired_sha256"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest()


def test_equal_rows_are_counted_before_they_move(spark):
    rows = [(1, None, "user", "Hi.")] * 5000 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["conv_id"]: r for r in turn_repair.digest(turn_repair.repair(df)).collect()}
    assert (out[1]["duplicate"], out[1]["illegal"], out[1]["cost"], out[1]["gaps"]) == (4999, 4999, 4999 * 4 + 3, 0)
    assert out[1]["audit"] == "K" + "D" * 4999 + "I" and out[2]["audit"] == "KI"


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.digest(turn_repair.repair(turn_repair.damaged(empty), copies="copies")).count() == 0
    rows = [(None, None, None, None), (None, None, None, None), (1, 2**62, "user", "a" * 100_000 + "."), (1, -(2**62), "assistant", None), (2, -(2**63), "user", "Far."), (2, 2**63 - 1, "assistant", "Off.")]
    wide = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], SCHEMA + ", part long, seq long, conv string")
    assert {k: v[1:] for k, v in got(wide).items()} == {k: v[1:] for k, v in brute(rows).items()}


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_turn_repair(spark, sf).collect()
    assert {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in out} == brute(rows)
    assert len(out) == len({r[0] for r in rows})
