"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from sablespan.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Cost, audit and repaired rows by searching edits in order of cost, then of letters; rows: role, text, fault."""
    queue, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and GRAMMAR.match(initials):
            return cost, letters, out
        key = at, initials[-1:], not initials
        if key in seen:
            continue
        seen.add(key)
        ways = [("I", 3, at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            ways.append(("D", 4, at + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                ways.append(("K", more, at + 1, role, f"{role}:{text}"))
                ways += [("R", 3 + more, at + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, price, then, role, row in ways:
            now = initials if role is None else initials + role[:1]
            if role is not None and not (role[:1] and re.match(r"(s?(ua)*u?)\Z", now)):
                continue
            heapq.heappush(queue, (cost + price, letters + letter, then, now[-2:] if len(now) > 2 and now[-1] == "a" else now, out if row is None else (*out, row)))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain_repair(rows, after_damage=None):
    every = {r[0] for r in rows}
    left = damage(rows) if after_damage is None else after_damage
    out = {}
    for conv in every:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64]))
        turns = [r[1] for r in own if r[1] is not None]
        seen, marked = set(), []
        for _, _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        pairs = zip(marked, marked[1:])
        cost, audit, built = cheapest(marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")],
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(built).encode()).hexdigest(),
        )
    return out


def test_conversation_repair_on_the_table(spark, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = plain_repair([tuple(r) for r in src.select("conv_id", "turn", "role", "text").collect()])
    for chunk in (None, 2):
        got = C.repaired(C.damaged(src), chunk).collect()
        assert len(got) == len(want)
        assert all(tuple(r)[1:] == want[r["conv_id"]] for r in got)


ODD = [
    (1, 0, None, None), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, None, "assistant", "First?"), (1, 9, "tool", "x"),
    (2, 5, "system", "Be good."), (2, 6, "system", "Be better."), (2, 7, "", "no role."), (3, None, "user", "a"), (3, None, None, ""),
    (None, 1, "user", "A."), (None, 2, "assistant", "B!"), (None, 2, "assistant", "B!"), (4, 1, "user", "x" * 300_000 + "."), (4, 2, "assistant", " \n"),
]


def test_conversation_repair_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, gaps string"
    long = [(7, t, random.Random(t).choice(["user", "assistant", "system", "bot"]), random.Random(-t).choice(["Yes.", "no", "", f"{t}!"])) for t in range(300)]
    hot = [(8, 3, "user", "Same.")] * 200
    rows = ODD + long + hot
    src = spark.createDataFrame([(*r, "z") for r in rows], schema)
    want = plain_repair(rows)
    for chunk in (None, 1, 7):
        got = C.repaired(C.damaged(src), chunk).collect()
        assert len(got) == len(want) == 7
        for r in got:
            assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]
    assert C.repaired(C.damaged(spark.createDataFrame([], schema))).collect() == []


def test_conversation_that_loses_all_rows(spark):
    turns = [t for t in range(2000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0][:3]
    src = spark.createDataFrame([(1, t, "user", "a.") for t in turns], "conv_id long, turn long, role string, text string")
    (row,) = C.repaired(C.damaged(src)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", range(5))
def test_walk_equals_search(n):
    kinds = list(itertools.product("suab", (None, "blank", "truncated")))
    cases = itertools.product(kinds, repeat=n) if n < 3 else [random.Random(k).choices(kinds, k=n + 3) for k in range(300)]
    for case in cases:
        rows = list(case)
        cost, audit, built = cheapest([(i, "t", f) for i, f in rows])
        letters, state = C.walk(rows, C.at_end(), C.START, last=True)
        costs = C.at_end()
        for initial, fault in reversed(rows):
            costs = C.before(costs, initial, fault)
        assert (letters, costs[C.START]) == (audit, cost), rows
        assert [b[0] for b in C.rebuilt([i for i, _ in rows], ["t"] * len(rows), letters, C.START)] == [b[0] for b in built]
