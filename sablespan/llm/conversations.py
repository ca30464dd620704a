"""Repairing the structure of conversations (operator 13).

A conversation's rows, in order of turn, are to give role initials (s?(ua)+)? at the least cost.  Keep costs 0,
Rerole to user or assistant 3, Delete 4, Insert of an empty user or assistant row 3; blank and duplicate rows
must go, and a truncated row that stays adds 3.  What a row may become depends only on the initials wanted next, so
there are four states: nothing yet, after s, after u and after a.  A backward pass gives the cost to go
from each row and state; a forward walk takes, of all edits that are on a cheapest way, the ASCII-least letter.
The letters (D, I, K, R) fix the result, as state and letter leave one choice of role.

Rows are sorted by conversation and turn over all tasks, so a conversation of any length is spread over tasks
like others.  Tasks read their rows in order.  A conversation that begins and ends inside a task is settled
there.  What a task has of others, its first and last, and what is longer than CHUNK rows, it leaves in chunks.
A chunk's costs are a (min, +) matrix over the four states; the matrices of a conversation, 16 numbers
a chunk, give the cost to go at each chunk's end; then each chunk's edits are found for each of four states it may
be entered in, the states are followed through, and the chunks' repaired texts are hashed one after another
as they stream by.  No task holds more than a chunk of a conversation.

Cases: null role and text count as one space; a null turn comes first and makes no gap; rows whose conv_id is null
are one conversation, returned with null; rows of one turn come by role, by the first characters of their text, then by a
hash of it; a role's initial is its first character (none for an empty role, which
never fits); an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import mapped, stored

#: Rows of a conversation that are held together, and rows of an Arrow batch of results.
CHUNK, BATCH = 4096, 1024
#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The states by number: nothing yet, after s, after u, after a; where each initial leads, and which a row inserted has.
START, S, U, A = range(4)
STEP = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
NEXT, ROLE = (U, U, A, U), ("user", "user", "assistant", "user")
ENDS = (START, A)
FAR = 1 << 60

LEGAL = frozenset(("su", "ua", "au"))
FAULTS = ("blank", "duplicate", "truncated")
SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with each damaged by the checksum of its conversation and turn; gone: it is
    dropped, which conversations that lose all rows need to be known."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    how = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text)
    role = F.when(how == 4, "user").otherwise(F.coalesce("role", blank))
    once = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (how == 0).alias("gone"), F.explode(once).alias("_copy"))
    return out.drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows with row, a number of their own, and fault: the first of blank, duplicate and truncated, or null."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    # The first row of each role and text: null turns are least. Counted before the shuffle, so copies aren't one key.
    first = rows.filter("NOT gone").groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min(F.struct("turn", "row"))["row"].alias("row"))
    marked = rows.join(first.select("row", F.lit(True).alias("first")), "row", "left")
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return marked.withColumn("fault", F.when(~F.col("gone"), fault)).drop("first")


# --- one conversation or chunk -------------------------------------------------------------------


def row_costs(initial: str, fault: str | None, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and state after, of the edits of a row in a state."""
    out = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial in STEP[state]:
            out.append(("K", more, STEP[state][initial]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


#: Edits by (initial, fault, state), for the few there are.
_EDITS = {(i, f, s): row_costs(i, f, s) for i in ("s", "u", "a", "") for f in (None, *FAULTS) for s in range(4)}


def edits_of(initial: str, fault: str | None, state: int) -> list[tuple[str, int, int]]:
    return _EDITS[initial if initial in "sua" else "", fault, state]


def before(after: list[int], initial: str, fault: str | None) -> list[int]:
    """The cost to go from before a row, by state, given that from after it."""
    least = [min(cost + after[to] for _, cost, to in edits_of(initial, fault, s)) for s in range(4)]
    return inserted(least)


def inserted(least: list[int]) -> list[int]:
    """Costs to go where rows may be inserted first. Two inserts lead back to where they began, so one or two do."""
    u = min(least[U], INSERT + least[A])
    a = min(least[A], INSERT + least[U])
    return [min(least[START], INSERT + u), min(least[S], INSERT + u), u, a]


def at_end() -> list[int]:
    return inserted([0 if s in ENDS else FAR for s in range(4)])


def matrix(rows: list[tuple[str, str | None]]) -> list[int]:
    """16 costs: from each state before a chunk to each state right after its last row."""
    by_end = []
    for end in range(4):
        costs = [0 if s == end else FAR for s in range(4)]
        for initial, fault in reversed(rows):
            costs = before(costs, initial, fault)
        by_end.append(costs)
    return [by_end[end][s] for s in range(4) for end in range(4)]


def walk(rows: list[tuple[str, str | None]], after: list[int], state: int, last: bool) -> tuple[str, int]:
    """The letters of the cheapest edits, least in ASCII, and the state they lead to. after: the costs to go from the
    last row on; last: nothing follows, so rows may be inserted at the end."""
    costs = [after]
    for initial, fault in reversed(rows):
        costs.append(before(costs[-1], initial, fault))
    costs.reverse()
    letters = []
    for i in range(len(rows) + 1):
        while True:
            if i == len(rows) and (not last or (state in ENDS and costs[i][state] == 0)):
                break
            now = costs[i][state]
            ways = [("I", INSERT, NEXT[state], costs[i])]
            if i < len(rows):
                ways += [(e, c, to, costs[i + 1]) for e, c, to in edits_of(*rows[i], state)]
            letter, _, state, _ = min((w for w in ways if w[1] + w[3][w[2]] == now), key=lambda w: w[0])
            letters.append(letter)
            if letter != "I":
                break
    return "".join(letters), state


def rebuilt(roles: list[str], texts: list[str], letters: str, state: int) -> list[str]:
    """The repaired rows, as role:text."""
    out, at = [], 0
    for letter in letters:
        if letter == "I":
            out.append(f"{ROLE[state]}:")
            state = NEXT[state]
            continue
        if letter == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = STEP[state][roles[at][:1]]
        elif letter == "R":
            out.append(f"{ROLE[state]}:{texts[at]}")
            state = NEXT[state]
        at += 1
    return out


class Part:
    """What a task has of a conversation: rows in order, and what their neighbours must know."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.roles, self.texts, self.faults, self.turns = [], [], [], []

    def add(self, turn, role: str, text: str, fault: str | None, gone: bool) -> None:
        if not gone:
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.faults.append(fault)

    def rows(self) -> list[tuple[str, str | None]]:
        return [(r[:1], f) for r, f in zip(self.roles, self.faults, strict=True)]

    def summary(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "n": len(self.roles),
            "least": turns[0] if turns else None,
            "most": turns[-1] if turns else None,
            "turns": sum(1 for i, t in enumerate(turns) if not i or t != turns[i - 1]),
            **{f: self.faults.count(f) for f in FAULTS},
            "illegal": sum(1 for a, b in zip(initials, initials[1:]) if a + b not in LEGAL),
            "first": initials[0] if initials else None,
            "last": initials[-1] if initials else None,
        }


def summed(parts: list[dict]) -> dict:
    """The counts of a conversation, from its parts' summaries in order."""
    out = dict.fromkeys((*FAULTS, "illegal"), 0)
    least = most = last = None
    turns = 0
    for p in parts:
        for k in out:
            out[k] += p[k]
        if p["n"]:
            out["illegal"] += last is not None and last + p["first"] not in LEGAL
            last = p["last"]
        if p["least"] is not None:
            turns += p["turns"] - (most is not None and most == p["least"])
            least, most = p["least"] if least is None else least, p["most"]
    return {"gaps": 0 if least is None else most - least + 1 - turns} | out


# --- over all conversations ----------------------------------------------------------------------

COUNTS = ["gaps", *FAULTS, "illegal", "cost"]
SUMMARY = "n bigint, least bigint, most bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string"


def _result(part: Part) -> dict:
    rows = part.rows()
    letters, _ = walk(rows, at_end(), START, last=True)
    costs = at_end()
    for initial, fault in reversed(rows):
        costs = before(costs, initial, fault)
    text = "\n".join(rebuilt(part.roles, part.texts, letters, START))
    return summed([part.summary()]) | {"cost": costs[START], "audit": letters, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _parts(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[Part, bool]]:
    """Conversations as their rows come, and whether all of one is there; longer ones in parts of chunk rows."""
    part, open_part = None, True  # the first conversation may have begun in another task
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "gone")]
        for conv_id, *row in zip(*columns, strict=True):
            if part is None:
                part = Part(conv_id)
            elif part.conv_id != conv_id:
                yield part, not open_part
                part, open_part = Part(conv_id), False
            elif len(part.roles) >= chunk:
                yield part, False
                part, open_part = Part(conv_id), True
            part.add(*row)
    if part is not None:
        yield part, False  # it may go on in the next task


def repaired(rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of rows
    (conv_id, turn, role, text, gone)."""
    chunk = CHUNK if chunk is None else chunk
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    marked = faults(rows)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text"), "row"]
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = marked.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    counts = ", ".join(f"{c} bigint" for c in ("gaps", "c_blank", "c_duplicate", "c_truncated", "c_illegal", "cost"))
    schema = f"conv_id {kind}, {counts}, audit string, repaired_sha256 string, task int, part int, {SUMMARY}, roles array<string>, texts array<string>, faults array<string>"
    fields = [c.split()[0] for c in schema.split(", ")]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, out, weight = TaskContext.get().partitionId(), [], 0
        for number, (part, whole) in enumerate(_parts(batches, chunk)):
            row = dict.fromkeys(fields) | {"conv_id": part.conv_id}
            if whole:
                found = _result(part)
                row |= {(f"c_{k}" if k in FAULTS or k == "illegal" else k): v for k, v in found.items()}
            else:
                row |= part.summary() | {"task": task, "part": number, "roles": part.roles, "texts": part.texts, "faults": part.faults}
                weight += sum(map(len, part.texts))
            out.append(row)
            if len(out) >= BATCH or weight > 8_000_000:
                yield _batch(out, kinds)
                out, weight = [], 0
        if out:
            yield _batch(out, kinds)

    kinds = _arrow(spark, schema)
    done = stored(mapped(dealt, settle, schema), "repairs")
    own = done.filter("task IS NULL").select("conv_id", "gaps", *[F.col(f"c_{c}").alias(c) for c in (*FAULTS, "illegal")], "cost", "audit", "repaired_sha256")
    return own.unionByName(_joined(done.filter("task IS NOT NULL"), kind))


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def _joined(chunks: DataFrame, kind: str) -> DataFrame:
    """Results of the conversations that came in chunks (conv_id, task, part and what a Part has)."""
    spark = chunks.sparkSession
    place = ["conv_id", "task", "part"]
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [matrix([(r[:1], f) for r, f in zip(x["roles"], x["faults"], strict=True)]) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*place, *names]], pa.array(costs, pa.list_(pa.int64()))], names=[*place, *names, "costs"])

    small = mapped(chunks, matrices, f"conv_id {kind}, task int, part int, {SUMMARY}, costs array<bigint>")

    def to_go(frame: pd.DataFrame) -> pd.DataFrame:
        """Of a conversation's chunks, 16 numbers each, the costs to go from their ends; counts and cost in the first."""
        frame = frame.sort_values(["task", "part"])
        after, out = at_end(), []
        for x in reversed(frame.to_dict("records")):
            out.append({c: x[c] for c in place} | {"after": after, "final": not out})
            m = np.array(x["costs"], np.int64).reshape(4, 4)
            after = inserted([min(int(m[s, e]) + out[-1]["after"][e] for e in range(4)) for s in range(4)])
        parts = [{k: (None if v is None or v != v else v) for k, v in x.items()} for x in frame[names].astype(object).to_dict("records")]
        counts = summed(parts) | {"cost": after[START]}
        out[-1] |= {k: int(counts[k]) for k in COUNTS}
        return pd.DataFrame(out, columns=[*place, "after", "final", *COUNTS])

    numbers = ", ".join(f"{c} bigint" for c in COUNTS)
    ahead = stored(small.groupBy("conv_id").applyInPandas(to_go, f"conv_id {kind}, task int, part int, after array<bigint>, final boolean, {numbers}"), "costs")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each state that a chunk may be entered in, its edits and the state they lead to."""
        for batch in batches:
            both = [[walk([(r[:1], f) for r, f in zip(x["roles"], x["faults"], strict=True)], x["after"], s, x["final"]) for s in range(4)] for x in batch.to_pylist()]
            ends = pa.array([[w[1] for w in b] for b in both], pa.list_(pa.int32()))
            letters = pa.array([[w[0] for w in b] for b in both], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in place], ends, letters], names=[*place, "ends", "letters"])

    # (task, part) names a chunk, whatever its conv_id, which may be null.
    met = chunks.join(ahead.drop("conv_id", *COUNTS), ["task", "part"])
    found = stored(mapped(met.select(*place, "roles", "faults", "after", "final"), ways, f"conv_id {kind}, task int, part int, ends array<int>, letters array<string>"), "ways")

    def entered(frame: pd.DataFrame) -> pd.DataFrame:
        """The state in which each of a conversation's chunks is entered."""
        frame, state, states = frame.sort_values(["task", "part"]), START, []
        for ends in frame["ends"]:
            states.append(state)
            state = int(ends[state])
        return frame[place].assign(state=states)

    states = found.select(*place, "ends").groupBy("conv_id").applyInPandas(entered, f"conv_id {kind}, task int, part int, state int")
    chosen = found.join(states.drop("conv_id"), ["task", "part"]).select("task", "part", "state", F.col("letters")[F.col("state")].alias("audit"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.to_pylist()):
                body = rebuilt(x["roles"], x["texts"], x["audit"], x["state"])
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in [*place, "audit"]], pa.array(["\n".join(body) if body else None], pa.string())], names=[*place, "audit", "body"])

    whole = mapped(chunks.drop("audit").join(chosen, ["task", "part"]).select(*place, "roles", "texts", "audit", "state"), texts, f"conv_id {kind}, task int, part int, audit string, body string")
    in_order = whole.repartition("conv_id").sortWithinPartitions(*place)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One chunk after another goes into the hash of its conversation."""
        key, sha, audit, begun = None, None, [], False
        fields = pa.schema([("conv_id", conv), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for batch in batches:
            for conv_id, letters, body in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "body")], strict=True):
                if sha is None or conv_id != key:
                    if sha is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, "".join(audit), sha.hexdigest()), fields, strict=True)], schema=fields)
                    key, sha, audit, begun = conv_id, hashlib.sha256(), [], False
                audit.append(letters)
                if body is not None:
                    sha.update((("\n" if begun else "") + body).encode())
                    begun = True
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, "".join(audit), sha.hexdigest()), fields, strict=True)], schema=fields)

    conv = _arrow(spark, f"conv_id {kind}").field("conv_id").type
    ends = mapped(in_order, hashed, f"conv_id {kind}, audit string, repaired_sha256 string")
    counts = ahead.filter("gaps IS NOT NULL").select(F.col("conv_id").alias("own"), *COUNTS)
    return ends.join(counts, ends["conv_id"].eqNullSafe(counts["own"])).select("conv_id", *COUNTS, "audit", "repaired_sha256")
