"""Conversation structure repair by depth-first branch and bound.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. A row can be kept, given
another role, or deleted, and empty turns can be inserted. The search walks the rows with an explicit
stack of prefixes of edits. Each rest of the rows has a lower bound for each state of the pattern, a
table keeps for each node (row and state) the cheapest prefix that reached it, and prefixes that are
worse there, or whose cost and bound do not beat the incumbent's cost and audit, go. Children are
pushed so that of equal totals the ASCII-least letter is taken first; so what comes later at the same
cost has a greater audit, and when the stack is empty the incumbent is proved.

Rows are sorted by conversation and turn over range partitions, so a conversation of any length lies
in one or more of them. One that lies within a partition is repaired there. Of one at a partition's
edge, every part is searched from each state to each state, the parts are joined in order, and its
rows follow to be digested as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
WORD = r"[^\x20\x09-\x0D]"
#: Rows of one range partition.
PART_ROWS = 100_000
FAULTS = ("sound", "blank", "duplicate", "truncated")
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The only turn that may be inserted, or that a role can be changed to, in each state.
MADE = tuple("u" if "u" in step else "a" for step in NEXT)
ROLE = {"u": "user", "a": "assistant"}
ENDS = (NOTHING, ASSISTANT)
NEVER = float("inf")

Row = tuple[str, int]  # the role's initial and the fault


def _steps(row: Row | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Letter, cost, rows taken and next state of each edit, in ASCII order of letters."""
    made = NEXT[state][MADE[state]]
    if row is not None:
        yield "D", DELETE, 1, state
    yield "I", INSERT, 0, made
    if row is not None and row[1] not in (BLANK, DUPLICATE):
        cut = CUT if row[1] == TRUNCATED else 0
        if row[0] in NEXT[state]:
            yield "K", cut, 1, NEXT[state][row[0]]
        yield "R", RETYPE + cut, 1, made


def bounds(rows: list[Row], ends: tuple[int, ...]) -> list[list[float]]:
    """For each rest of the rows and each state no more than what it costs to bring it to one of the ends."""
    out = [[NEVER] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        row, own = (rows[i], out[i]) if i < len(rows) else (None, out[i])
        for state in STATES:
            own[state] = 0 if row is None and state in ends else min((cost + out[i + 1][to] for _, cost, taken, to in _steps(row, state) if taken), default=NEVER)
        for state in (USER, ASSISTANT, USER, SYSTEM, NOTHING):  # inserted turns
            own[state] = min(own[state], INSERT + own[NEXT[state][MADE[state]]])
    return out


def search(rows: list[Row], start: int = NOTHING, ends: tuple[int, ...] = ENDS, least: list[list[float]] | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from one state to one of the ends (None: there are none), the ASCII-least of equal cost."""
    least = least or bounds(rows, ends)
    if least[0][start] == NEVER:
        return None
    best, incumbent = NEVER, None
    reached: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, start, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        # what is popped later and costs the same has a greater audit
        if cost + least[i][state] >= best or reached.get((i, state), NEVER) <= cost:
            continue
        reached[i, state] = cost
        del path[max(depth - 1, 0) :]
        if letter:
            path.append(letter)
        row = rows[i] if i < len(rows) else None
        if row is None and state in ends:
            best, incumbent = cost, "".join(path)
            continue
        children = [(cost + c + least[i + taken][to], letter, i + taken, to, cost + c) for letter, c, taken, to in _steps(row, state)]
        children.sort(reverse=True)  # the last is popped first: the least total, then the least letter
        stack += [(to_row, to, c, depth + 1, letter) for total, letter, to_row, to, c in children if total < best]
    return best, incumbent


def edited(rows: list[tuple[str, str]], audit: str, state: int = NOTHING) -> tuple[list[tuple[str, str]], int]:
    """Role and text of each repaired turn, and the state at the end."""
    out, at = [], iter(rows)
    for letter in audit:
        if letter == "I":
            role, text = ROLE[MADE[state]], ""
        else:
            role, text = next(at)
            if letter == "D":
                continue
            if letter == "R":
                role = ROLE[MADE[state]]
        out.append((role, text))
        state = NEXT[state][role[:1]]
    return out, state


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the faults that crc32 of conv_id:turn plants; nulls in the key, role and text count as one space.

    Of 20 remainders, 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it and 4
    makes it a user's.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Distinct rows with how often they stand (n), their fault if they are the first of their kind, and fresh: does an equal turn stand before?

    Sorted by conv_id and turn (nulls first), role and a digest of the text, over range partitions.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.md5("text"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    scratch = Scratch(conversations.sparkSession, "dialogue")
    rows = scratch.save(rows, "rows")
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"), F.col("first.turn").alias("first_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    fresh = F.col("of_digest").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))
    rows_of = rows.join(first, same, "left").select("conv_id", "turn", "role", "digest", "text", "n", fault.alias("fault"), fresh.alias("fresh"))
    partitions = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    order = ["conv_id", "turn", "role", "digest"]
    return rows_of.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


class Part:
    """Rows of one conversation in one partition, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.texts, self.turns = conv_id, [], [], []

    def add(self, turn: int | None, role: str, text: str, n: int, fault: int, fresh: bool) -> None:
        for k in range(n):
            self.rows.append((role[:1], fault if fault == BLANK or (fresh and not k) else DUPLICATE))
            self.texts.append((role, text))
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def facts(self) -> dict:
        initials = "".join(x or " " for x, _ in self.rows)
        pairs = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        faults = [f for _, f in self.rows]
        ends = (self.turns[0], self.turns[-1], len(self.turns)) if self.turns else (None, None, 0)
        return dict(zip(_FACTS, (*ends, *(faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), pairs, initials[0], initials[-1]), strict=True))


_FACTS = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last"]


def joined(parts: list[dict]) -> dict:
    """The facts of parts that follow each other, as those of one."""
    out = dict(parts[0])
    for p in parts[1:]:
        if p["low"] is not None:
            out["turns"] += p["turns"] - (out["high"] == p["low"])
            out["low"] = p["low"] if out["low"] is None else out["low"]
            out["high"] = p["high"]
        for k in ("blank", "duplicate", "truncated", "illegal"):
            out[k] += p[k]
        out["illegal"] += out["last"] + p["first"] not in ("su", "ua", "au")
        out["last"] = p["last"]
    return out


def _result(facts: dict, cost: int, audit: str) -> tuple:
    gaps = facts["high"] - facts["low"] + 1 - facts["turns"] if facts["turns"] else 0
    return gaps, facts["blank"], facts["duplicate"], facts["truncated"], facts["illegal"], cost, audit


#: What a row of the first pass is: a repaired conversation, a part of one, a row of such a part.
DONE, PART, TURN = range(3)
_FIRST = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
    *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("digest", pa.string()),
    *((c, pa.int64()) for c in ("low", "high", "turns")), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])
_FIRST_SQL = (
    "kind int, conv_id long, part int, place long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, digest string, low long, high long, turns long, first string, last string, costs array<bigint>, audits array<string>"
)
_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def digest_of(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def _first_pass(batches: Iterator[pa.RecordBatch], as_turns: bool = False) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()

    def whole(p: Part) -> list[dict]:
        cost, audit = search(p.rows)
        turns = edited(p.texts, audit)[0]
        if as_turns:
            return [{"kind": DONE, "conv_id": p.conv_id, "place": i, "role": role, "text": text} for i, (role, text) in enumerate(turns)]
        return [dict(zip(_RESULT, _result(p.facts(), cost, audit), strict=True), kind=DONE, conv_id=p.conv_id, digest=digest_of(turns))]

    def at_edge(p: Part) -> list[dict]:
        least = [bounds(p.rows, (end,)) for end in STATES]
        found = [search(p.rows, start, (end,), least[end]) or (None, None) for start in STATES for end in STATES]
        own = {"conv_id": p.conv_id, "part": number}
        turns = [{"kind": TURN, **own, "place": i, "role": role, "text": text} for i, (role, text) in enumerate(p.texts)]
        return [{"kind": PART, **own, **p.facts(), "costs": [c for c, _ in found], "audits": [a for _, a in found]}, *turns]

    now, first, out = None, True, []
    for b in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out += (at_edge if first else whole)(now)
                    first = False
                now = Part(conv_id)
            now.add(*row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FIRST)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist(at_edge(now), schema=_FIRST)


def _grouped(batches: Iterator[pa.RecordBatch], each: Callable[[list[dict]], Iterator[dict]]) -> Iterator[dict]:
    """each of the rows of one conversation, which come one after another."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and rows[-1]["conv_id"] != r["conv_id"]:
                yield from each(rows)
                rows = []
            rows.append(r)
    if rows:
        yield from each(rows)


def chained(parts: list[dict]) -> tuple[int, list[tuple[str, int]]]:
    """The cheapest way through parts that follow each other: its cost, and each part's audit and state at its start.

    Of two ways to one state at one cost, neither audit begins with the other, as each has a letter
    for every row; so what follows does not change which is less.
    """
    ways: dict[int, tuple[int, str, list]] = {NOTHING: (0, "", [])}
    for p in parts:
        new: dict[int, tuple[int, str, list]] = {}
        for start, (cost, audit, back) in ways.items():
            for end in STATES:
                c, a = p["costs"][4 * start + end], p["audits"][4 * start + end]
                if c is not None and (end not in new or (cost + c, audit + a) < new[end][:2]):
                    new[end] = (cost + c, audit + a, [back, (a, start)])
        ways = new
    cost, _, back = min((ways[end] for end in ENDS if end in ways), key=lambda w: w[:2])
    steps = []
    while back:
        back, step = back
        steps.append(step)
    return cost, steps[::-1]


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts to results: a DONE row for each conversation without a digest, and a PART row with the audit and the state (place) of each part."""

    def one(parts: list[dict]) -> Iterator[dict]:
        cost, steps = chained(parts)
        for p, (audit, start) in zip(parts, steps, strict=True):
            yield {"kind": PART, "conv_id": p["conv_id"], "part": p["part"], "place": start, "audit": audit}
        yield dict(zip(_RESULT, _result(joined(parts), cost, "".join(a for a, _ in steps)), strict=True), kind=DONE, conv_id=parts[0]["conv_id"])

    for r in _grouped(batches, one):
        yield pa.RecordBatch.from_pylist([r], schema=_FIRST)


_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("digest", pa.string())])


def _third_pass(batches: Iterator[pa.RecordBatch], as_turns: bool = False) -> Iterator[pa.RecordBatch]:
    """The repaired turns, or conv_id and their digest, from each part's audit (place -1) and its rows, in order, as a stream."""
    now, sha, done, letters, state = object(), None, 0, iter(""), NOTHING
    made: list[dict] = []

    def put(turns: list[tuple[str, str]]) -> None:
        nonlocal done
        for role, text in turns:
            if as_turns:
                made.append({"conv_id": now, "place": done, "role": role, "text": text})
            else:
                sha.update(f"{chr(10) * (done > 0)}{role}:{text}".encode())
            done += 1

    def inserted() -> str:
        """Make the turns to be inserted here; the next letter that is for a row, or none."""
        nonlocal state
        for x in letters:
            if x != "I":
                return x
            turns, state = edited([], "I", state)
            put(turns)
        return ""

    for b in batches:
        for conv_id, place, role, text, audit, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if place < 0:  # a part begins
                inserted()
                if conv_id != now:
                    if sha is not None and not as_turns:
                        made.append({"conv_id": now, "digest": sha.hexdigest()})
                    now, sha, done = conv_id, hashlib.sha256(), 0
                letters, state = iter(audit), start
            else:
                turns, state = edited([(role, text)], inserted(), state)
                put(turns)
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=_TURNS if as_turns else _DIGESTS)
            made.clear()
    if sha is not None:
        inserted()
        if not as_turns:
            made.append({"conv_id": now, "digest": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(made, schema=_TURNS if as_turns else _DIGESTS)


def _passes(conversations: DataFrame, as_turns: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is done after the first pass, what after the second, and the third."""
    session = conversations.sparkSession
    scratch = Scratch(session, "dialogue")
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    made = _ordered(conversations).select("conv_id", "turn", "role", "text", "n", "fault", "fresh").mapInArrow(lambda b: _first_pass(b, as_turns), _FIRST_SQL)
    made = scratch.save(made, "first")
    parts = made.filter(F.col("kind") == PART).repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "part")
    chosen = scratch.save(parts.mapInArrow(_second_pass, _FIRST_SQL), "second")
    heads = chosen.filter(F.col("kind") == PART).select("conv_id", "part", F.lit(-1).cast("long").alias("place"), "role", "text", "audit", F.col("place").alias("start"))
    turns = made.filter(F.col("kind") == TURN).select("conv_id", "part", "place", "role", "text", "audit", F.lit(None).cast("long").alias("start"))
    streamed = heads.union(turns).repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "place", "role", "text", "audit", "start")
    last = streamed.mapInArrow(lambda b: _third_pass(b, as_turns), "conv_id long, place long, role string, text string" if as_turns else "conv_id long, digest string")
    return made.filter(F.col("kind") == DONE), chosen.filter(F.col("kind") == DONE), last


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for every conversation.

    Rows count by turn, nulls first, and rows of one turn by role and then by md5 of the text; equal
    rows each for itself. Null roles and texts count as one space, and a null conv_id is a
    conversation. A row's first fault counts: blank, duplicate (role and text stand earlier),
    truncated. Keeping costs 0, another role 3, deletion (which blank and duplicate rows need) 4, an
    inserted turn 3, and a truncated row that stays 3 more. An empty table gives an empty result;
    other columns are not read.
    """
    first, second, digests = _passes(conversations, False)
    digests = digests.select(F.col("conv_id").alias("of"), F.col("digest").alias("found"))
    at_edges = second.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", *_RESULT, F.col("found").alias("digest"))
    return first.select("conv_id", *_RESULT, "digest").union(at_edges).withColumnRenamed("digest", "repaired_sha256")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of every turn of the repaired conversations. For the rest see repair."""
    first, _, last = _passes(conversations, True)
    return first.select("conv_id", "place", "role", "text").union(last)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """What repair says of the damaged rows, for every conv_id of the table; one that lost all its rows has zeros, an empty audit and the digest of nothing."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "of")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [*_RESULT, "repaired_sha256"]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *(F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in columns))


