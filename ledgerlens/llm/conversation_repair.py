"""Repair of conversations by depth-first branch-and-bound.

A repaired conversation may begin with one system turn; after that user and assistant take turns, user first, and assistant
last. Turns may be kept, given the other role, deleted or inserted, each at a cost; turns that are blank or that repeat an
earlier one must go. Of the cheapest edits those whose initials come first in ASCII order are wanted.

The search has an explicit stack. Prefixes come off it in ASCII order, so of two that reach the same place (turns used up
and state of the grammar) the later one can only be better if it is cheaper: a table of the least cost for each place drops
the others. Lower bounds on what the rest must cost, found from the end backwards, drop prefixes that can't come under the
incumbent (cost and audit); when the stack is empty the incumbent is proved to be best.

Most conversations fit in a task and are solved where they lie. Those with more than ``LARGE_ROWS`` turns or ``LARGE_BYTES``
are cut into blocks that lie on all machines: the costs of each block from state to state combine from the end to lower
bounds at the block's end, searches of each block from each state combine from the start to the state in which the block
begins, and a last search of each block gives its edits. Between blocks only four costs and four states move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .storage import materialise, ship

#: Turns or bytes over which a conversation is cut into blocks.
LARGE_ROWS = 4096
LARGE_BYTES = 32 << 20
#: Turns and bytes of a block.
BLOCK_ROWS = 512
BLOCK_BYTES = 4 << 20

RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INF = float("inf")
SEPARATORS = " \t\n\x0b\x0c\r"
# States: nothing yet, after system, after user, after assistant. What a turn that isn't a system turn leads to from each.
_AFTER = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: Costs of ending in each state, with the turns still to be inserted.
_END = (0, 4, 2, 0)
_LEGAL = {"su", "ua", "au"}


class Turn(NamedTuple):
    """What the search sees of a turn: the initial of its role, whether it must go, whether it is cut short, and how many
    more times it comes directly after itself (those must go too)."""

    initial: str
    must_go: bool
    cut: bool
    more: int = 0


def kept_state(initial: str, state: int) -> int | None:
    """The state after a turn with this initial, or None where the grammar has no room for it."""
    if initial == "s":
        return 1 if state == 0 else None
    return _AFTER[state] if initial == _ROLE[state][0] else None


def lower_bounds(turns: list[Turn], ends: tuple) -> list[tuple]:
    """For each place and state the least cost of what follows, ``ends`` being those after the last turn."""
    out = [tuple(ends)]
    for t in reversed(turns):
        then = out[-1]
        drop, edge = DELETE * (1 + t.more), DELETE * t.more + (TRUNCATED if t.cut else 0)
        own = []
        for s in range(4):
            best = drop + then[s]
            if not t.must_go:
                best = min(best, edge + RETYPE + then[_AFTER[s]])
                k = kept_state(t.initial, s)
                if k is not None:
                    best = min(best, edge + then[k])
            own.append(best)
        two, three = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
        out.append((min(own[0], INSERT + two), min(own[1], INSERT + two), two, three))
    return out[::-1]


def search(turns: list[Turn], entry: int, ends: tuple | None, bounds: Callable[[list[Turn], tuple], list[tuple]] = lower_bounds) -> tuple[float, str, int]:
    """Least cost, audit and last state of the edits of ``turns`` from state ``entry``; an infinite cost where there are none.

    ``ends`` are the costs of what follows the turns, by state; None says that nothing does, and turns may be inserted at
    the end.
    """
    n, last = len(turns), ends is None
    after = _END if last else ends
    least = bounds(turns, after)
    if least[0][entry] == INF:
        return INF, "", entry
    # a first dive along the bounds gives a cost that the best edits can't exceed
    limit = _dive(turns, entry, after, least)
    best: tuple[float, str, int] | None = None
    seen: dict[tuple[int, int], float] = {}
    stack: list[tuple[int, int, float, tuple | None]] = [(0, entry, 0, None)]
    while stack:
        i, s, cost, path = stack.pop()
        if cost + least[i][s] > limit or (best and cost + least[i][s] >= best[0]) or cost >= seen.get((i, s), INF):
            continue
        seen[i, s] = cost
        if i == n and (not last or s in (0, 3)):
            if not best or cost + after[s] < best[0]:
                best = (cost + after[s], _word(path), s)
            continue
        children = []
        if i < n:
            t = turns[i]
            children.append((i + 1, s, cost + DELETE * (1 + t.more), (path, "D" * (1 + t.more))))
        if i < n or last:
            children.append((i, _AFTER[s], cost + INSERT, (path, "I")))
        if i < n and not t.must_go:
            edge, more = cost + DELETE * t.more + (TRUNCATED if t.cut else 0), "D" * t.more
            k = kept_state(t.initial, s)
            if k is not None:
                children.append((i + 1, k, edge, (path, "K" + more)))
            children.append((i + 1, _AFTER[s], edge + RETYPE, (path, "R" + more)))
        stack.extend(reversed(children))
    return best or (INF, "", entry)


def _word(path: tuple | None) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def _dive(turns: list[Turn], s: int, after: tuple, least: list[tuple]) -> float:
    """Cost of the edits found by following the least bound from turn to turn."""
    cost = 0
    for i, t in enumerate(turns):
        then, options = least[i + 1], []
        for inserts in range(3):
            options.append((inserts * INSERT + DELETE * (1 + t.more), s))
            if not t.must_go:
                edge = inserts * INSERT + DELETE * t.more + (TRUNCATED if t.cut else 0)
                options.append((edge + RETYPE, _AFTER[s]))
                k = kept_state(t.initial, s)
                if k is not None:
                    options.append((edge, k))
            s = _AFTER[s]
        step, s = min(options, key=lambda o: o[0] + then[o[1]])
        cost += step
    return cost + after[s]


def edited(turns: list[tuple], audit: str, entry: int) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` for each letter of an audit over ``turns`` of (role, text, initial, more)."""
    s, at = entry, iter([x for x in turns for _ in range(1 + x[3])])
    for edit in audit:
        if edit == "I":
            role, text = _ROLE[s], ""
        else:
            role, text, initial, _ = next(at)
            role = _ROLE[s] if edit == "R" else role
        if edit != "D":
            s = kept_state(initial, s) if edit == "K" else _AFTER[s]
        yield edit, role, text


# What conversations report


def _shape(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether it is cut short."""
    body = text.rstrip(SEPARATORS)
    return not body, bool(body) and body[-1] not in ".!?"


class _Report:
    """Counts of a conversation's faults, fed in order by turns or by whole blocks."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "distinct")

    def __init__(self):
        self.n: dict = dict.fromkeys(self.FIELDS, 0)
        self.first = self.last = self.low = self.high = None

    def turn(self, number: int | None, role: str, text: str, repeated: bool, copies: int) -> Turn:
        blank, cut = _shape(text)
        n = self.n
        if blank:
            n["blank"] += copies
        else:
            n["duplicate"] += copies - 1 + repeated
            n["truncated"] += cut and not repeated
        initial = role[:1]
        self._step(initial, number)
        n["illegal"] += (copies - 1) * (initial * 2 not in _LEGAL)
        return Turn(initial, blank or repeated, cut and not blank and not repeated, copies - 1)

    def _step(self, initial: str, number: int | None, last: str | None = None, low: int | None = None, high: int | None = None) -> None:
        if self.last is not None:
            self.n["illegal"] += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial if last is None else last
        if number is not None:
            self.n["distinct"] += number != self.high
            self.low = number if self.low is None else self.low
            self.high = number if high is None else high

    def block(self, said: dict) -> None:
        """Take over the report of the next block."""
        same = said["low"] is not None and said["low"] == self.high
        before = self.n["distinct"]
        self._step(said["first"], said["low"], said["last"], said["low"], said["high"])
        for f in self.FIELDS:
            self.n[f] += said[f]
        if said["low"] is not None:
            self.n["distinct"] = before + said["distinct"] - same

    def row(self) -> dict:
        gaps = self.high - self.low + 1 - self.n["distinct"] if self.high is not None else 0
        return {"gaps": gaps} | {f: self.n[f] for f in self.FIELDS[:4]}

    def said(self) -> dict:
        return self.n | {"first": self.first, "last": self.last, "low": self.low, "high": self.high}


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SUMMARY = "conv_id {0}, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", audit string, repaired_sha256 string"
_EDITS = "conv_id {0}, part long, seq long, place long, edit string, turn long, role string, text string"


def _grouped(batches: Iterable[pa.RecordBatch], keys: int = 1) -> Iterator[tuple]:
    """Rows of sorted batches with a mark where the first columns change: ``begins, row``."""
    before: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[:keys] != before, row
            before = row[:keys]


def _out(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda r: 1, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _solved(rows: list[tuple]) -> tuple[list[tuple], _Report, list[Turn]]:
    """A whole conversation's (turn, role, text, copies) in order, without those of no copies, merged where they repeat."""
    report, seen, kept, turns = _Report(), set(), [], []
    for number, role, text, copies in rows:
        if copies > 0:
            turn = report.turn(number, role, text, (role, text) in seen, copies)
            seen.add((role, text))
            turns.append(turn)
            kept.append((number, role, text, turn.initial, turn.more))
    return kept, report, turns


def _small(batches: Iterator[pa.RecordBatch], schema: pa.Schema, edits: bool) -> Iterator[pa.RecordBatch]:
    """Conversations that fit in a task: sorted rows ``conv_id, turn, role, text, copies`` in, summaries or edits out."""

    def conversations() -> Iterator[tuple]:
        conv, rows = None, []
        for begins, row in _grouped(batches):
            if begins and rows:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row[1:])
        if rows:
            yield conv, rows

    def results() -> Iterator[tuple]:
        for conv, rows in conversations():
            kept, report, turns = _solved(rows)
            cost, audit, _ = search(turns, 0, None)
            done = list(edited([(r, t, i, m) for _, r, t, i, m in kept], audit, 0))
            if edits:
                yield from ((conv, 0, 0, *x) for x in _numbered(done, kept))
            else:
                body = "\n".join(f"{role}:{text}" for edit, role, text in done if edit != "D")
                yield (conv, *report.row().values(), int(cost), audit, hashlib.sha256(body.encode()).hexdigest())

    return _out(results(), schema, (lambda r: 64 + len(r[-1])) if edits else (lambda r: 64 + len(r[-2])), 1 << 20)


def _numbered(done: list[tuple], kept: list[tuple]) -> Iterator[tuple]:
    """``place, edit, turn, role, text`` of the edits of one conversation or block."""
    numbers = iter([number for number, *_, more in kept for _ in range(1 + more)])
    for place, (edit, role, text) in enumerate(done):
        yield place, edit, None if edit == "I" else next(numbers), role, text


# Large conversations, in blocks

_BLOCK = "conv_id {0}, part long, seq long, initials array<string>, flags array<int>, more array<long>, turns array<long>, texts array<string>, roles array<string>"


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``conv_id, turn, role, text, n, repeated`` to blocks numbered by task and place."""
    part = TaskContext.get().partitionId()

    def blocks() -> Iterator[tuple]:
        rows, size, seq, conv = [], 0, 0, None
        for begins, (c, number, role, text, n, repeated) in _grouped(batches):
            if rows and (begins or len(rows) == BLOCK_ROWS or size > BLOCK_BYTES):
                yield _block(conv, part, seq, rows)
                rows, size, seq = [], 0, seq + 1
            conv = c
            rows.append((number, role, text, n, repeated))
            size += len(text)
        if rows:
            yield _block(conv, part, seq, rows)

    return _out(blocks(), schema, lambda r: sum(map(len, r[7])), BLOCK_BYTES)


def _block(conv, part: int, seq: int, rows: list[tuple]) -> tuple:
    shapes = [_shape(text) for _, _, text, *_ in rows]
    flags = [(blank or repeated) + 2 * (cut and not blank and not repeated) + 4 * repeated for (blank, cut), (*_, repeated) in zip(shapes, rows, strict=True)]
    numbers, roles, texts, n, _ = zip(*rows, strict=True)
    return conv, part, seq, [r[:1] for r in roles], flags, [x - 1 for x in n], list(numbers), list(texts), list(roles)


def _turns(initials: list[str], flags: list[int], more: list[int]) -> list[Turn]:
    return [Turn(i, bool(f & 1), bool(f & 2), m) for i, f, m in zip(initials, flags, more, strict=True)]


def _costs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each block's least costs from state to state."""

    def rows():
        for _, (conv, part, seq, *block) in _grouped(batches):
            turns = _turns(*block)
            by_end = [lower_bounds(turns, tuple(0 if e == s else INF for e in range(4)))[0] for s in range(4)]
            yield conv, part, seq, [by_end[e][s] for s in range(4) for e in range(4)]

    return _out(rows(), schema)


def _backwards(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from the last on: the costs of what follows each; none after the last."""

    def rows():
        then = None
        for begins, (conv, part, seq, costs) in _grouped(batches):
            then = None if begins else then
            yield part, seq, then
            end = then or _END
            own = [min(costs[4 * s + e] + end[e] for e in range(4)) for s in range(4)]
            then = own  # turns inserted at a border count for the block that follows, as its lower bounds do

    return _out(rows(), schema)


def _exits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The state in which each block ends, for each in which it may begin."""

    def rows():
        for _, (conv, part, seq, initials, flags, more, ends) in _grouped(batches):
            turns = _turns(initials, flags, more)
            yield conv, part, seq, ends, [search(turns, s, tuple(ends) if ends else None)[2] for s in range(4)]

    return _out(rows(), schema)


def _forwards(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows():
        state = 0
        for begins, (_, part, seq, ends, exits) in _grouped(batches):
            state = 0 if begins else state
            yield part, seq, ends, state
            state = exits[state]

    return _out(rows(), schema)


def _applied(batches: Iterator[pa.RecordBatch], schema: pa.Schema, edits: bool) -> Iterator[pa.RecordBatch]:
    """Each block's edits from the state in which it begins."""

    def rows():
        for _, (conv, part, seq, initials, flags, more, numbers, texts, roles, ends, entry) in _grouped(batches):
            cost, audit, end = search(_turns(initials, flags, more), entry, tuple(ends) if ends else None)
            kept = list(zip(numbers, roles, texts, initials, more, strict=True))
            done = list(edited([(r, t, i, m) for _, r, t, i, m in kept], audit, entry))
            if edits:
                yield from ((conv, part, seq, *x) for x in _numbered(done, kept))
                continue
            report = _Report()
            for (number, role, text, _, m), f in zip(kept, flags, strict=True):
                report.turn(number, role, text, bool(f & 4), 1 + m)
            said = report.said()
            body = [f"{role}:{text}" for edit, role, text in done if edit != "D"]
            yield conv, part, seq, *(said[f] for f in _SAID), int(cost - (ends[end] if ends else 0)), audit, body

    return _out(rows(), schema, (lambda r: 64 + len(r[-1])) if edits else (lambda r: 64 + sum(map(len, r[-1]))), BLOCK_BYTES)


_SAID = [*_Report.FIELDS, "first", "last", "low", "high"]


def _gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation in order, to its summary; a block at a time is held."""

    def rows():
        conv = report = digest = None
        cost, audit, lines = 0, [], 0

        def done() -> tuple:
            return conv, *report.row().values(), cost, "".join(audit), digest.hexdigest()

        for begins, (c, _part, _seq, *said, spent, word, body) in _grouped(batches):
            if begins:
                if report:
                    yield done()
                conv, report, digest, cost, audit, lines = c, _Report(), hashlib.sha256(), 0, [], 0
            report.block(dict(zip(_SAID, said, strict=True)))
            cost += spent
            audit.append(word)
            for line in body:
                digest.update((b"\n" if lines else b"") + line.encode())
                lines += 1
        if report:
            yield done()

    return _out(rows(), schema, lambda r: 64 + len(r[-2]), 1 << 20)


class _Plan:
    """The steps over ``rows(conv_id, turn, role, text, copies)``, as summaries or as edits."""

    def __init__(self, rows: DataFrame, edits: bool, large_rows: int, large_bytes: int):
        ship(rows.sparkSession)
        self.spark, self.edits, self.kind = rows.sparkSession, edits, rows.schema["conv_id"].dataType.simpleString()
        self.rows = rows
        size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("b"))
        self.large = materialise(size.where((F.col("n") > large_rows) | (F.col("b") > large_bytes)).select(F.col("conv_id").alias("_large")), "large")

    def _map(self, df: DataFrame, f, ddl: str, **more) -> DataFrame:
        ddl = ddl.format(self.kind)
        return df.mapInArrow(partial(f, schema=_arrow(self.spark, ddl), **more), ddl)

    def result(self) -> DataFrame:
        order, same = ["conv_id", "turn", "role", "text"], F.col("conv_id").eqNullSafe(F.col("_large"))
        schema = _EDITS if self.edits else _SUMMARY
        small = self.rows.join(self.large, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order)
        small = self._map(small, _small, schema, edits=self.edits)
        if self.large.isEmpty():
            return small
        return small.unionByName(self._of_large(self.rows.join(self.large, same, "left_semi"), order, schema))

    def _of_large(self, rows: DataFrame, order: list[str], schema: str) -> DataFrame:
        same_text = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "role", "text")]
        merged = rows.where("copies > 0").groupBy(*order).agg(F.sum("copies").alias("n"))
        first = merged.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("f"), F.count("*").alias("k")).where("k > 1")
        marked = merged.alias("a").join(first.alias("b"), same_text, "left").select("a.*", (F.col("b.k").isNotNull() & ~F.col("a.turn").eqNullSafe(F.col("b.f.turn"))).alias("repeated"))
        marked = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "n", "repeated")
        blocks = materialise(self._map(marked, _cut, _BLOCK), "blocks")
        head, at = ["conv_id", "part", "seq"], ["part", "seq"]
        slim = blocks.select(*head, "initials", "flags", "more")
        costs = self._map(slim, _costs, "conv_id {0}, part long, seq long, costs array<double>")
        ends = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
        ends = self._map(ends, _backwards, "part long, seq long, ends array<double>")
        exits = self._map(slim.join(ends, at).select(*head, "initials", "flags", "more", "ends"), _exits, "conv_id {0}, part long, seq long, ends array<double>, exits array<int>")
        entries = exits.repartition("conv_id").sortWithinPartitions(*head)
        entries = materialise(self._map(entries, _forwards, "part long, seq long, ends array<double>, entry int"), "entries")
        ready = blocks.join(entries, at).select(*blocks.columns, "ends", "entry")
        if self.edits:
            return self._map(ready, _applied, schema, edits=True)
        said = ", ".join(f"{c} {'string' if c in ('first', 'last') else 'long'}" for c in _SAID)
        parts = self._map(ready, _applied, f"conv_id {{0}}, part long, seq long, {said}, cost long, audit string, body array<string>", edits=False)
        return self._map(parts.repartition("conv_id").sortWithinPartitions(*head), _gathered, schema)


def _ready(conversations: DataFrame, copies: str | None) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), n.alias("copies"))


def summaries(conversations: DataFrame, copies: str | None = None, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """One row for each conv_id of ``conversations(conv_id, turn, role, text)``: ``conv_id``, counts of faults, cost, audit and
    the SHA-256 of the repaired ``role:text`` lines.

    Turns are taken in order of turn, nulls first; where several have the same turn, of role and text. Null roles and texts
    are one space, so such a text is blank. Rows without conv_id are one conversation. ``copies`` may name a column that
    says how often a row counts; 0 counts not at all, and a conversation of such rows alone has zeros. An empty table
    gives an empty result; other columns aren't looked at. The hash of a whole conversation takes its lines one after the
    other, so in a large one that step alone runs in one task, holding a block at a time.
    """
    return _Plan(_ready(conversations, copies), False, large_rows, large_bytes).result()


def repairs(conversations: DataFrame, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """All edits, a row each: ``conv_id, part, seq, place, edit, turn, role, text``, in order of part, seq and place.

    The repaired conversations are the rows whose ``edit`` isn't D. Conventions as in :func:`summaries`.
    """
    return _Plan(_ready(conversations, None), True, large_rows, large_bytes).result()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows with faults put in by a hash of conversation and turn.

    Of twenty hash classes one is dropped (no copies), one emptied, one loses its sentence marks, one comes twice and one
    gets the role user. Nulls are one space in the hash and in what is damaged.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text: Column = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(fault == 4, "user").otherwise(said("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
