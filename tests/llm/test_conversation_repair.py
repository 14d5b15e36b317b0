"""Repair of conversations by branch-and-bound."""

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest

from ledgerlens.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
GOOD = re.compile(r"(s?(ua)+)?")


def best_edits(rows):
    """Cheapest audit and repaired lines over (role, text, fault), by trying all roles that a regular expression allows.

    Works on whole strings of initials: from each row and each string that can still become good, all edits.
    """

    def alive(x):
        return GOOD.fullmatch(x) is not None or GOOD.fullmatch(x + "a") is not None or x == "s"

    def short(x):
        return x if len(x) < 3 else ("s" if x[0] == "s" else "") + ("ua" if x[-1] == "a" else "uau")

    @cache
    def rest(i, done, inserted):
        found = []
        if i == len(rows) and GOOD.fullmatch(done):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if alive(done + role[0]):
                    found.append(step(rest(i, short(done + role[0]), inserted + 1), 2, "I", (f"{role}:",)))
        if i < len(rows):
            role, text, fault = rows[i]
            found.append(step(rest(i + 1, done, 0), 3, "D", ()))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault == "truncated" else 0
                if alive(done + role[:1]) and role[:1]:
                    found.append(step(rest(i + 1, short(done + role[:1]), 0), extra, "K", (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    if alive(done + new[0]):
                        found.append(step(rest(i + 1, short(done + new[0]), 0), 2 + extra, "R", (f"{new}:{text}",)))
        found = [f for f in found if f]
        return min(found) if found else None

    def step(then, cost, edit, line):
        return then and (then[0] + cost, edit + then[1], line + then[2])

    return rest(0, "", 0)


def brute(rows):
    """From the rows after damage (turn, role, text) in order."""
    faulty, seen = [], set()
    n = dict.fromkeys(["blank", "duplicate", "truncated"], 0)
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faulty.append((role, text, fault))
        if fault:
            n[fault] += 1
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = best_edits(faulty)
    return gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def after_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        said = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def wanted(rows, damage=True):
    by = {r[0]: [] for r in rows}
    for conv, *row in after_damage(rows) if damage else [r[:4] for r in rows]:
        by[conv].append(tuple(row))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((c, *brute(sorted(x, key=key))) for c, x in by.items()), key=str)


def made(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randrange(1, 12)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rnd.choice(["Yes.", "No!", "Well", "", " \t", None, f"Text {turn}.", f"é {turn}?", "same."])
            rows.append((conv - 3, rnd.choice([turn, turn, turn, turn * 2, None]), role, text, "x"))
    return rows + [(None, t, r, "Hi.", "x") for t, r in [(1, "user"), (2, "assistant"), (None, "system"), (2, "assistant"), (5, None)]]


@pytest.mark.parametrize("options", [{}, {"large_rows": 2}, {"large_rows": 0}, {"large_bytes": 20}])
def test_damaged_conversations_equal_brute_force(spark, options):
    rows = made(7)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = C.summaries(C.damaged(frame), "copies", **options)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted(rows)


def test_whole_table(spark, tiny):
    from ledgerlens.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_conversation_repair"](spark, tiny).collect()), key=str)
    assert got == wanted(rows)


def test_empty_table(spark):
    assert C.summaries(spark.createDataFrame([], SCHEMA)).count() == 0


def long_conversation(n, seed=3):
    rnd = random.Random(seed)
    return [(1, i // 2 if i % 50 == 0 else i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([f"t{i}.", f"t{i}", "again.", ""]), "x") for i in range(n)]


def test_blocks_equal_one_piece(spark, monkeypatch):
    """A conversation of 3,000 turns, in blocks of 512 (what tasks use) and in one piece."""
    rows = long_conversation(3000) + [(2, 1, "user", "same.", "x")] * 2000 + [(2, 2, "assistant", "ok.", "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    whole = {r.conv_id: r for r in C.summaries(frame).collect()}
    parts = {r.conv_id: r for r in C.summaries(frame, large_rows=100).collect()}
    assert whole == parts
    assert whole[2].audit == "K" + "D" * 1999 + "K"
    edits = C.repairs(frame, large_rows=100).orderBy("conv_id", "part", "seq", "place").collect()
    assert len({(e.part, e.seq) for e in edits if e.conv_id == 1}) > 4
    for c in (1, 2):
        own = [e for e in edits if e.conv_id == c]
        assert "".join(e.edit for e in own) == whole[c].audit
        body = "\n".join(f"{e.role}:{e.text}" for e in own if e.edit != "D")
        assert hashlib.sha256(body.encode()).hexdigest() == whole[c].repaired_sha256
        small = [e for e in C.repairs(frame).orderBy("conv_id", "place").collect() if e.conv_id == c]
        assert [(e.edit, e.turn, e.role, e.text) for e in small] == [(e.edit, e.turn, e.role, e.text) for e in own]


def bounds_by_turn(turns: list[C.Turn], ends: tuple) -> list[tuple]:
    """Weaker bounds that look at each turn by itself; the search must come to the same end with them, only later."""
    out, total = [tuple(min(ends) for _ in range(4))], min(ends)
    for t in reversed(turns):
        total += C.DELETE * t.more + (C.DELETE if t.must_go else (C.TRUNCATED if t.cut else 0) + (0 if t.initial in ("s", "u", "a") else C.RETYPE))
        total -= max(0, (C.TRUNCATED if t.cut else 0) + C.RETYPE - C.DELETE) if not t.must_go and t.initial not in ("s", "u", "a") else 0
        out.append((total,) * 4)
    return out[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_search_doesn_t_depend_on_its_bounds(seed):
    """With weaker bounds the search backtracks, and ends with the same cost and audit."""
    rnd = random.Random(seed)
    for _ in range(150):
        turns = [C.Turn(rnd.choice("suatx"), rnd.random() < 0.2, False) for _ in range(rnd.randrange(0, 9))]
        turns = [t._replace(cut=not t.must_go and rnd.random() < 0.3, more=rnd.choice([0, 0, 0, 1])) for t in turns]
        for ends in (None, (0, 5, 1, 3)):
            for entry in range(4):
                assert C.search(turns, entry, ends) == C.search(turns, entry, ends, bounds_by_turn)
                assert C.search(turns, entry, ends)[0] == C.lower_bounds(turns, ends or C._END)[0][entry]


def test_all_short_conversations():
    """Every conversation of up to four turns over four initials and three faults."""
    texts = {None: "ok.", "truncated": "cut", "blank": ""}
    for n in range(4):
        for kinds in product([("user", None), ("user", "truncated"), ("assistant", None), ("assistant", "blank"), ("system", None), ("tool", None)], repeat=n):
            rows = [(i, r, texts[f] and f"{i}{texts[f]}") for i, (r, f) in enumerate(kinds)]
            kept, report, turns = C._solved([(*r, 1) for r in rows])
            cost, audit, _ = C.search(turns, 0, None)
            body = "\n".join(f"{r}:{t}" for e, r, t in C.edited([(r, t, i, m) for _, r, t, i, m in kept], audit, 0) if e != "D")
            assert (*report.row().values(), cost, audit, hashlib.sha256(body.encode()).hexdigest()) == brute(rows)
