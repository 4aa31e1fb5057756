"""Conversation repair against a search over all edit strings, and the damage against its statement."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from seriesloom.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """``rows``: (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by trying edits in order of cost, then of the string: uniform-cost search over whole strings."""
    fault = faults(rows)
    queue, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, at, made = heapq.heappop(queue)
        initials = "".join(r[:1] or "-" for r, _ in made)  # an empty role is no legal one
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, made
        if (at, made, audit) in done or not any(GRAMMAR.fullmatch(initials + tail) for tail in ("", "u" "a", "a")):
            continue
        done.add((at, made, audit))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", at, (*made, (role, ""))))
        if at < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, made))
            if fault[at] not in ("blank", "duplicate"):
                extra = 5 * (fault[at] == "truncated")
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, (*made, rows[at])))
                for role in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + extra, audit + "R", at + 1, (*made, (role, rows[at][1]))))


def expected(table, damage):
    """Report rows by conversation for (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(name.encode()) % 20 if damage else 9
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
            rows += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        told = [r[1:] for r in rows]
        fault = faults(told)
        cost, audit, made = cheapest(told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), [*made]
    return out


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No", "  ", None, "What?", "Well, so. ", "End!\n", "x"]
    out = []
    for conv in [*range(60), None]:
        for turn in range(int(rng.integers(1, 6))):
            turn = None if rng.random() < 0.08 else turn + int(rng.random() < 0.1)
            out.append((conv, turn, roles[int(rng.choice(6, p=[0.1, 0.35, 0.35, 0.1, 0.05, 0.05]))], texts[int(rng.integers(0, 8))]))
    return out + [(70, 1, "user", "Hi."), (70, 1, "user", "Hi."), (70, 1, "user", "Hi."), (71, None, "user", "Hi."), (72, 0, "system", "S.")]


@pytest.mark.parametrize("damage", [False, True])
def test_repair_equals_search_over_edits(spark, table, damage):
    schema = "conv_id long, turn long, role string, text string, letter int, audit string"
    df = spark.createDataFrame([(*r, 1, "x") for r in table], schema).repartition(4)
    rows = repair.damaged(df) if damage else None
    found = repair.applied(rows, repair.planned(rows)) if damage else repair.repair(df)
    want = expected(table, damage)
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == {c: w[0] for c, w in want.items()}
    turns = repair.applied(rows, repair.planned(rows), True) if damage else repair.repair(df, turns=True)
    made: dict = {c: [] for c in want}
    for r in sorted(turns.collect(), key=lambda r: r.place):
        assert r.place == len(made[r.conv_id])
        made[r.conv_id].append((r.role, r.text))
    assert made == {c: w[1] for c, w in want.items()}


def test_empty_table_and_long_conversations(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    monkeypatch.setattr(repair, "EMIT_LETTERS", 100)
    rows = [(1, k, ("user", "assistant")[k % 2], f"Part {k}.") for k in range(3000)] + [(2, k, "user", "Same.") for k in range(500)]
    found = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, schema)).collect()}
    assert found[1].cost == 0 and found[1].audit == "K" * 3000 and found[1].illegal == 0
    assert found[2].duplicate == 499 and found[2].illegal == 499 and found[2].cost == 2 * 500 and found[2].audit == "D" * 500


def test_shared_suffixes_are_solved_once():
    automaton = repair.SuffixAutomaton()
    words = sorted(w[::-1] for w in ("ua", "sua", "aua", "xua", "uaua", "Uua"))
    solved = {w[::-1]: automaton.solve(w) for w in words}
    assert automaton.solved == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert solved["ua"] == (0, "KK") and solved["sua"] == (0, "KKK") and solved["xua"] == (2, "DKK") and solved["aua"] == (2, "DKK")
