"""Conversation repair against an exhaustive search and plain code."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tabwise.llm import conversations as C


def plain_edits(rows):
    """(cost, audit) over (letter, must go, truncated) rows: cheapest first, then ASCII-least."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        new = follows[-1]
        steps = [(2, "I", i, new)]
        if i < len(rows):
            letter, gone, short = rows[i]
            steps.append((3, "D", i + 1, last))
            if not gone:
                steps.append((2 + short, "R", i + 1, new))
                if letter and letter in follows:
                    steps.append((short, "K", i + 1, letter))
        for more, edit, at, role in steps:
            heapq.heappush(heap, (cost + more, audit + edit, at, role))


def flags_of(rows):
    return bytes("sua".find(a) % 4 | (C._GONE if gone else C._SHORT if short else 0) for a, gone, short in rows)


@pytest.mark.parametrize("window", [512, 5, 1])
def test_edits_are_the_cheapest_and_least(monkeypatch, window):
    monkeypatch.setattr(C, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(1500):
        rows = [(rng.choice("suauauat"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(11))]
        rows = [(a, gone, short and not gone) for a, gone, short in rows]
        assert C.cheapest_edits(flags_of(rows)) == plain_edits(rows)


def test_long_conversation_in_windows():
    rng = random.Random(4)
    rows = [("ua"[k % 2], False, rng.random() < 0.1) for k in range(3000) if rng.random() > 0.05]
    cost, audit = C.cheapest_edits(flags_of(rows))
    assert cost == plain_edits(rows)[0] and audit == plain_edits(rows)[1]


def plain(rows):
    """The whole contract for (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(text.encode()).hexdigest(), text, turn)
        out[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = {}
    for conv, found in out.items():
        found.sort()
        seen, faults, flags = set(), [], []
        for *_, role, _, text, _ in found:
            body = text.strip(C.SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            flags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain_edits(flags)
        last, lines, rest = "", [], iter(found)
        for edit in audit:
            if edit == "D":
                next(rest)
                continue
            _, _, role, _, text, _ = next(rest) if edit != "I" else (0, 0, "", "", "", 0)
            role = role if edit == "K" else {"u": "assistant"}.get(last, "user")
            last = role[0]
            lines.append(f"{role}:{text}")
        turns = {r[-1] for r in found if r[-1] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:], strict=False))
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
                        illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_against_plain_code(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello there.", "Why? \n", "no end", None, "", " \t\n", f"t{rng.random()}!", "é" * 40 + "."])
            rows += [(conv, rng.choice([turn, turn, None]), role, text)] * rng.choice([1, 1, 1, 2])
    rows += [(500, k, "ua"[k % 2] and ("user", "assistant")[k % 2], f"x{k}.") for k in range(1500)]
    rows += [(501, 3, "user", "long. " * 50_000), *[(502, 1, "user", "same.")] * 40]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "x."))
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, digest string, nth int")
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = C.plan_repairs(frame)
    assert [(r["cost"], r["audit"]) for r in plans.collect()] == [(3, "KIKK")]
    turns = sorted(tuple(r) for r in C.repaired_turns(frame, plans).collect())
    assert turns == [(1, 0, "K", "user", "a."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "b."), (1, 3, "K", "assistant", "c")]
    empty = frame.limit(0)
    assert C.plan_repairs(empty).count() == 0 and C.repaired_turns(empty, C.plan_repairs(empty)).count() == 0
    assert C.plan_repairs(empty).columns[0] == "conv_id"
