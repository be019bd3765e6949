"""Repair of conversation structure: the cheapest edits, found by iterative-deepening A*.

A conversation should read as ``(s?(ua)+)?`` in the first letters of its roles.  Rows are
kept (0), given the other role (2), deleted (3), and empty user or assistant rows are
inserted (2); blank and duplicate rows must go, and a truncated row that stays costs 1 more.

The search runs depth first over the rows in the letters' ASCII order (Delete, Insert,
Keep, Rerole) under a cost bound that grows by one until a path is accepted, so the
first accepted path is the cheapest and, of equals, the ASCII-least.  States that
failed with some budget are kept for all later bounds.  The bound on what is left
counts truncated rows and role pairs that cannot stay side by side: each edit pays at
least what it can mend.

A conversation of more than ``WINDOW`` rows is searched in windows, the last one first,
from each role that can come before one, with the later window's costs at its end; so the
time grows with its length.  Only a byte or so for each row is held of a conversation:
its texts pass through, sorted by Spark, once for the flags and once for the repair.  Its
edits are one string and its text one hash, so one task sees a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.functions.staging import stage
from tabwise.llm.common import table

DELETE, INSERT, REROLE, SHORT = 3, 2, 2, 1
EDITS = "DIKR"
#: Live rows that one search looks at.
WINDOW = 512
SPACE = " \t\n\x0b\x0c\r"

# Roles seen so far: 0 none, 1 system, 2 user, 3 assistant.  First letters of a row's
# role: 0 s, 1 u, 2 a, 3 any other.
_LETTERS = "sua"
_NEXT = (2, 2, 3, 2)
_KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_ROLES = {2: "user", 3: "assistant"}
#: Inserts that complete a conversation, by the last role, and their costs.
_CLOSING = ("", "II", "I", "")
#: What stands in a flag byte: the letter, and whether the row must go or is truncated.
_GONE, _SHORT = 4, 8


def _legal(first: int, second: int) -> bool:
    return (first, second) in ((0, 1), (1, 2), (2, 1))


def search(codes: Sequence[int], short: Sequence[int], before: int, exits: Sequence[int]) -> tuple[int, str]:
    """The least cost and the ASCII-least edits of rows after the role ``before``.

    ``codes`` are the rows' first letters and ``short`` 1 for truncated rows; ``exits``
    is what each last role costs after them.
    """
    n = len(codes)
    if not n:
        return exits[before], ""
    left = [0] * (n + 1)
    left[n - 1] = short[n - 1] + min(exits)
    for i in range(n - 2, -1, -1):
        left[i] = left[i + 1] + short[i] + (not _legal(codes[i], codes[i + 1]))
    failed: dict[int, int] = {}
    bound = left[0] + (_KEPT[before][codes[0]] < 0)
    while True:
        nodes, budgets, turns = [before], [bound], [0]  # a node is 4 * row + last role
        path: list[int] = []
        while nodes:
            node, budget, turn = nodes[-1], budgets[-1], turns[-1]
            if turn == 4:
                failed[node] = max(budget, failed.get(node, -1))
                nodes.pop(), budgets.pop(), turns.pop()
                if path:
                    path.pop()
                continue
            turns[-1] = turn + 1
            i, role = node >> 2, node & 3
            if turn == 0:
                i, rest = i + 1, budget - DELETE
            elif turn == 1:
                role, rest = _NEXT[role], budget - INSERT
            elif turn == 2:
                role, rest = _KEPT[role][codes[i]], budget - short[i]
                if role < 0:
                    continue
                i += 1
            else:
                role, rest = _NEXT[role], budget - REROLE - short[i]
                i += 1
            if i == n:
                if rest >= exits[role]:
                    return bound, "".join(EDITS[k] for k in [*path, turn])
                continue
            if rest < left[i] + (_KEPT[role][codes[i]] < 0):
                continue
            node = 4 * i + role
            if failed.get(node, -1) >= rest:
                continue
            nodes.append(node), budgets.append(rest), turns.append(0), path.append(turn)
        bound += 1


def _role_after(letters: str, codes: Sequence[int], role: int) -> int:
    i = 0
    for edit in letters:
        if edit == "K":
            role = _KEPT[role][codes[i]]
        elif edit != "D":
            role = _NEXT[role]
        i += edit != "I"
    return role


def cheapest_edits(flags: bytes) -> tuple[int, str]:
    """Cost and edits of a conversation, a flag byte for each row in order."""
    live = [f for f in flags if not f & _GONE]
    codes, short = [f & 3 for f in live], [f >> 3 for f in live]
    exits: Sequence[int] = [INSERT * len(c) for c in _CLOSING]
    found = []
    for start in range((len(live) - 1) // WINDOW * WINDOW if live else 0, -1, -WINDOW):
        end = start + WINDOW
        found.append([search(codes[start:end], short[start:end], role, exits) for role in (range(4) if start else (0,))])
        exits = [cost for cost, _ in found[-1]]
    cost = exits[0] + DELETE * (len(flags) - len(live))
    role, letters = 0, []
    for k, options in enumerate(reversed(found)):
        letters.append(options[role][1])
        role = _role_after(letters[-1], codes[k * WINDOW : (k + 1) * WINDOW], role)
    # Rows that must go are deleted as soon as they come: an insert before such a row
    # costs the same after it, and D comes before I.
    steps, audit = iter("".join(letters)), []
    for flag in flags:
        edit = "D" if flag & _GONE else next(steps)
        while edit == "I":
            audit.append(edit)
            edit = next(steps)
        audit.append(edit)
    return cost, "".join(audit) + _CLOSING[role]


# --- conversations as tables -------------------------------------------------

ORDER = ["conv_id", "turn", "role", "digest", "nth"]
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _rows(conversations: DataFrame) -> DataFrame:
    """The rows the operator works on; a null role or text is one space."""
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.md5(text).alias("digest"), present.alias("present"),
    )


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first; of one turn, by role and a digest of the text,
    equal rows side by side.  Nulls of conv_id make one conversation.  Only the first
    fault of a row counts: blank (no character but white space), duplicate (role and text
    of an earlier row), truncated (its last such character is none of .!?).  ``gaps`` is
    how many turns are missing between the least and the largest.  ``illegal`` counts
    neighbours whose roles' first letters are not su, ua or au.  Rows whose column
    ``present``, if there is one, is false only name their conversation; one without
    other rows has zeros and no edits.  Other columns are ignored.
    """
    slim = _rows(conversations).where("present is not null").withColumn("end", F.rtrim("text", F.lit(SPACE)))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "present").orderBy("turn"))
    letter = F.position(F.substring("role", 1, 1), F.lit(_LETTERS)) - 1
    known = F.substring("role", 1, 1).isin(*_LETTERS)
    ends = F.substring("end", -1, 1).isin(".", "!", "?")
    slim = slim.select(
        "conv_id", "turn", "role", "digest", "present", F.when(known, letter).otherwise(3).alias("letter"),
        (F.length("end") == 0).alias("is_blank"), ends.alias("ends"),
    )
    # The window's groups lie within the conversations' partitions: one shuffle for both.
    rows = slim.repartition("conv_id").withColumn("nth", nth).sortWithinPartitions(*ORDER)
    fault = F.when(F.col("is_blank"), 1).when(F.col("nth") > 1, 2).when(~F.col("ends"), 3).otherwise(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, False
        out: list[tuple] = []
        flags, faults, turns, illegal = bytearray(), [0] * 4, [0, None, None], 0

        def close() -> None:
            cost, audit = cheapest_edits(bytes(flags))
            n, low, high = turns
            out.append((key, high - low + 1 - n if n else 0, *faults[1:], illegal, cost, audit))

        for batch in batches:
            for conv, turn, code, fault_, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or conv != key:
                    if open_:
                        close()
                    key, open_ = conv, True
                    flags, faults, turns, illegal = bytearray(), [0] * 4, [0, None, None], 0
                if not there:
                    continue
                if turn is not None and turn != turns[2]:
                    turns = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
                if flags and not _legal(flags[-1] & 3, code):
                    illegal += 1
                faults[fault_] += 1
                flags.append(code | (_GONE if fault_ in (1, 2) else _SHORT if fault_ == 3 else 0))
            if out:
                yield _batch(out, _PLAN_KINDS, _PLAN_NAMES)
                out.clear()
        if open_:
            close()
            yield _batch(out, _PLAN_KINDS, _PLAN_NAMES)

    return rows.select("conv_id", "turn", "letter", fault.alias("fault"), "present").mapInArrow(run, PLAN)


_PLAN_NAMES = [part.split(" ")[0] for part in PLAN.split(", ")]
_PLAN_KINDS = [pa.int64()] * 7 + [pa.string()]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) in order, and (conv_id, None, None, None) after each conversation.

    The batches hold each conversation's edits, then its rows."""
    conv, steps, last = None, None, 0

    def finish() -> Iterator[tuple]:
        nonlocal last
        for _ in steps:  # only inserts are left
            last = _NEXT[last]
            yield conv, "I", _ROLES[last], ""
        yield conv, None, None, None

    for batch in batches:
        for key, audit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if audit is not None:
                if steps is not None:
                    yield from finish()
                conv, steps, last = key, iter(audit), 0
                continue
            for edit in steps:
                if edit == "I":
                    last = _NEXT[last]
                    yield conv, "I", _ROLES[last], ""
                    continue
                if edit == "K":
                    last = _KEPT[last][_LETTERS.find(role[:1])]
                    yield conv, "K", role, text
                elif edit == "R":
                    last = _NEXT[last]
                    yield conv, "R", _ROLES[last], text
                break
    if steps is not None:
        yield from finish()


def _with_plans(conversations: DataFrame, plans: DataFrame, run: Callable, schema: str) -> DataFrame:
    rows = _rows(conversations).where("present").drop("present")
    empty = F.lit(None)
    edits = plans.select("conv_id", "audit", empty.cast("long").alias("turn"), *[empty.cast("string").alias(c) for c in ("role", "text", "digest")])
    both = edits.withColumn("side", F.lit(0)).unionByName(rows.withColumns({"audit": empty.cast("string"), "side": F.lit(1)}))
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "digest")
    return placed.select("conv_id", "audit", "role", "text").mapInArrow(run, schema)


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (I, K or R), role, text."""
    names = ["conv_id", "place", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, place = [], 0, 0
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                place = 0
                continue
            out.append((conv, place, edit, role, text))
            place, size = place + 1, size + len(text) + 50
            if size > 1 << 22:
                yield _batch(out, kinds, names)
                out, size = [], 0
        if out:
            yield _batch(out, kinds, names)

    return _with_plans(conversations, plans, run, "conv_id long, place long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of ``role:text`` of the repaired rows, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, first = [], hashlib.sha256(), True
        for conv, edit, role, text in _edited(batches):
            if edit is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
                continue
            out.append((conv, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) == 10_000:
                yield _batch(out, [pa.int64(), pa.string()], ["conv_id", "repaired_sha256"])
                out = []
        if out:
            yield _batch(out, [pa.int64(), pa.string()], ["conv_id", "repaired_sha256"])

    return _with_plans(conversations, plans, run, "conv_id long, repaired_sha256 string")


# --- the query ---------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped (``present`` false), emptied, stripped of .!?, repeated or made the
    user's, by a checksum of conversation and turn; nulls are one space."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            (F.col("kind") > 0).alias("present"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    plans = stage(plan_repairs(rows), "repair-plans")
    digests = repaired_digests(rows, plans)
    return plans.join(digests, plans["conv_id"].eqNullSafe(digests["conv_id"])).select(plans["*"], "repaired_sha256")
