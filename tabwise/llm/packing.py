"""Packing of token pieces into sequences: linear grouping, then best fit.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces
have each length, and its size depends on the capacity alone:

1. Large pieces, longest first, are cut into groups of equally many; each counts as
   long as its group's longest.  With these few sizes the mixes that fill a sequence
   (configurations) are optimised by a linear programme with column generation.
2. The real pieces take the places.  Runs of sequences with equal contents follow from
   the counts, and with them the room that the true lengths leave.
3. The pieces left over and the small ones go, longest first, each where it leaves the
   least room.  Sequences with equal room and pieces of equal length are handled
   together, so this too works on counts.  Sequences whose room is too small for usual
   small pieces may be undone first; the better of a few such plans counts.

The driver sees counts by length.  Pieces are numbered within their length by Spark, and
look their sequence up in the plan by (length, number).
"""

from __future__ import annotations

import itertools
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabwise.functions.staging import stage
from tabwise.llm.common import chunks, table, text_or_empty
from tabwise.llm.tokens import Encoder, vocabulary

CAPACITY = 1024
#: Pieces of at most this part of the capacity are small.
SMALL_PART = 4
GROUPS = 160
#: Rows that one numbering task is meant to hold.
NUMBERED_ROWS = 1_000_000
MAX_PIVOTS = 2000
#: How far, in parts of it, the linear programme may end above its optimum.
GAP = 1e-4
#: Plans that are compared: sequences with room, but less than this, are undone.
KEPT_ROOMS = (0, 16, 64, CAPACITY)


def tokenized_pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id.

    Only documents longer than ``capacity`` are cut: the first piece is what is left over
    whole pieces.  A null text is empty and gives one piece with the end id.
    """
    end = struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary_path)
        for batch in chunks(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                data = ids + end
                n = len(data) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, i, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)],
                names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """(copies of each size, sequences) of a linear programme's optimum: the fewest
    sequences, in fractions (to ``GAP``), that hold ``demand`` pieces of each size.

    The inverse basis is kept by elementwise row operations: library calls for linear
    algebra start threads of their own, which the driver's surroundings may not allow.
    """
    m = len(sizes)
    size, d = np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / (capacity // size))
    x = d * inverse.diagonal()
    most = capacity // int(size.min())
    room = np.arange(capacity + 1)[None, :] - size[:, None]  # what a size leaves of each room
    room[room < 0] = capacity + 1  # the last place holds "does not fit"
    for _ in range(MAX_PIVOTS):
        value = inverse.sum(axis=0)
        # The most valuable content of one sequence, by room and number of pieces.
        layers = [np.append(np.zeros(capacity + 1), -np.inf)]
        picks = []
        for _ in range(most):
            gain = value[:, None] + layers[-1][room]
            pick = gain.argmax(axis=0)
            top = gain[pick, np.arange(capacity + 1)]
            better = top > layers[-1][:-1] + 1e-12
            picks.append(np.where(better, pick, -1))
            layers.append(np.append(np.where(better, top, layers[-1][:-1]), -np.inf))
        if layers[-1][capacity] <= 1 + GAP:
            break
        new, c = np.zeros(m), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                new[pick[c]] += 1
                c -= size[pick[c]]
        change = (inverse * new).sum(axis=1)
        rows = np.flatnonzero(change > 1e-9)
        out = rows[np.argmin(x[rows] / change[rows])]
        step = x[out] / change[out]
        x -= step * change
        x[out] = step
        columns[:, out] = new
        inverse[out] /= change[out]
        change[out] = 0
        inverse -= change[:, None] * inverse[out]
    return [(columns[:, j].astype(int), max(0.0, float(x[j]))) for j in range(m)]


@dataclass
class Sequences:
    """``n`` sequences with equal contents: of each part (length, low, per) sequence j holds
    the pieces numbered low + j * per and on, ``per`` of them."""

    n: int
    room: int
    parts: list[tuple[int, int, int]]


@dataclass
class Plan:
    """Where the pieces of a length go, by their number: ``places`` rows are (length, low,
    n, per, base): number i from low on, n of them, is in sequence base + (i - low) // per."""

    opened: int = 0
    places: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def plan_large(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[Sequences], dict[int, list[tuple[int, int]]]]:
    """Sequences for the pieces whose lengths are in ``counts``, and the pieces left over:
    by length, runs (low, n) of numbers."""
    made: list[Sequences] = []
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)
    lengths, total = sorted(counts, reverse=True), sum(counts.values())
    if not total:
        return made, left
    first, at = {}, 0  # of each length, in the order from the longest
    for length in lengths:
        first[length], at = at, at + counts[length]
    starts = [first[n] for n in lengths]
    by_size: dict[int, list[int]] = {}  # rounded-up size: [low, high) in that order
    edges = [total * i // groups for i in range(groups + 1)]
    for low, high in zip(edges, edges[1:], strict=False):
        if low < high:
            longest = lengths[bisect_right(starts, low) - 1]
            by_size.setdefault(longest, [low, high])[1] = high
    sizes = sorted(by_size, reverse=True)
    taken = {s: by_size[s][0] for s in sizes}

    def runs(low: int, high: int) -> list[tuple[int, int, int]]:
        """(length, low, n) of the places [low, high) in the order from the longest."""
        out = []
        while low < high:
            k = bisect_right(starts, low) - 1
            end = min(high, starts[k] + counts[lengths[k]])
            out.append((lengths[k], low - starts[k], end - low))
            low = end
        return out

    for copies, share in configurations(sizes, [by_size[s][1] - by_size[s][0] for s in sizes], capacity):
        bins, slots = int(share + 1e-6), [(sizes[k], int(copies[k])) for k in np.flatnonzero(copies)]
        for size, per in slots:
            bins = min(bins, (by_size[size][1] - taken[size]) // per)
        if not bins:
            continue
        # Where a slot goes on to the next length, a new run of equal sequences starts.
        cuts = {0, bins}
        for size, per in slots:
            for p in starts[bisect_right(starts, taken[size]) : bisect_left(starts, taken[size] + bins * per)]:
                cuts |= {(p - taken[size]) // per, -(-(p - taken[size]) // per)}
        for a, b in itertools.pairwise(sorted(cuts)):
            parts = []
            for size, per in slots:
                found = runs(taken[size] + a * per, taken[size] + b * per)
                parts += [(length, low, n // (b - a)) for length, low, n in found]
            made.append(Sequences(b - a, capacity - sum(n * per for n, _, per in parts), parts))
        for size, per in slots:
            taken[size] += bins * per
    for s in sizes:
        for length, low, n in runs(taken[s], by_size[s][1]):
            left[length].append((low, n))
    return made, left


def plan_best_fit(items: dict[int, list[tuple[int, int]]], rooms: dict[int, list[tuple[int, int]]], capacity: int, plan: Plan) -> Plan:
    """Adds each piece, longest first, where it leaves the least room.

    ``items``: by length, the runs (low, n) of numbers.  ``rooms``: by size of room, the
    runs (base, n) of opened sequences that have it; others are opened as needed.
    """
    cohorts = {room: list(runs) for room, runs in rooms.items() if room}
    open_rooms = sum(1 << room for room in cohorts)
    for length in sorted(items, reverse=True):
        for low, n in items[length]:
            while n:
                fit = open_rooms >> length
                if fit:
                    room = length + (fit & -fit).bit_length() - 1
                    base, size = cohorts[room].pop()
                    if not cohorts[room]:
                        open_rooms &= ~(1 << room)
                else:
                    room, base, size = capacity, plan.opened, -(-n // (capacity // length))
                    plan.opened += size
                per = room // length
                used, per = (min(size, n // per), per) if n >= per else (1, n)
                plan.places.append((length, low, used * per, per, base))
                low, n = low + used * per, n - used * per
                for rest, run in ((room - per * length, (base, used)), (room, (base + used, size - used))):
                    if rest and run[1]:
                        cohorts.setdefault(rest, []).append(run)
                        open_rooms |= 1 << rest
    return plan


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences over a few ways to go on from the configurations.

    All sequences that the configurations fill are kept, or only those whose room is none
    or large enough for usual small pieces; the others' pieces are packed anew by best fit
    with the small ones.
    """
    small = capacity // SMALL_PART
    made, left = plan_large({n: c for n, c in counts.items() if n > small}, capacity)
    best = None
    for least in KEPT_ROOMS:
        plan, rooms = Plan(), defaultdict(list)
        items = {n: list(runs) for n, runs in left.items()} | {n: [(0, c)] for n, c in counts.items() if n <= small}
        for s in made:
            if s.room and s.room < least:
                for length, low, per in s.parts:
                    items.setdefault(length, []).append((low, s.n * per))
                continue
            plan.places += [(length, low, s.n * per, per, plan.opened) for length, low, per in s.parts]
            rooms[s.room].append((plan.opened, s.n))
            plan.opened += s.n
        plan = plan_best_fit(items, rooms, capacity, plan)
        if best is None or plan.opened < best.opened:
            best = plan
        if best.opened * capacity < sum(n * c for n, c in counts.items()) + capacity:
            break  # no plan has fewer
    return best


def numbered(rows: DataFrame, kind: str, by: list[str], total: int) -> DataFrame:
    """Adds ``number``: 0, 1, ... among the rows of equal ``kind``, in no set order.

    Rows are dealt into cells by their hash and numbered within; a hot kind is split.
    """
    cells = max(16, total // NUMBERED_ROWS)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*by), F.lit(cells)))
    before = Window.partitionBy(kind).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(kind, "cell").agg(F.count("*").alias("n")).select(
        kind, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy(kind, "cell").orderBy(*by)
    return (
        rows.withColumn("number", F.row_number().over(within) - 1)
        .join(offsets, [kind, "cell"])
        .withColumn("number", F.col("number") + F.col("offset"))
        .drop("cell", "offset")
    )


PLACES = "length long, low long, n long, per long, base long"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    Pieces of full length get a sequence each.  Rows with a null doc_id or a repeated
    (doc_id, piece) are packed like any other, each once.  No rows give no rows.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    full = full.withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return full
    rest = stage(numbered(rest, "length", ["doc_id", "piece", "ids_crc32"], sum(counts.values())), "numbered-pieces")
    # A few rows for each length and group: the plan's size depends on the capacity alone.
    places = spark.createDataFrame(plan_packing(counts, capacity).places, PLACES)
    placed = (
        rest.join(F.broadcast(places), "length")
        .where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("low") + F.col("n")))
        .withColumn("sequence_id", F.col("base") + F.floor((F.col("number") - F.col("low")) / F.col("per")))
    )
    within = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # A sequence holds at most ``capacity`` pieces.
    placed = placed.select(*columns, "sequence_id").withColumn("offset", F.sum("length").over(within) - F.col("length"))
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Cuts, then packs; other columns are ignored.  See the two steps for odd rows."""
    return pack_pieces(stage(tokenized_pieces(docs, vocabulary_path, end_id, capacity), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)
