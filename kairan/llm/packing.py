"""Packing documents into sequences by the linear grouping scheme (Fernandez de la Vega and Lueker 1981).

Long pieces, sorted by length, are dealt into groups of equal cardinality and rounded up to their group's greatest
length. Few lengths are left, for which configurations (what fills one sequence) are optimised by linear programming with
generated columns (Gilmore and Gomory 1961). The groups' actual pieces take the places, longest first, and best fit lays
the short ones, and what rounding the optimum down has left over, into the room that remains.

Only the number of pieces of each length decides all this, and there are no more lengths than a sequence has tokens.
So the plan is made from that histogram, of the same size for any corpus, and says for each length which of its pieces,
by rank, go to which sequences; tasks look their pieces up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices
from .tokens import byte_level, read_text, text_parts

#: Tokens of a sequence, and the token that ends a document.
CAPACITY, END = 1024, 2
#: Groups of long pieces; pieces of over 1/``SHORT`` of a sequence are long.
GROUPS, SHORT = 64, 8
#: Configurations that actual pieces leave more room in than one of these are undone, and best fit lays their pieces; the
#: plan is the one of fewest sequences.
ROOMS = (0, 1, 2, 5, 20, CAPACITY)
#: The linear program ends when its optimum is nearer than this share (a column's value bounds it), or after so many
#: columns a group. Any solution on the way is a valid plan.
GAP, COLUMNS = 1e-4, 40


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best total value of sizes, each as often as one likes, in ``room``; and how often each is taken."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for k, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        if v <= 1e-12:
            continue
        for at in range(s, room + 1, s):  # a stretch of ``s`` places only looks back at the stretch before it
            to = min(at + s, room + 1)
            tried = best[at - s : to - s] + v
            better = tried > best[at:to] + 1e-12
            best[at:to] = np.where(better, tried, best[at:to])
            last[at:to][better] = k
    taken, at = np.zeros(len(sizes), np.int64), room
    while at > 0:
        if last[at] < 0:
            at -= 1
            continue
        if best[at] > best[at - 1] + 1e-12:
            taken[last[at]] += 1
            at -= int(sizes[last[at]])
        else:
            at -= 1
    return float(best[room]), taken


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences get each: the linear program's optimum, rounded down."""
    n = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    amounts = demand / (room // sizes)
    for turn in range(COLUMNS * n):
        if turn % 100 == 99:  # refresh what updates have blurred
            inverse = np.linalg.inv(basis)
            amounts = inverse @ demand
        value, column = knapsack(sizes, inverse.sum(0), room)
        if value <= 1 + GAP:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        amounts = np.maximum(amounts - ratio[out] * step, 0)
        amounts[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return [(basis[:, j].astype(np.int64), int(a)) for j, a in enumerate(np.floor(amounts + 1e-6)) if a >= 1]


@dataclass
class Plan:
    """``classes``: a number of sequences and the lengths that each of them holds, in order of their places."""

    capacity: int
    classes: list[tuple[int, list[int]]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.classes)

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (length * 2**44 + rank) from which on pieces go to sequences from ``first`` on, at ``offset``.

        Sorted by key. The piece of a length's rank ``key + i`` goes to sequence ``first + i``.
        """
        used, rows, first = {}, [], 0
        for n, lengths in self.classes:
            offset = 0
            for x in lengths:
                rows.append(((x << 44) + used.get(x, 0), first, offset))
                used[x] = used.get(x, 0) + n
                offset += x
            first += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]


def substitute(pattern: np.ndarray, n: int, stock: list[list[list[int]]]) -> list[tuple[int, list[int]]]:
    """``n`` sequences of a configuration with actual lengths: each place takes its group's longest that are left.

    ``stock`` holds runs [length, count] of each group, longest last. A place that its group can't fill stays empty.
    """
    parts = [(n, [])]
    for g in (g for g, k in enumerate(pattern.tolist()) for _ in range(k)):
        filled = []
        for count, lengths in parts:
            while count and stock[g]:
                run = stock[g][-1]
                take = min(count, run[1])
                filled.append((take, [*lengths, run[0]]))
                run[1] -= take
                count -= take
                if not run[1]:
                    stock[g].pop()
            if count:
                filled.append((count, lengths))
        parts = filled
    return parts


def best_fit(counts: dict[int, int], classes: list[tuple[int, list[int]]], capacity: int) -> list[tuple[int, list[int]]]:
    """Lays pieces, longest first, each where the least room is left that holds it; opens sequences where none does.

    Sequences of one class are filled alike: the fullest one that has room for a piece stays so until it has none, so a
    piece's class takes as many of its length as fit.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for n, lengths in classes:
        by_room.setdefault(capacity - sum(lengths), []).append((n, lengths))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length and by_room[r]), default=None)
            if room is None:
                by_room.setdefault(capacity, []).append((-(-left // (capacity // length)), []))
                continue
            n, lengths = by_room[room].pop()
            each = room // length
            whole, rest = min(n, left // each), 0
            if whole < n:
                rest = left - whole * each
            for count, k in ((whole, each), (1 if rest else 0, rest), (n - whole - (1 if rest else 0), 0)):
                if count:
                    by_room.setdefault(room - k * length, []).append((count, lengths + [length] * k))
            left -= whole * each + rest
    return [x for found in by_room.values() for x in found]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan for so many pieces (positive) of each length (1 to ``capacity``)."""
    left = {x: n for x, n in counts.items() if n > 0}
    full = left.pop(capacity, 0)
    classes: list[tuple[int, list[int]]] = []
    large = sorted(x for x in left if x * SHORT > capacity)
    total = sum(left[x] for x in large)
    if total:
        # equal cardinality: the i-th of all long pieces, ascending, is in group i * groups // total
        stock, at = [[] for _ in range(groups)], 0
        for x in large:
            n = left.pop(x)
            while n:
                g = at * groups // total
                take = min(n, -(-(g + 1) * total // groups) - at)
                stock[g].append([x, take])
                at, n = at + take, n - take
        merged: dict[int, list[list[int]]] = {}  # groups of the same rounded length are one
        for runs in filter(None, stock):
            merged.setdefault(runs[-1][0], []).extend(runs)
        sizes = np.array(sorted(merged), np.int64)
        rounded = [merged[s] for s in sizes.tolist()]
        demand = np.array([sum(n for _, n in runs) for runs in rounded], float)
        for pattern, n in configurations(sizes, demand, capacity):
            classes += substitute(pattern, n, rounded)
        for length, n in (run for runs in rounded for run in runs):
            left[length] = left.get(length, 0) + n
    tried = [best_fit(*_dissolved(left, classes, capacity - room), capacity) for room in ROOMS]
    classes = min(tried, key=lambda found: sum(n for n, _ in found))
    return Plan(capacity, classes + ([(full, [capacity])] if full else []))


def _dissolved(left: dict[int, int], classes: list[tuple[int, list[int]]], least: int) -> tuple[dict[int, int], list[tuple[int, list[int]]]]:
    """Pieces left and classes, where classes of fewer than ``least`` tokens become pieces again."""
    left = dict(left)
    for n, lengths in classes:
        if sum(lengths) < least:
            for x in lengths:
                left[x] = left.get(x, 0) + n
    return left, [c for c in classes if c[1] and sum(c[1]) >= least]


def pieces_of(docs: DataFrame, path: str, pattern: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """A row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``part``, ``nth`` (of its length in ``part``)."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part, seen = byte_level(path, pattern, True), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for slice_ in text_slices(batches, 1):
            rows = []
            for doc, text in zip(slice_.column(0).to_pylist(), read_text(slice_.column(1)), strict=True):
                ids = np.concatenate([*(codec.encode(p) for p in text_parts(text)), [END]]).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), part, seen[stop - start]))
                    seen[stop - start] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces and their places in sequences of at most ``capacity`` tokens.

    Returns ``doc_id``, ``piece`` int, ``start``, ``length``, ``ids_crc32`` (of little-endian unsigned 32-bit ids),
    ``sequence_id``, ``offset`` long. A document is its text's ids and ``END``; only one of more than ``capacity`` tokens
    is cut, into pieces of ``capacity`` of which the first may be shorter. A null or empty text is ``END`` alone. Rows are
    packed one by one: repeated rows repeat their pieces at places of their own, a null id stays null, an empty table
    gives no rows. Other columns aren't read, so their names can't clash. Special tokens' strings within texts are these
    tokens, as the library has it by default.

    Pieces are numbered within their length by task and by sums over tasks, never in one sort; what the driver sees is
    the number of pieces of each length.
    """
    pieces = stored(pieces_of(docs, path, pattern, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("base"))
    plan = make_plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity, groups)
    keys, firsts, offsets = plan.intervals()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column(3).to_numpy() << 44) + batch.column(5).to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = pieces.join(bases, ["length", "part"]).select(*names[:5], (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
