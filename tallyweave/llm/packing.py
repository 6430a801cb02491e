"""Packing of documents into sequences of a fixed length by bin completion.

Only lengths matter to a bin, so the bins are planned on the histogram of piece lengths (at most `capacity`
numbers, whatever the corpus holds) and the plan is dealt to the pieces by their rank within a length.

The first incumbent is the best-fit-decreasing plan. If it is over the lower bound, a branch and bound over whole
plans looks for a better one: the largest length left takes one of its undominated fillings, least waste first, as
often as the counts allow or fewer times, and the search comes back to the other ways. A filling is dominated if
a piece that is left could join it or stand for smaller ones in it. The search stops at the lower bound or after
STEPS, with the better plan either way.

Defined results: null or empty text is one piece of one token (the end id); a document of over `capacity` tokens
is cut so that its first piece takes the remainder; pieces of one length are interchangeable, and go in the order of
their tasks and rows; repeated rows are packed each for itself; only doc_id and text are read; an empty table
gives an empty result. A lost task is recomputed: the pieces with their ranks stand in a table in the shared
folder before the plan is made.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.bpe import encoded_chunks
from tallyweave.staging import mapped, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def reachable(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each k, the bit set of sums up to `room` of the pieces lengths[k:], counts respected."""
    mask, bits = (1 << (room + 1)) - 1, [1]
    for size in reversed(lengths):
        b, left, step = bits[-1], min(counts[size], room // size), 1
        while left:
            take = min(step, left)
            b |= b << (take * size)
            left, step = left - take, step * 2
        bits.append(b & mask)
    return bits[::-1]


def fillings(room: int, counts: dict[int, int], waste: int) -> Iterator[list[int]]:
    """All fillings of `room` that leave exactly `waste` of it, larger pieces first; sizes descend."""
    lengths, goal = sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True), room - waste
    bits = reachable(lengths, counts, max(room, 0))
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, goal, ())] if goal >= 0 and bits[0] >> goal & 1 else []
    while stack:
        k, left, taken = stack.pop()
        if not left:
            yield list(taken)
            continue
        size = lengths[k]
        for n in range(0, min(counts[size], left // size) + 1):  # the most of the largest piece is tried first
            if bits[k + 1] >> (left - n * size) & 1:
                stack.append((k + 1, left - n * size, taken + (size,) * n))


def least_waste(room: int, counts: dict[int, int]) -> int:
    """The room that no filling uses."""
    lengths = [x for x, n in counts.items() if n > 0 and x <= room]
    return room - (reachable(lengths, counts, room)[0].bit_length() - 1)


def completion(room: int, counts: dict[int, int]) -> list[int]:
    """The filling of `room` of least waste from a histogram, larger pieces first among equals."""
    return next(fillings(room, counts, least_waste(room, counts)))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: pieces of over capacity - k go without pieces of k and more, for each k."""
    n = np.zeros(capacity + 1, np.int64)
    for size, m in counts.items():
        n[size] = m
    many, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)
    above_half = many[-1] - many[capacity // 2]
    before = np.where(k > 0, total[k - 1], 0)
    small = total[capacity // 2] - before  # of k up to half the capacity
    middle, in_middle = many[capacity - k] - many[capacity // 2], total[capacity - k] - total[capacity // 2]
    return int((above_half + np.maximum(0, -(-(small - (middle * capacity - in_middle)) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: the plan that placing piece by piece gives."""
    groups: list[list] = []  # [room left, pieces of each length, number of such bins]
    for size in sorted(counts, reverse=True):
        n, each = counts[size], capacity // size
        for group in sorted((g for g in groups if g[0] >= size), key=lambda g: g[0]):
            if not n:
                break
            room, bin_, times = group
            fit = room // size
            full = min(times, n // fit)
            rest = min(n - full * fit, fit - 1) if full < times else 0
            group[2] -= full + (rest > 0)
            groups += [[room - q * size, bin_ | {size: q}, m] for q, m in ((fit, full), (rest, 1)) if q and m]
            n -= full * fit + rest
        groups += [[capacity - q * size, {size: q}, m] for q, m in ((each, n // each), (n % each, 1)) if q and m]
        groups = [g for g in groups if g[2]]
    return [(bin_, times) for _, bin_, times in groups]


def dominated(filling: list[int], waste: int, left: dict[int, int]) -> bool:
    """Whether a piece that is left could join a filling, or stand in it for one smaller or two together no larger."""
    have = 0
    for size in left:
        have |= 1 << size
    between = lambda a, b: a <= b and have >> a & ((1 << (b - a + 1)) - 1)
    sizes = sorted(set(filling))
    if between(1, waste) or any(between(x + 1, x + waste) for x in sizes):
        return True
    twice = {x for x in sizes if filling.count(x) > 1}
    return any(between(x + y, x + y + waste) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or x in twice)


#: Work of the search: a node costs as much as the lengths left there. About 10 s of the driver at most.
STEPS = 1_000_000


def repeats(most: int) -> Iterator[int]:
    """How often a filling may be used: all times it can, half of them and so on to once, then all other numbers."""
    halves, n = [], most
    while n:
        halves.append(n)
        n //= 2
    yield from halves
    seen = set(halves)
    yield from (n for n in range(most - 1, 0, -1) if n not in seen)


def plan(counts: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins), for all pieces of the histogram.

    The best-fit-decreasing plan, or a better one if the search finds it in `steps`; a plan of lower_bound() bins ends
    the search. A node takes the largest length left and tries its undominated fillings by waste, each so many times;
    fillings of one length go in one order, so each multiset of bins comes once. A node is cut when its waste, or the
    bound of what is left, leaves no better plan."""
    counts = {k: n for k, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    used, least, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(k * n for k, n in counts.items())

    def branches(left: dict[int, int], wasted: int, last: tuple[int, list[int]] | None) -> Iterator[tuple[list[int], int, int, dict[int, int]]]:
        """(bin, times, its waste, pieces left) for each way to go on; None counts a filling that is none."""
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        room = capacity - largest
        for waste in range(max(least_waste(room, rest), last[0] if last else 0), room + 1):
            if wasted + waste > (used - 1) * capacity - total:
                return
            for filling in fillings(room, rest, waste):
                bin_ = [largest, *filling]
                if last and (waste, bin_) != last and waste == last[0] and bin_ > last[1] or (waste, bin_) == last:
                    yield None
                    continue
                held = Counter(bin_)
                for times in repeats(min(left[k] // n for k, n in held.items())):
                    after = {k: n - held[k] * times for k, n in left.items() if n > held[k] * times}
                    yield None if dominated(filling, waste, after) else (bin_, times, waste, after)

    path: list[tuple[list[int], int, int]] = []
    stack = [branches(counts, 0, None)] if used > least else []
    sizes = [len(counts)]
    while stack and used > least and steps > 0:
        steps -= 1
        if (found := next(stack[-1], stack)) is stack:
            stack.pop()
            sizes.pop()
            if path:
                path.pop()
            continue
        steps -= sizes[-1]
        if found is None:
            continue
        bin_, times, waste, after = found
        now = sum(x[1] for x in path) + times
        wasted = sum(x[1] * x[2] for x in path) + times * waste
        if wasted > (used - 1) * capacity - total or now + (lower_bound(after, capacity) if after else 0) >= used:
            continue
        if not after:
            best, used = [*((dict(Counter(x[0])), x[1]) for x in path), (dict(Counter(bin_)), times)], now
            continue
        path.append((bin_, times, waste))
        stack.append(branches(after, wasted, (waste, bin_) if max(after) == bin_[0] else None))
        sizes.append(len(after))
    return best


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents, with their rank among the pieces of their length in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for i, j, ids, at in encoded_chunks(b.column(1), path):
                raw = memoryview(ids.astype("<u4").tobytes())
                tail = np.uint32(end_id).tobytes()
                sizes = np.diff(at) + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(j - i), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = sizes - (pieces - 1) * capacity
                start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
                length = np.where(number == 0, first[row], capacity)
                last = number == pieces[row] - 1
                begin = (at[row] + start) * 4
                end = begin + (length - last) * 4
                sums = [zlib.crc32(raw[s:e]) for s, e in zip(begin.tolist(), end.tolist())]
                for k in np.flatnonzero(last).tolist():
                    sums[k] = zlib.crc32(tail, sums[k])
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                run_ = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
                rank = np.empty(len(order), np.int64)
                rank[order] = run_ + seen[sorted_]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"],
                )

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece: its place in its document, checksum of its ids, sequence and offset there."""
    pieces = written(cut_pieces(docs, path, capacity, end_id), "pieces")
    of_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = of_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    bins = plan(counts, capacity)

    #: For each length: ranks from which a line of the plan takes its pieces; pieces a bin, first bin, offset in the bin.
    lines: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = Counter(), 0
    for bin_, times in bins:
        offset = 0
        for size in sorted(bin_, reverse=True):
            lines.setdefault(size, []).append((taken[size], bin_[size], sequence, offset))
            taken[size] += bin_[size] * times
            offset += bin_[size] * size
        sequence += times
    starts = {size: np.array([x[0] for x in found], np.int64) for size, found in lines.items()}
    facts = {size: np.array([x[1:] for x in found], np.int64) for size, found in lines.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            bin_of, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                k = np.searchsorted(starts[size], rank[at], "right") - 1
                each, first, offset = facts[size][k].T
                nth, slot = np.divmod(rank[at] - starts[size][k], each)
                bin_of[at], place[at] = first + nth, offset + slot * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bin_of), pa.array(place)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(ranks, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("part_rank")).alias("rank"))
    return mapped(ranked, deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
