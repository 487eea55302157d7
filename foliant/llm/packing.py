"""Operator 7: best-fit packing of documents into training sequences.

A document's ids, with an end id, are cut only if they exceed the capacity: then
its last pieces are full and its first one holds the rest.  What is packed is thus
described by a histogram of at most ``capacity`` lengths, however many documents
there are.  The driver plans over this histogram alone (linear grouping):

1. lengths above ``small`` are sorted and cut into groups of equal cardinality,
   each rounded up to its largest length;
2. configurations of few rounded sizes are chosen, each time the fullest one that
   holds the largest size left, and used as often as the groups allow;
3. the groups' actual lengths replace the rounded ones, which frees room;
4. small lengths go, largest first, to the sequences that they fit best.

The plan maps a rank among the pieces of one length to a sequence and an offset.
Ranks come from counters that the encoding tasks write beside each piece plus a
running sum of counts over (task, length), so no group of rows meets in one task.

Null text is empty: one piece that holds the end id.  Repeated document ids are
each packed.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text, staged
from foliant.llm.tokens import encoder, gathered

GROUPS, SMALL_SHARE = 1024, 16
Run = tuple[int, tuple[int, ...]]  # so many sequences that hold these lengths


def grouped(counts: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
    """Rounded size -> [length, count] of its members, largest first."""
    total, out, seen = sum(counts.values()), {}, 0
    per, size = max(1, -(-total // groups)), 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if seen % per == 0:
                size = length
            take = min(left, per - seen % per)
            members = out.setdefault(size, [])
            if members and members[-1][0] == length:
                members[-1][1] += take
            else:
                members.append([length, take])
            seen, left = seen + take, left - take
    return out


def fullest(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Sizes, within the counts left, whose sum comes closest to ``room`` from below."""
    reach, steps, within = 1, [], (1 << (room + 1)) - 1
    for size in sizes:
        if size > room or not left[size]:
            continue
        uses = min(left[size], room // size)
        for _ in range(uses):
            new = (reach | reach << size) & within
            if new == reach:
                break
            steps.append((size, reach))
            reach = new
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(size)
            at -= size
    return chosen


def configurations(counts: dict[int, int], capacity: int) -> list[Run]:
    left, out = dict(counts), []
    sizes = sorted(left, reverse=True)
    for size in sizes:
        while left[size]:
            left[size] -= 1
            chosen = [size, *fullest(sizes, left, capacity - size)]
            left[size] += 1
            uses = Counter(chosen)
            times = min(left[s] // n for s, n in uses.items())
            for s, n in uses.items():
                left[s] -= n * times
            out.append((times, tuple(chosen)))
    return out


def with_members(configs: list[Run], groups: dict[int, list[list[int]]]) -> list[Run]:
    """Configurations with actual lengths for rounded ones."""
    rest, out = {s: [list(x) for x in reversed(m)] for s, m in groups.items()}, []
    for times, sizes in configs:
        slots = []
        for size in sizes:
            need, own = times, []
            while need:
                length, n = rest[size][-1]
                take = min(n, need)
                own.append((length, take))
                need -= take
                if take == n:
                    rest[size].pop()
                else:
                    rest[size][-1][1] -= take
            slots.append(own[::-1])
        while times:
            n = min(own[-1][1] for own in slots)
            out.append((n, tuple(own[-1][0] for own in slots)))
            for own in slots:
                length, m = own.pop()
                if m > n:
                    own.append((length, m - n))
            times -= n
    return out


def add_small(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    by_gap: dict[int, list[Run]] = defaultdict(list)
    for n, lengths in runs:
        by_gap[capacity - sum(lengths)].append((n, lengths))
    gaps = sorted(by_gap)

    def put(gap: int, run: Run) -> None:
        if gap not in by_gap or not by_gap[gap]:
            if (k := bisect.bisect_left(gaps, gap)) == len(gaps) or gaps[k] != gap:
                gaps.insert(k, gap)
        by_gap[gap].append(run)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            while k < len(gaps) and not by_gap[gaps[k]]:
                del gaps[k]
            if k == len(gaps):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (left // each, (length,) * each))
                if left % each:
                    put(capacity - left % each * length, (1, (length,) * (left % each)))
                break
            gap = gaps[k]
            n, lengths = by_gap[gap].pop()
            each = min(gap // length, max(1, left // n))
            take = min(n, left)
            if take < n:
                by_gap[gap].append((n - take, lengths))
            put(gap - each * length, (take, lengths + (length,) * each))
            left -= take * each
    return [run for gap in gaps for run in by_gap[gap]]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: int | None = None) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first sequence, offset), by rising rank.  Each row
    holds for the ranks up to the next one's."""
    small = capacity // SMALL_SHARE if small is None else small
    of = grouped({n: c for n, c in histogram.items() if n > small}, groups)
    runs = with_members(configurations({s: sum(c for _, c in m) for s, m in of.items()}, capacity), of)
    runs = add_small(runs, {n: c for n, c in histogram.items() if n <= small}, capacity)
    rows, rank, sequence = defaultdict(list), Counter(), 0
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            rows[length].append((rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return {length: np.array(x, "int64") for length, x in rows.items()}


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("at", pa.int64())])


def _cut(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary, True).encode_batch, TaskContext.get().partitionId(), Counter()
        for batch in gathered(batches):
            rows = []
            ids, ends = encode(batch.column("text").to_pylist())
            raw = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).tolist()
            for doc_id, (first, stop) in zip(batch.column("doc_id").to_pylist(), pairwise(bounds), strict=True):
                n, at = stop - first, 0
                for piece in range(-(-n // capacity)):
                    length = n - at if n - at <= capacity else (n % capacity or capacity) if piece == 0 else capacity
                    rows.append((doc_id, piece, at, length, zlib.crc32(raw[4 * (first + at) : 4 * (first + at + length)]), task, seen[length]))
                    seen[length] += 1
                    at += length
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _PIECES.types, strict=True)] if rows else [pa.array([], k) for k in _PIECES.types], schema=_PIECES)

    return run


def _place(planned: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), "int64"), np.zeros(len(rank), "int64")
            for n in np.unique(length):
                rows, own = planned[int(n)], length == n
                k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = rows[k, 1] + rank[own] - rows[k, 0], rows[k, 2]
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    pieces = staged(id_and_text(docs, id_col, text_col).mapInArrow(_cut(vocabulary, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, at long"), "pieces")
    counts = pieces.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return (
        pieces.join(base, ["task", "length"])
        .withColumn("rank", F.col("base") + F.col("at"))
        .mapInArrow(_place(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
