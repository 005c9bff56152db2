"""Best-fit packing of token sequences, by bin completion over lengths.

Only lengths decide a packing, so the plan is made on their histogram: at most as many entries as a sequence has tokens,
whatever the number of documents. Best fit by falling lengths, equal sequences at a time, is the first incumbent. If it needs more sequences than
the lower bound, branch and bound looks for fewer: around the largest length left, fillings are enumerated by rising waste, large lengths first; one that another
dominates (a length left out could stand for a smaller one that is in, or would still fit) is skipped, and a branch ends when its waste
leaves no way to fewer sequences than the incumbent has. A filling is used as often as the counts allow; with at most LAST pieces left all
fillings are enumerated and used once each. The search ends at the lower bound, or after LOOKS steps: the plan is never worse than best fit, and
planning time doesn't grow with the documents.

Documents find their places by rank among those of their length, counted in parts of bounded size, so nothing but the
histogram and the plan passes through the driver and no length gathers in a task.

Defined results: null or empty text is its end token alone. Rows that repeat are packed each for itself, null ids too.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import chunks, saved, small_batches

CAPACITY, END = 4096, 1
#: Pieces that one task ranks.
RANKED = 1000
#: Branch and bound: steps in all, steps for the fillings of one sequence, pieces left from which on all fillings are enumerated.
LOOKS, LOOKED, LAST = 200_000, 400, 40

Filling = tuple[tuple[int, int], ...]


class Run(NamedTuple):
    """A filling, the number of each length in a sequence, for so many sequences from a first one on."""

    filling: Filling
    first: int
    times: int


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit by falling lengths: (filling, times). Each piece goes where the least room is left that holds it."""
    held: dict[int, list[tuple[Filling, int]]] = {}
    some = np.zeros(capacity + 1, bool)

    def put(room: int, filling: Filling, times: int) -> None:
        if times:
            held.setdefault(room, []).append((filling, times))
            some[room] = True

    for a in sorted(histogram, reverse=True):
        n = histogram[a]
        while n:
            room = a + int(some[a:].argmax())
            if some[room]:
                filling, times = held[room].pop()
                some[room] = bool(held[room])
            else:
                room, filling, times = capacity, (), n
            k = room // a  # a sequence stays the one with the least room as long as it holds another
            full = min(times, n // k)
            put(room - k * a, (*filling, (a, k)), full)
            n -= full * k
            if full < times and n:
                put(room - n * a, (*filling, (a, n)), 1)
                full, n = full + 1, 0
            if filling:
                put(room, filling, times - full)
    return [x for runs in held.values() for x in runs]


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound: by tokens; by pieces of which only so many fit together; by large pieces and what doesn't fit beside them."""
    count = np.zeros(capacity + 1, np.int64)
    for a, n in histogram.items():
        count[a] += n
    tokens = count * np.arange(capacity + 1)
    above, half = np.cumsum(count[::-1])[::-1], capacity // 2
    best = -(-int(tokens.sum()) // capacity)
    for k in range(1, min(capacity, 64) + 1):
        best = max(best, -(-int(above[capacity // (k + 1) + 1]) // k))
    until, pieces = np.cumsum(tokens), np.cumsum(count)
    for small in range(1, half + 1):
        most = capacity - small  # pieces over half of a sequence and up to this one leave room for small ones
        room = int(pieces[most] - pieces[half]) * capacity - int(until[most] - until[half])
        best = max(best, int(above[half + 1]) + max(0, -(-(int(until[half] - until[small - 1]) - room) // capacity)))
    return best


class Lengths:
    """Counts of the lengths left."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.looked = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.count[length] += n

    def largest(self, most: int) -> int:
        """The largest length left of at most so much, 0 if there is none."""
        k = np.flatnonzero(self.count[1 : most + 1])
        return int(k[-1]) + 1 if len(k) else 0

    def use(self, filling: Filling, times: int) -> None:
        for a, m in filling:
            self.count[a] -= m * times

    def fillings(self, first: int, waste: int) -> Iterator[tuple[Filling, int]]:
        """Undominated fillings around a first piece that waste at most so much, by rising waste, with the waste of each. The counts have to be the same each time that the
        next one is asked for; they are lent, not copied, and whole whenever one is given, as thousands of sequences are open at once."""
        count, room = self.count, self.capacity - first
        count[first] -= 1
        if count.sum() < LAST:
            few = list(self._all(count, first, room, waste))
            count[first] += 1
            yield from few
            return
        stop = self.looked + LOOKED
        taken = [first]
        while (a := self._fits(count, room)) and room > 3 * a:  # what three more pieces can't fill takes large ones
            count[a] -= 1
            taken.append(a)
            room -= a
        lent = tuple(Counter(taken).items())
        for over in range(min(waste, room) + 1):
            for found in self._exact(count, room - over, room - over, 2, stop):
                if not over or not self._dominated(count, found, over):
                    self.use(lent, -1)
                    yield tuple(sorted(Counter(taken + found).items(), reverse=True)), over
                    self.use(lent, 1)
            if self.looked > stop:
                break
        rest = []  # best fit, where the search above found nothing of the kind
        while a := self._fits(count, room):
            count[a] -= 1
            rest.append(a)
            room -= a
        self.use(tuple(Counter(taken + rest).items()), -1)
        if room <= waste:
            yield tuple(sorted(Counter(taken + rest).items(), reverse=True)), room

    @staticmethod
    def _fits(count: np.ndarray, room: int) -> int:
        k = np.flatnonzero(count[1 : room + 1])
        return int(k[-1]) + 1 if len(k) else 0

    def _exact(self, count: np.ndarray, room: int, bound: int, depth: int, stop: int) -> Iterator[list[int]]:
        """Pieces of at most the bound that fill the room: one, two, or so many more, large ones first. The counts are whole whenever some are given."""
        self.looked += 1
        if not room:
            yield []
            return
        if room <= bound and count[room]:
            yield [room]
        low, high = (room + 1) // 2, min(bound, room - 1)
        if low <= high:
            pair = np.flatnonzero((count[low : high + 1] > 0) & (count[room - high : room - low + 1][::-1] > 0)) + low
            for a in map(int, pair[::-1].astype(np.int32)):
                if 2 * a != room or count[a] > 1:
                    yield [a, room - a]
        if depth:
            for a in map(int, (np.flatnonzero(count[1 : high + 1]) + 1)[::-1].astype(np.int32)):
                if self.looked > stop or a * (depth + 2) < room:
                    return
                count[a] -= 1
                for more in self._exact(count, room - a, a, depth - 1, stop):
                    if len(more) > 1:
                        count[a] += 1
                        yield [a, *more]
                        count[a] -= 1
                count[a] += 1

    @staticmethod
    def _dominated(count: np.ndarray, filling: list[int], waste: int) -> bool:
        left = count.copy()
        for a in filling:
            left[a] -= 1
        return bool((left[1 : waste + 1] > 0).any()) or any((left[a + 1 : a + waste + 1] > 0).any() for a in set(filling))

    def _all(self, count: np.ndarray, first: int, room: int, waste: int) -> Iterator[tuple[Filling, int]]:
        """All undominated fillings with few pieces left."""
        lengths = (np.flatnonzero(count[1 : room + 1]) + 1)[::-1].tolist()
        out: list[tuple[int, list[int]]] = []
        stop = self.looked + 50 * LOOKED

        def go(i: int, room: int, taken: list[int]) -> None:
            self.looked += 1
            while i < len(lengths) and lengths[i] > room:
                i += 1
            if i == len(lengths):
                if room <= waste and not self._dominated(count, taken, room):
                    out.append((room, taken))
                return
            a = lengths[i]
            for k in range(min(int(count[a]), room // a), -1, -1):
                if self.looked <= stop:
                    go(i + 1, room - k * a, taken + [a] * k)

        go(0, room, [])
        for over, taken in sorted(out, key=lambda x: x[0]):
            yield tuple(sorted(Counter([first, *taken]).items(), reverse=True)), over


def completed(histogram: dict[int, int], capacity: int, best: list[tuple[Filling, int]], least: int, looks: int = LOOKS) -> list[tuple[Filling, int]]:
    """Branch and bound for fewer sequences than the incumbent has."""
    left = Lengths(histogram, capacity)
    tokens, pieces = sum(a * n for a, n in histogram.items()), sum(histogram.values())
    most = sum(times for _, times in best)
    open_ones: list[Iterator[tuple[Filling, int]]] = []  # the fillings not yet tried, of each sequence begun
    taken: list[tuple[Filling, int, int]] = []
    waste = 0

    def undo() -> None:
        nonlocal waste, pieces
        filling, times, over = taken.pop()
        left.use(filling, -times)
        waste -= over * times
        pieces += times * sum(m for _, m in filling)

    while most > least and left.looked <= looks:
        allowed = (most - 1) * capacity - tokens
        if len(taken) == len(open_ones):
            first = left.largest(capacity)
            if not first:
                best, most = [(f, n) for f, n, _ in taken], sum(n for _, n, _ in taken)
                undo()
                continue
            open_ones.append(left.fillings(first, allowed - waste))
        filling, over = next(open_ones[-1], ((), 0))
        if not filling or waste + over > allowed:
            open_ones.pop()
            if not taken:
                break
            undo()
            continue
        times = 1 if pieces <= LAST else min(int(left.count[a]) // m for a, m in filling)
        if over:
            times = min(times, (allowed - waste) // over)
        left.use(filling, times)
        waste += over * times
        pieces -= times * sum(m for _, m in filling)
        taken.append((filling, times, over))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    best, least = best_fit(histogram, capacity), least_sequences(histogram, capacity)
    if sum(times for _, times in best) > least:
        best = completed(histogram, capacity, best, least)
    runs, first = [], 0
    for filling, times in best:
        runs.append(Run(filling, first, times))
        first += times
    return runs


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and end token, cut only where longer than the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, at = encoder(path).encode_batch([t or "" for t in batch.column("text").to_pylist()])
            rows = []
            for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                own = np.append(ids[a:b], end).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((d, piece, start, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder(path).forget()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = saved(pieces(docs, path, capacity, end))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # as many rows as lengths
    # where ranks of each length go: (length, first rank) -> first sequence, number in a sequence, offset there
    used: Counter[int] = Counter()
    places = []
    for run in plan(histogram, capacity):
        offset = 0
        for a, m in run.filling:
            places.append((a, used[a], run.first, m, offset))
            used[a] += m * run.times
            offset += a * m
    places.sort()
    table = cut.sparkSession.sparkContext.broadcast(np.array(places, np.int64).reshape(-1, 5))

    parts = [(a, -(-n // RANKED)) for a, n in histogram.items()]  # a row for each length
    many = cut.sparkSession.createDataFrame(parts, "length long, parts int")
    salted = cut.join(F.broadcast(many), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts").cast("int")).drop("parts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = t[np.searchsorted(key, (length << 44) + rank, side="right") - 1] if batch.num_rows else np.zeros((0, 5), np.int64)
            k = rank - row[:, 1]
            more = [pa.array(row[:, 2] + k // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + k % np.maximum(row[:, 3], 1) * length)]
            yield pa.record_batch([*batch.columns[:5], *more], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
