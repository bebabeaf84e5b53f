"""Operator 10, best-fit packing by linear grouping.

Only lengths decide a packing, and there are at most `capacity` of them, so the
plan is made from the histogram of piece lengths (the same size at any scale):

1. pieces of full length stand alone;
2. large lengths, sorted, are cut into groups of equal count, each rounded up to
   its largest length, and the few rounded sizes are packed by configurations:
   column generation on the fractional program, rounded down;
3. actual pieces take the places of the configurations, those with the longest first:
   each place but the last the longest piece left that its group's size admits, from a
   group of shorter ones once its own is used up, and the last place the longest that
   the room admits, which may be longer than its group. Where large pieces still fit,
   they are added, so that the room that rounding leaves is used;
4. what is left and all small lengths go best-fit into the gaps, longest first.

The plan is made with each number of groups in `N_GROUPS`; the one of fewest sequences is
kept. On even, humped and narrow lengths it needs no more sequences than best fit
decreasing, and up to eight per cent fewer where lengths combine in few ways; on lognormal
lengths, which best fit packs almost without a gap, 2 in 10,000 more.

The plan is kept as runs: (length, first rank, count, first sequence, offset) puts
the piece of rank r at sequence first + (r - first rank). Ranks within a length are
given in Spark: a counter a task and length, plus the counts of the tasks before.

Defined cases: null text is the empty text, one end id long; a document of equal
doc_id and text is packed as often as it occurs; an empty table packs nothing;
null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .encoding import encoder

CAPACITY = 4096
#: Groups of equal count that the large lengths are rounded up to.
N_GROUPS = (48, 24)
#: A length above this share of the capacity is large.
LARGE_SHARE = 0.125
#: Rounds of column generation.
MAX_ROUNDS = 400

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# --- the plan, from the histogram -------------------------------------------


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits: the best of one item, two items and
    so on, for all capacities at once."""
    picked = [0] * len(sizes)
    order = np.flatnonzero(values > 1e-12)
    if not len(order):
        return 0.0, picked
    size, value = np.array(sizes)[order], values[order]
    best, last = np.zeros(capacity + 1), []
    for _ in range(capacity // int(size.min())):
        # Row i: what each capacity is worth with one more item of size i.
        padded = np.concatenate([np.full(capacity, -1e9), best])
        gain = np.lib.stride_tricks.sliding_window_view(padded, capacity + 1)[capacity - size] + value[:, None]
        k = gain.argmax(0)
        top = np.take_along_axis(gain, k[None], 0)[0]
        better = top > best + 1e-12
        if not better.any():
            break
        last.append(np.where(better, order[k], -1))
        best = np.where(better, top, best)
    room = capacity
    for of in reversed(last):
        if of[room] >= 0:
            picked[of[room]] += 1
            room -= sizes[of[room]]
    return float(best[capacity]), picked


def configurations(sizes: list[int], need: list[int], capacity: int, max_rounds: int = MAX_ROUNDS) -> list[tuple[list[int], int]]:
    """Whole numbers of configurations that hold at most `need` items of each size:
    the fractional optimum by column generation, rounded down."""
    m = len(sizes)
    columns = [[capacity // s if i == j else 0 for j in range(m)] for i, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    demand = np.array(need, float)
    for _ in range(max_rounds):
        duals = np.linalg.solve(basis.T, np.ones(m))
        worth, picked = best_configuration(sizes, duals, capacity)
        if worth <= 1 + 1e-7:
            break
        amount = np.linalg.solve(basis, demand)
        step = np.linalg.solve(basis, np.array(picked, float))
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = picked
        basis[:, out] = picked
    amount = np.linalg.solve(basis, demand)
    left, chosen = list(need), []
    for column, x in sorted(zip(columns, amount.tolist(), strict=True), key=lambda c: -c[1]):
        n = int(x + 1e-9)
        n = min([n, *(left[i] // k for i, k in enumerate(column) if k)])
        if n > 0:
            chosen.append((column, n))
            left = [a - n * k for a, k in zip(left, column, strict=True)]
    return chosen


class Bins:
    """Runs of equal sequences by free room: `free[room]` is a list of (first sequence, count)."""

    def __init__(self) -> None:
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.free or not self.free[room]:
                bisect.insort(self.rooms, room)
            self.free[room].append((first, count))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Take out a run with the least room of at least `length`."""
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, count = self.free[room].pop()
        if not self.free[room]:
            del self.free[room]
            self.rooms.pop(k)
        return room, first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY, n_groups: tuple[int, ...] = N_GROUPS) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place every
    piece of the histogram, and the number of sequences: the best of the groupings."""
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    found = None
    for n in n_groups:
        now = grouped_plan(counts, capacity, n)
        if found is None or now[1] < found[1]:
            found = now
        if found[1] <= least:
            break  # no plan has fewer
    return found


def equal_groups(counts: dict[int, int], lengths: list[int], n_groups: int) -> tuple[list[int], list[int]]:
    """Lengths, longest first, in groups of about equal count: the largest length and the
    count of each. A length lies in one group."""
    quota = -(-sum(counts[k] for k in lengths) // n_groups)
    sizes, need = [], []
    for k in lengths:
        if not sizes or need[-1] >= quota:
            sizes.append(k)
            need.append(0)
        need[-1] += counts[k]
    return sizes, need


class Stock:
    """Pieces left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: int(n) for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def longest(self, limit: int, used: dict[int, int]) -> int:
        """The longest length up to `limit` with a piece beside those used; 0 if there is none."""
        i = bisect.bisect_right(self.lengths, limit) - 1
        while i >= 0 and self.left[self.lengths[i]] <= used.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0


def substituted(stock: Stock, places: list[int], capacity: int, least: float) -> dict[int, int]:
    """Actual pieces for the places of one configuration, and further ones of more than
    `least` that fit: {length: pieces}."""
    room, used = capacity, {}
    at = 0
    while True:
        length = stock.longest(min(places[at], room) if at < len(places) - 1 else room, used)
        if length > least:
            used[length] = used.get(length, 0) + 1
            room -= length
        elif at >= len(places) - 1:
            return used
        at += 1


def grouped_plan(counts: dict[int, int], capacity: int, n_groups: int) -> tuple[np.ndarray, int]:
    """The plan with large lengths rounded up to `n_groups` groups."""
    runs: list[tuple[int, int, int, int, int]] = []
    stock = Stock(counts)
    ranks = dict.fromkeys(stock.left, 0)  # pieces of each length placed so far
    n_seq = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, ranks[length], count, first, offset))
        ranks[length] += count
        stock.take(length, count)

    if capacity in stock.left:
        n_seq = stock.left[capacity]
        put(capacity, n_seq, 0, 0)
    bins, least = Bins(), capacity * LARGE_SHARE
    large = [k for k in reversed(stock.lengths) if k > least]
    if large:
        sizes, need = equal_groups(stock.left, large, n_groups)
        chosen = [([sizes[i] for i, k in enumerate(column) for _ in range(k)], times) for column, times in configurations(sizes, need, capacity)]
        for places, times in sorted(chosen, reverse=True):
            while times:
                used = substituted(stock, places, capacity, least)
                if not used:
                    break
                # As many sequences of these very lengths as there are pieces for.
                m = min(times, *(stock.left[k] // n for k, n in used.items()))
                offset = 0
                for length, n in used.items():
                    for _ in range(n):
                        put(length, m, n_seq, offset)
                        offset += length
                bins.add(capacity - offset, n_seq, m)
                n_seq += m
                times -= m
    for length in reversed(list(stock.lengths)):
        while length in stock.left:
            found = bins.tightest(length)
            if found is None:
                m = -(-stock.left[length] // (capacity // length))
                found = capacity, n_seq, m
                n_seq += m
            room, first, count = found
            m = min(count, stock.left[length])
            put(length, m, first, capacity - room)
            bins.add(room - length, first, m)
            bins.add(room, first + m, count - m)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), n_seq


# --- Spark jobs -------------------------------------------------------------


def pieces(docs: DataFrame, vocab_file: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode each document, append end_id, cut what is longer than the capacity.
    part and nth number the pieces of one length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocab_file)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for i, raw in enc.encode(batch.column(1).to_pylist()):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    n = len(ids) // 4
                    out.append((keys[i], piece, at // 4, n, zlib.crc32(ids), part, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocab_file: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, vocab_file, end_id, capacity), "op10-pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs, _ = plan({r.length: r.n for r in histogram}, capacity)
    shared = spark.sparkContext.broadcast(runs)  # rows bounded by lengths and configurations

    before = Window.partitionBy("length").orderBy("part")
    base = by_part.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # Runs are sorted by (length, first rank), so one search finds a piece's run.
        spread = 1 << 44
        starts = table[:, 0] * spread + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = np.searchsorted(starts, length * spread + rank, side="right") - 1
            out = [*batch.columns[:5], pa.array(table[run, 3] + rank - table[run, 1]), pa.array(table[run, 4])]
            yield pa.record_batch(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
