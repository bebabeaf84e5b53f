"""Merging of residues into columns within one alignment, and checks of column graphs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of columns that are remembered to stay apart; beyond, they are found anew.
REFUSED = 1_000_000


class Columns:
    """Residues of one alignment, numbered along its sequences, merged into columns.

    A merge is allowed if the two columns have no sequence in common and no path of
    successive residues leads from one to the other. Columns are kept in an order that all
    such paths follow, so that only one direction is searched, and no further than the
    later column's place; a merge reorders the columns between the two places."""

    def __init__(self, lengths: list[int]):
        self.first, n = [], 0
        for length in lengths:
            self.first.append(n)
            n += length
        self.sequence = [s for s, length in enumerate(lengths) for _ in range(length)]
        self.last = {f + length - 1 for f, length in zip(self.first, lengths, strict=True) if length}
        self.column = list(range(n))
        self.members: dict[int, list[int]] = {r: [r] for r in range(n)}
        #: The sequences of each column as bits; residues of a sequence share one number.
        bit = [1 << s for s in range(len(lengths))]
        self.bits = [bit[s] for s in self.sequence]
        # At first by the share of its sequence that comes before a residue.
        self.order: list[int | None] = sorted(range(n), key=lambda r: ((r - self.first[self.sequence[r]]) / (1 + lengths[self.sequence[r]]), r))
        self.rank = [0] * n
        for i, c in enumerate(self.order):
            self.rank[c] = i
        #: Pairs of columns that a path joins: paths only grow, so that they stay apart.
        self.refused: set[tuple[int, int]] = set()

    def residue(self, sequence: int, position: int) -> int:
        return self.first[sequence] + position

    def place(self, residue: int) -> tuple[int, int]:
        s = self.sequence[residue]
        return s, residue - self.first[s]

    def behind(self, source: int, target: int) -> set[int] | None:
        """The columns that paths from `source` reach before the place of `target`; None if
        one reaches `target` itself. `source` comes before `target`."""
        goal, bound = self.bits[target], self.rank[target]
        stack, seen = [source], {source}
        while stack:
            for r in self.members[stack.pop()]:
                if r in self.last:
                    continue
                after = self.column[r + 1]
                if after == target:
                    return None
                if after in seen or self.rank[after] > bound:
                    continue
                # A column before the target's place that shares a sequence leads to it.
                if self.bits[after] & goal:
                    return None
                seen.add(after)
                stack.append(after)
        return seen

    def mergeable(self, a: int, b: int) -> tuple[int, int, set[int]] | None:
        """The columns of residues a and b in order, and what lies behind the first; None if
        they may not be merged, or are one already."""
        x, y = self.column[a], self.column[b]
        if x == y or self.bits[x] & self.bits[y]:
            return None
        if self.rank[x] > self.rank[y]:
            x, y = y, x
        if (x, y) in self.refused or (y, x) in self.refused:
            return None
        seen = self.behind(x, y)
        if seen is None:
            if len(self.refused) >= REFUSED:
                self.refused.clear()
            self.refused.add((x, y))
            return None
        return x, y, seen

    def may_fit(self, a: int, b: int) -> bool:
        """False where residues a and b are known to be one column or to stay apart."""
        x, y = self.column[a], self.column[b]
        return x != y and not self.bits[x] & self.bits[y] and (x, y) not in self.refused and (y, x) not in self.refused

    def allowed(self, a: int, b: int) -> bool:
        return self.mergeable(a, b) is not None

    def blocked(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): may columns i and j not be merged, or are they one? And each residue's
        column there. Columns that share a sequence are joined by a path along it."""
        live = [c for c in self.order if c is not None]
        number = {c: i for i, c in enumerate(live)}
        at = [number[c] for c in self.column]
        reach = np.eye(len(live), dtype=bool)
        for i in range(len(live) - 1, -1, -1):
            for r in self.members[live[i]]:
                if r not in self.last:
                    reach[i] |= reach[at[r + 1]]
        return reach | reach.T, np.array(at, np.int64)

    def merge(self, a: int, b: int) -> bool:
        found = self.mergeable(a, b)
        if found is None:
            return False
        x, y, seen = found
        low, high = self.rank[x], self.rank[y]
        kept, gone = (x, y) if len(self.members[x]) >= len(self.members[y]) else (y, x)
        between = [c for c in self.order[low + 1 : high] if c is not None]
        moved = [*(c for c in between if c not in seen), kept, *(c for c in between if c in seen)]
        self.order[low : high + 1] = moved + [None] * (high + 1 - low - len(moved))
        for i, c in enumerate(moved, low):
            self.rank[c] = i
        taken = self.members.pop(gone)
        for r in taken:
            self.column[r] = kept
        self.members[kept].extend(taken)
        self.bits[kept] |= self.bits[gone]
        return True

    def merge_all(self, left: Iterable[int], right: Iterable[int]) -> list[bool]:
        """merge for each of two lists' residues in turn."""
        column, bits, refused, merge, out = self.column, self.bits, self.refused, self.merge, []
        for a, b in zip(left, right, strict=True):
            x, y = column[a], column[b]
            out.append(x != y and not bits[x] & bits[y] and (x, y) not in refused and merge(a, b))
        return out

    def groups(self) -> Iterable[list[int]]:
        return self.members.values()


def depths(nodes: Iterable, arcs: Iterable[tuple]) -> dict:
    """The length of the longest path to each node; nodes on or behind a cycle have none."""
    after: dict = {v: set() for v in nodes}
    waiting = dict.fromkeys(after, 0)
    for a, b in arcs:
        if b not in after[a]:
            after[a].add(b)
            waiting[b] += 1
    ready, out = [v for v, n in waiting.items() if not n], {}
    depth = 0
    while ready:
        behind = []
        for v in ready:
            out[v] = depth
            for w in after[v]:
                waiting[w] -= 1
                if not waiting[w]:
                    behind.append(w)
        ready, depth = behind, depth + 1
    return out


# --- many alignments at once ------------------------------------------------


def whole(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows that come by alignment (the first column), about so many or more together, cut
    only where another alignment begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            ids = coded(pa.concat_arrays([held[-1].column(0)[-1:], batch.column(0)]))
            goes_on = np.flatnonzero(ids != ids[0])
            cut = int(goes_on[0]) - 1 if len(goes_on) else batch.num_rows
            held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield as_one(held)
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield as_one(held)


def as_one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def coded(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, from 1; 0 for null."""
    found = values.dictionary_encode()
    rank = np.zeros(len(found.dictionary) + 1, np.int64)
    rank[np.asarray(pc.sort_indices(found.dictionary))] = np.arange(1, len(found.dictionary) + 1)
    return rank[found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)]


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that links join it to."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := least[least], least):
            least = further


def layers(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """depths of nodes by number; -1 on or behind a cycle."""
    after = dst[np.argsort(src, kind="stable")]
    start = np.append(0, np.cumsum(np.bincount(src, minlength=n)))
    waiting, out, depth = np.bincount(dst, minlength=n), np.full(n, -1), 0
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        out[ready] = depth
        count = start[ready + 1] - start[ready]
        reached = after[np.repeat(start[ready] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        np.subtract.at(waiting, reached, 1)
        ready, depth = np.unique(reached[waiting[reached] == 0]), depth + 1
    return out
