"""Suffixes and common prefixes by external induced sorting.

A suffix that begins with a greater symbol than its neighbour's is large, else
small; small ones behind large ones are the seeds. The parts between seeds are
sorted and named, names that tie look some parts ahead, the string of names is
sorted by recursion where ties are left, and from its order all large suffixes are induced upwards, then all small ones downwards: a suffix
that is taken from the queue puts the suffix before it there, with its first
symbol and the taken one's place in the order as key. Common prefixes go the same
way: that of two suffixes induced in one bucket is one more than the least
between their origins.

The queue holds its tuples in ranges of first symbols, and writes them to a
temporary file beyond ``room``; the file has no name, so it is gone with the task.
Tuples are taken in batches: all that come before anything the batch can induce.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Common prefixes are known up to this length, if no other is asked for.
CAP = 255
#: Parts that a name looks ahead before there is a recursion.
LOOK = 1 << 16
#: Ranges of first symbols of a queue, and tuples (of 8 bytes) it holds in memory.
RANGES = 64
ROOM = 8_000_000


_NONE = np.int32((1 << 31) - 1)


class Queue:
    """Tuples (place, rank) by range of first symbols, in the order in which they came."""

    def __init__(self, ranges: int, room: int = ROOM):
        self.held: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(ranges)]
        self.size, self.room, self.file = 0, room, None

    def push(self, home: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(home, kind="stable")
        home, rows = home[order], np.empty((len(home), 2), dtype=np.int32)
        rows[:, 0], rows[:, 1] = place[order], rank[order]
        begin = 0
        for end in [*((home[1:] != home[:-1]).nonzero()[0] + 1).tolist(), len(home)]:
            self.held[home[begin]].append(rows[begin:end])
            begin = end
        self.size += len(rows)
        if self.size > self.room:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for runs, parts in zip(self.runs, self.held, strict=True):
            if parts:
                rows = np.concatenate(parts)
                runs.append((self.file.seek(0, 2), len(rows)))
                rows.tofile(self.file)
                parts.clear()
        self.size = 0

    def pop(self, home: int) -> np.ndarray:
        parts = []
        for at, n in self.runs[home]:
            self.file.seek(at)
            parts.append(np.fromfile(self.file, dtype=np.int32, count=2 * n).reshape(-1, 2))
        parts += self.held[home]
        self.size -= sum(map(len, self.held[home]))
        self.held[home], self.runs[home] = [], []
        return np.concatenate(parts) if parts else np.empty((0, 2), dtype=np.int32)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Minima:
    """Least values of ranges of a sequence that grows."""

    def __init__(self, n: int):
        self.n = max(1, n)
        self.table = np.zeros((self.n.bit_length(), self.n), dtype=np.uint8)

    def append(self, at: int, values: np.ndarray) -> None:
        t, end = self.table, at + len(values)
        t[0, at:end] = values
        half = 1
        for k in range(1, len(t)):
            low = max(at, 2 * half - 1)
            if low < end:
                np.minimum(t[k - 1, low:end], t[k - 1, low - half : end - half], out=t[k, low:end])
            elif 2 * half > end:
                break
            half *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of first..last, both included."""
        k = np.frexp((last - first + 1).astype(np.float64))[1].astype(np.int32) - 1
        return np.minimum(self.table[k, last], self.table[k, first + (1 << k) - 1])


def _induced(t: np.ndarray, kind: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, cap: int, room: int):
    """Order of the suffixes of a kind and of the seeds: (places, common prefix with the one before).

    ``seeds`` are in order, and come behind the induced suffixes with the same first symbol.
    """
    top = int(t.max()) + 1
    total = int(kind.sum()) + len(seeds)
    counts = np.cumsum(np.bincount(t[kind], minlength=top))
    range_of = (counts - 1) * RANGES // max(1, int(counts[-1])) if top > 4 * RANGES else np.arange(top)
    range_of = np.maximum(range_of, 0).astype(np.int16)
    ranges = int(range_of[-1]) + 1
    places, prefix = np.empty(total, dtype=np.int32), np.zeros(total, dtype=np.uint8)
    queue, minima, done = Queue(ranges, room), Minima(total), 0
    seed_char = t[seeds]
    seed_range = range_of[seed_char]
    seed_from = np.searchsorted(seed_range, np.arange(ranges + 1))
    last = (-1, False, 0, 0)  # first symbol, whether a seed, place, rank of the last one taken
    for b in range(ranges):
        rows = queue.pop(b)
        rows = rows[np.argsort(t[rows[:, 0]], kind="stable")]
        place, rank = rows[:, 0], rows[:, 1]
        char = t[place]
        s, stop, size = int(seed_from[b]), int(seed_from[b + 1]), 64
        while len(place) or s < stop:
            e = min(stop, s + size)
            if s == e:
                key, own, origin = 2 * char[:size], place[:size], rank[:size]
            elif not len(place):
                key, own, origin = 2 * seed_char[s:e] + 1, seeds[s:e], np.arange(s, e, dtype=np.int32)
            else:
                key = np.concatenate([2 * char[:size], 2 * seed_char[s:e] + 1])
                order = np.argsort(key, kind="stable")[:size]
                key = key[order]
                own = np.concatenate([place[:size], seeds[s:e]])[order]
                origin = np.concatenate([rank[:size], np.arange(s, e, dtype=np.int32)])[order]
            before = own - 1
            induces = (own > 0) & kind[before]
            bound = np.where(induces, 2 * t[before], _NONE)
            late = (key[1:] > np.minimum.accumulate(bound)[:-1]).nonzero()[0]
            m = int(late[0]) + 1 if len(late) else len(key)
            size = 2 * size if m == len(key) else max(64, 2 * m)
            key, own, origin, before, induces = key[:m], own[:m], origin[:m], before[:m], induces[:m]

            # common prefix with the one before, which is in front of the arrays now
            c = np.empty(m + 1, dtype=np.int32)
            seeded, owns, origins = np.empty(m + 1, dtype=bool), np.empty(m + 1, dtype=np.int32), np.empty(m + 1, dtype=np.int32)
            c[0], seeded[0], owns[0], origins[0] = last
            np.right_shift(key, 1, out=c[1:])
            np.not_equal(key & 1, 0, out=seeded[1:])
            owns[1:], origins[1:] = own, origin
            last = (c[m], seeded[m], owns[m], origins[m])
            lcp = np.zeros(m, dtype=np.uint8)
            same = c[1:] == c[:-1]
            both = (same & ~seeded[1:]).nonzero()[0]
            if len(both):
                lcp[both] = np.minimum(minima.least(origins[both] + 1, origins[both + 1]), cap - 1) + 1
            if seeded[m] or seeded.any():
                pair = (same & seeded[:-1] & seeded[1:]).nonzero()[0]
                lcp[pair] = seed_lcp[origins[pair + 1]]
                edge = (same & seeded[1:] & ~seeded[:-1]).nonzero()[0]
                lcp[edge] = np.minimum(np.minimum(runs[owns[edge]], runs[owns[edge + 1]]), cap)
            places[done : done + m], prefix[done : done + m] = own, lcp
            minima.append(done, lcp)

            taken = int(np.count_nonzero(seeded[1:]))
            s += taken
            place, rank, char = place[m - taken :], rank[m - taken :], char[m - taken :]
            new = induces.nonzero()[0]
            if len(new):
                p, r = before[new], (done + new).astype(np.int32)
                pc = bound[new] >> 1
                home = range_of[pc]
                here = home == b
                n_here = int(np.count_nonzero(here))
                if n_here:
                    char = np.concatenate([char, pc[here]])
                    order = np.argsort(char, kind="stable")
                    char = char[order]
                    place, rank = np.concatenate([place, p[here]])[order], np.concatenate([rank, r[here]])[order]
                if n_here < len(new):
                    away = ~here
                    queue.push(home[away], p[away], r[away])
            done += m
    queue.close()
    return places, prefix


def _named(t: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Names of the parts from each seed to the next (included), from 0 by their order;
    a part that begins another one comes behind it."""
    n, top = len(seeds), int(t.max()) + 1
    size = np.r_[np.diff(seeds) + 1, 1]
    bits = max(1, top.bit_length())
    width = max(1, 62 // bits)

    def packed(rows: np.ndarray, skip: int) -> np.ndarray:
        key, start, length = np.zeros(len(rows), dtype=np.int64), seeds[rows], size[rows]
        for k in range(skip, skip + width):
            inside = k < length
            key = key << bits | np.where(inside, t[np.where(inside, start + k, 0)], top)
        return key

    rows, skip = np.arange(n), 0
    rank = np.zeros(n, dtype=np.int64)
    while len(rows):
        key = packed(rows, skip)
        order = np.lexsort((key, rank[rows])) if skip else np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        old = rank[rows]
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(rows))
        starts = np.maximum.accumulate(np.where(part, at, 0))
        rank[rows] = old + starts - np.maximum.accumulate(np.where(group, at, 0))
        skip += width
        # go on with parts of groups of several, some of which aren't at their end
        number = np.cumsum(part) - 1
        many, longest = np.bincount(number) > 1, np.zeros(number[-1] + 1, dtype=np.int64)
        np.maximum.at(longest, number, size[rows])
        rows = rows[(many & (longest > skip))[number]]
    used = np.zeros(n, dtype=np.int64)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank]


def _looked_ahead(names: np.ndarray, parts: int = LOOK) -> np.ndarray:
    """Names by the order of up to ``parts`` parts: twice as many with each round, of names that still tie only."""
    rank, ahead = (np.cumsum(np.bincount(names)) - np.bincount(names))[names], 1
    many = np.bincount(names) > 1
    rows = np.flatnonzero(many[names])
    while len(rows) and ahead < parts:
        key = rank[np.minimum(rows + ahead, len(names) - 1)]
        order = np.lexsort((key, rank[rows]))
        rows, key = rows[order], key[order]
        old, at = rank[rows], np.arange(len(rows))
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, key[1:] != key[:-1]]
        starts = np.maximum.accumulate(np.where(part, at, 0))
        rank[rows] = old + starts - np.maximum.accumulate(np.where(group, at, 0))
        number = np.cumsum(part) - 1
        rows = rows[(np.bincount(number) > 1)[number]]
        ahead *= 2
    used = np.zeros(len(names), dtype=np.int64)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank]


def _seed_prefixes(t: np.ndarray, seeds: np.ndarray, order: np.ndarray, lcp: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours among the sorted seeds, from those of their names on."""
    found = np.zeros(len(order), dtype=np.uint8)
    if len(order) < 2:
        return found
    h = lcp[1:].astype(np.int32)
    x, y = seeds[order[:-1] + h], seeds[order[1:] + h]
    length = x - seeds[order[:-1]]
    live = np.flatnonzero(length < cap)
    if int(t.max()) < 1 << 15:  # four symbols at once first
        four = np.zeros(len(t), dtype=np.int64)
        for k in range(4):
            four[: len(t) - k] |= t[k:].astype(np.int64) << 16 * k
        some = live
        while len(some):
            some = some[four[x[some]] == four[y[some]]]
            x[some] += 4
            y[some] += 4
            length[some] += 4
            some = some[length[some] < cap]
        live = live[length[live] < cap]
    while len(live):
        live = live[t[x[live]] == t[y[live]]]
        x[live] += 1
        y[live] += 1
        length[live] += 1
        live = live[length[live] < cap]
    found[1:] = np.minimum(length, cap)
    return found


def suffixes(t: np.ndarray, cap: int = CAP, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and their common prefixes with the one before (``cap`` at most).

    ``t``: up to 2^30 whole numbers from 0 to below 2^30; its last symbol is 0 and occurs nowhere else.
    """
    t, n = np.asarray(t, dtype=np.int32), len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.uint8)
    at = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype=np.int32), np.int32(n))
    ends = np.minimum.accumulate(at[::-1])[::-1]  # last place of the run of equal symbols
    small = np.r_[(t[:-1] < t[1:])[ends], True]
    runs = np.r_[ends - np.arange(n - 1, dtype=np.int32) + np.int32(1), np.int32(1)]
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    names = _looked_ahead(_named(t, seeds))
    if int(names.max()) + 1 == len(seeds):
        order, lcp = np.argsort(names).astype(np.int32), np.zeros(len(seeds), dtype=np.uint8)
    else:
        order, lcp = suffixes(names, cap, room)
    lcp = _seed_prefixes(t, seeds, order, lcp, cap)
    places, prefix = _induced(t, ~small, runs, seeds[order], lcp, cap, room)
    large = ~small[places]
    down, between = places[large][::-1], np.r_[np.uint8(0), prefix[large][:0:-1]]
    small[-1] = False  # the end is nobody's predecessor, and comes first
    places, prefix = _induced(t.max() - t, small, runs, down, between, cap, room)
    return np.r_[np.int32(n - 1), places[::-1]], np.r_[np.zeros(2, dtype=np.uint8), prefix[:0:-1]]
