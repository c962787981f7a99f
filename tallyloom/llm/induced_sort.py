"""Suffix sorting with common prefixes by external induced sorting.

A suffix is of type S if it is less than the next one, else of type L; an S after
an L begins a substring (S*). The sorted S* suffixes induce all L suffixes, these
induce all S suffixes. What waits to be induced is held in priority queues ordered
by first symbol and then by the order in which the suffix was found; a tuple is a
suffix's position and its common prefix with the one before it.

Bytes. For one first byte a queue is first in, first out, so the queue of a text is
256 sequences of blocks. A bucket is taken out in passes over arrays of bounded
size: a suffix induced into the bucket that is being read is met in its next pass.
Common prefixes are carried with the tuples: two suffixes induced one after the
other into a bucket share one byte more than the least common prefix between
their sources.

Recursion. The S* substrings are sorted by groups of first bytes and named in
order; the sequence of names is sorted in the same way, with a heap whose sorted
runs go to disk as queue, until a sequence has at most ``BASE`` symbols: these are
ordered in memory by doubling. Orders and common prefixes are settled up to
``depth`` bytes (names: as many as may cover these); common prefixes of the S*
suffixes are read off the text.

Memory. Blocks of queues and of the result beyond ``memory`` bytes, and vectors
that are larger than a part of it (the text, its types, positions, names), are in
files of the task, which have no names and are gone when the sort ends or its
process dies; a task that is run again begins anew. The result is told in blocks.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples in memory, tuples handled at a time, symbols that are sorted in memory.
MEMORY = 96 << 20
CHUNK = 1 << 18
BASE = 4 << 20


class Memory:
    """What one sort may hold in tuples; what is beyond goes to a file."""

    def __init__(self, bound: int = MEMORY, folder: str | None = None):
        self.bound, self.left, self.folder = bound, bound, folder
        self.stores: list[Store] = []
        self.file, self.end, self.spilled = None, 0, 0

    def vector(self, n: int, kind) -> np.ndarray:
        size = int(n) * np.dtype(kind).itemsize
        if size <= self.bound // 4:
            return np.zeros(n, kind)
        self.spilled += size
        return np.memmap(tempfile.TemporaryFile(dir=self.folder), kind, "w+", shape=(int(n),))

    def hold(self, size: int) -> None:
        if self.left < size:
            for store in self.stores:
                store.spill()
        self.left -= size

    def write(self, data: bytes) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(self.end)
        self.file.write(data)
        at, self.end = self.end, self.end + len(data)
        self.spilled += len(data)
        return at

    def read(self, at: int, n: int, kind) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)


class Store:
    """Tuples (position, common prefix) in the order in which they were put."""

    def __init__(self, memory: Memory, kind):
        self.memory, self.kind = memory, kind
        self.blocks: list = []  # (positions, prefixes), or (offset, number) of a block on disk
        memory.stores.append(self)

    def __bool__(self) -> bool:
        return bool(self.blocks)

    def put(self, at: np.ndarray, lcp: np.ndarray) -> None:
        if len(at):
            at, lcp = at.astype(self.kind), lcp.astype(np.int32)
            self.memory.hold(at.nbytes + lcp.nbytes)
            self.blocks.append((at, lcp))

    def spill(self) -> None:
        k = len(self.blocks)
        while k and isinstance(self.blocks[k - 1][0], np.ndarray):
            k -= 1
        held = self.blocks[k:]
        if held:
            at, lcp = (np.concatenate(x) for x in zip(*held))
            self.memory.left += at.nbytes + lcp.nbytes
            self.blocks[k:] = [(self.memory.write(at.tobytes() + lcp.tobytes()), len(at))]

    def _chunks(self, block, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(block[0]) if isinstance(block[0], np.ndarray) else block[1]
        cuts = range(0, n, CHUNK)
        for a in reversed(cuts) if back else cuts:
            b = min(n, a + CHUNK)
            if isinstance(block[0], np.ndarray):
                yield block[0][a:b], block[1][a:b]
            else:
                size = np.dtype(self.kind).itemsize
                yield self.memory.read(block[0] + a * size, b - a, self.kind), self.memory.read(block[0] + n * size + 4 * a, b - a, np.int32)

    def _joined(self, blocks, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for block in blocks:
            for part in self._chunks(block, back):
                if held and size + len(part[0]) > CHUNK:
                    yield tuple(np.concatenate(x) for x in zip(*(held[::-1] if back else held)))
                    held, size = [], 0
                held.append(part)
                size += len(part[0])
        if held:
            yield tuple(np.concatenate(x) for x in zip(*(held[::-1] if back else held)))

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All that was put so far, in arrays of bounded size; what is put meanwhile waits."""
        blocks, self.blocks = self.blocks, []
        self.memory.left += sum(x[0].nbytes + x[1].nbytes for x in blocks if isinstance(x[0], np.ndarray))
        yield from self._joined(blocks)

    def forwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._joined(list(self.blocks))

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From the last to the first, each with what it shares with the one told before (0 for the first told)."""
        before = 0
        for at, lcp in self._joined(list(self.blocks)[::-1], back=True):
            yield at[::-1], np.concatenate([[before], lcp[1:][::-1]])
            before = int(lcp[0])


def types(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S, into ``out``; the last is L (a virtual end below all symbols follows)."""
    n = len(text)
    for a in range((max(n - 2, 0)) // CHUNK * CHUNK, -1, -CHUNK):
        b = min(n - 1, a + CHUNK)
        if b <= a:
            continue
        part = np.asarray(text[a : b + 1])
        differs = np.append(part[:-1] != part[1:], True)
        less = np.append(part[:-1] < part[1:], out[b])
        place = np.where(differs, np.arange(b - a + 1), b - a)
        out[a:b] = less[np.minimum.accumulate(place[::-1])[::-1][:-1]]
    return out


def stars_of(is_s: np.ndarray, memory: Memory) -> np.ndarray:
    """Positions of the S* suffixes."""
    n = len(is_s)
    found = lambda a: np.flatnonzero(is_s[a + 1 : a + CHUNK + 1] & ~is_s[a : a + CHUNK][: max(0, min(CHUNK, n - a - 1))]) + a + 1
    out = memory.vector(sum(len(found(a)) for a in range(0, n, CHUNK)), np.int64)
    at = 0
    for a in range(0, n, CHUNK):
        some = found(a)
        out[at : at + len(some)] = some
        at += len(some)
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to ``depth``; eight at a time while as many are left."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    room = np.minimum(n - np.maximum(a, b), depth)
    live = np.flatnonzero(room >= 8)
    if len(live):
        eight = np.ndarray((n - 7,), np.uint64, np.ascontiguousarray(text), strides=(1,))
        while len(live):
            differ = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
            lowest = (differ & (~differ + np.uint64(1))) - np.uint64(1)  # ones below the first bit that differs
            out[live] += np.where(differ == 0, 8, np.bitwise_count(lowest) >> 3)
            live = live[(differ == 0) & (room[live] - out[live] >= 8)]
    # What is left has fewer than eight bytes to go, or a difference among the next ones.
    live = np.flatnonzero(out < room)
    for _ in range(8):
        if not len(live):
            break
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < room[live]]
    return out


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """As ``common_prefix``; pairs that lie equally far apart on one long match compare no byte of it twice.

    A pair is compared up to where the next one of its distance begins,
    and if all bytes are equal up to there, its match ends where the next one's ends.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    order = np.lexsort((a, a - b))
    a, b = a[order], b[order]
    gap = np.append(np.where(a[1:] - b[1:] == a[:-1] - b[:-1], np.diff(a), depth), depth)
    some = common_prefix(text, a, b, np.minimum(gap, depth))
    known = np.flatnonzero((gap >= depth) | (some < gap))
    at = np.searchsorted(known, np.arange(len(a)))
    out = np.empty(len(a), np.int64)
    out[order] = np.minimum((a + some)[known[at]] - a, depth)
    return out


# -- the order of the S* suffixes ----------------------------------------------


def _refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Splits the ranks of whole groups of rows by a key; a rank is the number of lesser entries."""
    bits = int(key.max()).bit_length() if len(key) else 0
    if int(rank[rows].max(initial=0)).bit_length() + bits < 63:
        both = rank[rows] << bits | key.astype(np.int64)
        order = np.argsort(both)
        both = both[order]
        part = np.concatenate([[True], both[1:] != both[:-1]])
        r = both >> bits
    else:
        order = np.lexsort((key, rank[rows]))
        r, k = rank[rows][order], key[order]
        part = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
    group = np.concatenate([[True], r[1:] != r[:-1]])
    at = np.arange(len(r))
    rank[rows[order]] = r + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _rank_substrings(text: np.ndarray, start: np.ndarray, span: np.ndarray, depth: int) -> np.ndarray:
    """Ranks (numbers of lesser ones) of substrings that go from a star to the next one, ``span`` bytes on.

    Where one ends and another goes on with equal symbols, the other's symbol there
    is of type L and so the lesser: an end counts as more. The text's end counts as less.
    """
    n = len(text)
    rank = np.zeros(len(start), np.int64)
    for at in range(0, depth, 6):
        rows = np.flatnonzero(span >= at - 1) if at else np.arange(len(start))  # whose end is still to come
        if at:
            rows = np.intersect1d(rows, _tied(rank), assume_unique=True)
        if not len(rows):
            break
        key = np.zeros(len(rows), np.int64)
        for j in range(at, at + 6):
            place = start[rows] + j
            symbol = np.where(place < n, text[np.minimum(place, n - 1)].astype(np.int64) + 1, 0)
            key = key << 9 | np.where(j <= span[rows], symbol, 511)
        _refine(rank, rows, key)
    return rank


def _double(rank: np.ndarray, reach: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a sequence of names (ranks), by doubling, until names cover ``depth``."""
    m, step = len(rank), 1
    reach = np.minimum(reach, depth)
    while step < m:
        rows = _tied(rank)
        rows = rows[reach[rows] < depth]
        if not len(rows):
            break
        behind = np.minimum(rows + step, m - 1)
        _refine(rank, rows, np.where(rows + step < m, rank[behind] + 1, 0))
        more = np.minimum(np.arange(m) + step, m - 1)
        reach = np.minimum(np.where(np.arange(m) + step < m, reach + reach[more], depth), depth)
        step *= 2
    return np.argsort(rank, kind="stable")


class Heap:
    """A priority queue of (symbol, number, position); sorted runs beyond the bound are on disk."""

    def __init__(self, memory: Memory, bound: int):
        self.memory, self.bound = memory, bound
        self.heap: list[tuple[int, int, int]] = []
        self.heads: list = []  # the first tuple of every run, and the rest of it

    def _run(self, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        for a in range(0, n, 4096):
            yield from map(tuple, self.memory.read(at + 24 * a, 3 * min(4096, n - a), np.int64).reshape(-1, 3).tolist())

    def push(self, item: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.bound:
            self.heap.sort()
            run = self._run(self.memory.write(np.array(self.heap, np.int64).tobytes()), len(self.heap))
            self.heap = []
            heapq.heappush(self.heads, (next(run), id(run), run))

    def least(self):
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, int, int]:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, key, run = self.heads[0]
        after = next(run, None)
        if after is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (after, key, run))
        return item


def order_of_names(names: np.ndarray, depth: int, memory: Memory, base: int) -> np.ndarray:
    """The order of the suffixes of a sequence of names, settled for ``depth`` names at least."""
    m = len(names)
    if m <= base or m < 4:
        _, rank = np.unique(names, return_inverse=True)
        lesser = np.concatenate([[0], np.cumsum(np.bincount(rank))])
        return _double(lesser[rank], np.ones(m, np.int64), depth)
    is_s = types(names, memory.vector(m, bool))
    stars = stars_of(is_s, memory)
    named = _named(names, stars, memory, base, lambda some, span: _rank_names(names, some, span))
    ordered = stars[order_of_names(named, max(1, depth // 2 + 1), memory, base)] if len(stars) else stars
    # L suffixes from the least name on, then S suffixes from the greatest.
    sorted_l = memory.vector(m - int(np.count_nonzero(is_s)), np.int64)
    heap, number, at, k = Heap(memory, base), 1, 0, 0
    heap.push((int(names[m - 1]), 0, m - 1))
    while (top := heap.least()) is not None or k < len(ordered):
        if top is not None and (k >= len(ordered) or top[0] <= names[ordered[k]]):
            i = heap.pop()[2]
            sorted_l[at] = i
            at += 1
        else:
            i, k = int(ordered[k]), k + 1
        if i and not is_s[i - 1]:
            heap.push((int(names[i - 1]), number, i - 1))
            number += 1
    out = memory.vector(m, np.int64)
    heap, at, k, free = Heap(memory, base), 0, len(sorted_l) - 1, m - 1
    while (top := heap.least()) is not None or k >= 0:
        if top is not None and (k < 0 or -top[0] >= names[sorted_l[k]]):
            i = heap.pop()[2]
        else:
            i, k = int(sorted_l[k]), k - 1
        out[free] = i
        free -= 1
        if i and is_s[i - 1]:
            heap.push((-int(names[i - 1]), number, i - 1))
            number += 1
    return out


def _rank_names(names: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Ranks of substrings of names, compared as in ``_rank_substrings``."""
    n, high = len(names), int(names.max()) + 2
    rank = np.zeros(len(start), np.int64)
    for j in range(int(span.max(initial=0)) + 2):
        rows = np.flatnonzero(span >= j - 1)
        rows = np.intersect1d(rows, _tied(rank), assume_unique=True) if j else rows
        if not len(rows):
            break
        place = start[rows] + j
        symbol = np.where(place < n, names[np.minimum(place, n - 1)] + 1, 0)
        _refine(rank, rows, np.where(j <= span[rows], symbol, high))
    return rank


def _named(seq: np.ndarray, stars: np.ndarray, memory: Memory, base: int, ranks) -> np.ndarray:
    """Names of the substrings from star to star, in their order; by groups of first symbols that fit in memory."""
    m = len(stars)
    names = memory.vector(m, np.int64)
    span_of = lambda some: np.where(some + 1 < m, stars[np.minimum(some + 1, m - 1)] - stars[some], len(seq))
    if m <= base:
        groups = iter([np.arange(m)])
    else:
        # Cuts between first symbols so that every group has about half of the bound (one symbol's at least).
        cuts = np.unique(seq[stars[np.linspace(0, m - 1, min(m, 65536)).astype(np.int64)]])
        count = np.zeros(len(cuts) + 1, np.int64)
        for a in range(0, m, CHUNK):
            count += np.bincount(np.searchsorted(cuts, seq[stars[a : a + CHUNK]], "right"), minlength=len(cuts) + 1)
        group_of = np.concatenate([[0], np.cumsum(count)[:-1]]) // max(1, base // 2)

        def parts():
            for g in np.unique(group_of[count > 0]):
                mine = [a + np.flatnonzero(group_of[np.searchsorted(cuts, seq[stars[a : a + CHUNK]], "right")] == g) for a in range(0, m, CHUNK)]
                yield np.concatenate(mine)

        groups = parts()
    before = 0
    for some in groups:
        names[some] = before + ranks(np.asarray(stars[some]), span_of(some))
        before += len(some)
    return names


def order_of_stars(text: np.ndarray, stars: np.ndarray, depth: int, memory: Memory, base: int) -> np.ndarray:
    """The S* suffixes in order, up to ``depth`` bytes."""
    m = len(stars)
    if m == 0:
        return stars
    names = _named(text, stars, memory, base, lambda some, span: _rank_substrings(text, some, span, depth))
    if m <= base:
        reach = np.diff(np.append(stars, len(text) + depth))
        return stars[_double(np.asarray(names), reach, depth)]
    return stars[order_of_names(names, depth // 2 + 1, memory, base)]


# -- induction -----------------------------------------------------------------


def _least_between(lcp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``lcp[first..last]`` for each range (first <= last), by a table of doubled ranges."""
    if not len(first):
        return np.zeros(0, lcp.dtype)
    length = last - first + 1
    out = lcp[first].copy()
    level, size, table = np.floor(np.log2(length)).astype(np.int64), 1, lcp
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - size + 1])
        table = np.minimum(table[:-size], table[size:]) if len(table) > size else table
        size *= 2
    return out


def sorted_suffixes(text: np.ndarray, depth: int, memory: Memory | None = None, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the positions of all suffixes in order, and each one's common prefix with the one before, up to ``depth``."""
    n = len(text)
    if n == 0:
        return
    memory = memory or Memory()
    kind = np.int32 if n < 1 << 31 else np.int64
    is_s = types(text, memory.vector(n, bool))
    stars = stars_of(is_s, memory)
    ordered = order_of_stars(text, stars, depth, memory, base)
    count = np.zeros(256, np.int64)
    for a in range(0, len(stars), CHUNK):
        count += np.bincount(text[stars[a : a + CHUNK]], minlength=256)
    star_from = np.concatenate([[0], np.cumsum(count)])
    star_lcp = memory.vector(len(stars), np.int32)  # with the star before
    for a in range(1, len(stars), CHUNK):
        some = np.asarray(ordered[a - 1 : a + CHUNK])
        star_lcp[a : a + CHUNK] = common_prefixes(text, some[:-1], some[1:], depth)

    def induce(queues, at, lcp, since, wanted):
        """Puts the suffixes one byte before those at ``at`` that are of the wanted type into their queues."""
        # since[c]: the least common prefix met since the last suffix that went to queue c.
        before = at.astype(np.int64) - 1
        ok = before >= 0
        ok[ok] = is_s[before[ok]] == wanted
        where = np.flatnonzero(ok)
        source = before[where]
        byte = text[source]
        order = np.argsort(byte, kind="stable")
        where, source, byte = where[order], source[order], byte[order]
        starts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(byte)).astype(np.int64)
        running = np.minimum.accumulate(lcp)
        found = np.zeros(len(byte), np.int64)
        inner = np.ones(len(byte), bool)
        inner[starts] = False
        i = np.flatnonzero(inner)
        found[i] = _least_between(lcp, where[i - 1] + 1, where[i])
        found[starts] = np.minimum(since[byte[starts]], running[where[starts]])
        found = np.where(found >= 0, np.minimum(found + 1, depth), 0)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        np.minimum(since, running[-1], out=since)
        for a, b in zip(starts.tolist(), ends.tolist()):
            c = int(byte[a])
            queues[c].put(source[a:b], found[a:b])
            w = int(where[b - 1])
            since[c] = tail[w + 1] if w + 1 < len(tail) else depth

    one = lambda a, b: int(common_prefix(text, np.array([a]), np.array([b]), depth)[0])

    # L suffixes, from the least byte to the greatest. The virtual end induces the last suffix.
    queues = [Store(memory, kind) for _ in range(256)]
    sorted_l = [Store(memory, kind) for _ in range(256)]
    since = np.full(256, -1, np.int64)
    # In order of reading: for each byte its L suffixes, then its S* suffixes.
    queues[int(text[n - 1])].put(np.array([n - 1]), np.array([0]))
    since[int(text[n - 1])] = 0
    for c in range(256):
        last = None
        while queues[c]:
            for at, lcp in queues[c].take():
                lcp = lcp.astype(np.int64)
                if last is None:
                    lcp[0] = 0
                sorted_l[c].put(at, lcp)
                last = int(at[-1])
                induce(queues, at, lcp, since, False)
        for a in range(int(star_from[c]), int(star_from[c + 1]), CHUNK):
            at = np.asarray(ordered[a : min(a + CHUNK, int(star_from[c + 1]))])
            lcp = np.concatenate([[0 if last is None else one(last, int(at[0]))], star_lcp[a + 1 : a + len(at)].astype(np.int64)])
            last = int(at[-1])
            induce(queues, at, lcp, since, False)

    # S suffixes, from the greatest byte to the least; reading backwards, a prefix is shared with the suffix read before.
    sorted_s = [Store(memory, kind) for _ in range(256)]
    since = np.full(256, -1, np.int64)
    for c in range(255, -1, -1):
        last = None  # nothing is shared with suffixes of another first byte
        while queues[c]:
            for at, lcp in queues[c].take():
                lcp = lcp.astype(np.int64)
                if last is None:
                    lcp[0] = 0
                sorted_s[c].put(at, lcp)
                last = int(at[-1])
                induce(queues, at, lcp, since, True)
        fresh = True
        for at, lcp in sorted_l[c].backwards():
            lcp = lcp.astype(np.int64)
            if fresh:
                lcp[0] = 0 if last is None else one(last, int(at[0]))
                fresh = False
            induce(queues, at, lcp, since, True)

    for c in range(256):
        last = None
        for at, lcp in sorted_l[c].forwards():
            last = int(at[-1])
            yield at.astype(np.int64), lcp.astype(np.int64)
        fresh = True
        for at, lcp in sorted_s[c].backwards():
            lcp = lcp.astype(np.int64)
            if fresh:
                lcp[0] = 0 if last is None else one(last, int(at[0]))
                fresh = False
            yield at.astype(np.int64), lcp


def suffix_array(data: bytes | np.ndarray, depth: int, memory: Memory | None = None, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of ``sorted_suffixes`` joined."""
    text = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    blocks = list(sorted_suffixes(text, depth, memory, base))
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*blocks))
