"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``length`` bytes over it also starts anywhere else, in
the same text or another. Shards are made so that equal strings meet: of the runs
of ``GRAM`` bytes in a string the one of least hash (the leftmost of equals) is
its anchor, which depends on its content alone; neighbouring strings with one
anchor are a segment, and a segment belongs to the shard of its anchor's hash.

Rounds over ranges of ids (see ``ranged``): 1 which anchors occur twice. A string
has an anchor by a second hash too; a string that repeats has both anchors twice,
so the strings around a passage that many texts share, in a context of their own,
mostly go no further. 2 The distinct runs of strings that are left, cut by anchor,
to their shards. There equal segments are told by their hash (all their strings
repeat), and where an anchor has several segments, one of each is suffix sorted
(``induced_sort``, external: beyond a bound of bytes in files): strings that share
``length`` bytes stand side by side. A bit for each string goes back, and with it the
range's own note of where its segments are; 3 removal, by these alone. A shard gets a segment once from each range, however often it occurs.

Defined results: null and empty texts, and those of fewer than ``length`` bytes,
keep all; rows that repeat an id are texts of their own; matches never cross
texts; an empty table gives an empty one; ids must be whole numbers (others raise
an error). Columns named like an output are
replaced, the text column by ``kept``, which is binary as cuts may fall inside
characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textops as tx
from .induced_sort import Memory, sorted_suffixes
from .ranged import ANSWER, Ranges, answered, grouped, in_order
from .ordered import RANGE
from .scratch import Scratch

LENGTH = 400
GRAM = 64
#: Bytes of texts whose strings are hashed at a time, and of segments that are sorted at a time (those of one anchor are
#: never parted: if they are more, the sort goes to files).
PART = 1 << 20
SORTED = 2 << 20
#: Bytes that are hashed at a time, and of how many hashes one is compared for the least first.
PIECE = 1 << 15
SHARE = 32
SECOND = np.uint64(0x5851F42D4C957F2D)
#: The round of the rows in which a range's note of its segments travels (as bucket -1 - range).
NOTE = 3
SEGMENTS = "bucket int, __range int, anchors binary, lengths binary, twice binary, data binary"


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    n = len(buf) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    piece = max(PIECE, 2 * size)
    inverse = tx._power_table(tx._INVERSE)
    for a in range(0, n, piece):
        m = min(piece, n - a)
        sums = tx.prefix_hash(buf[a : a + m + size - 1])
        out[a : a + m] = tx.mix((sums[size : size + m] - sums[:m]) * inverse[:m])
    return out


def _least_of_all(hashes: np.ndarray, window: int) -> np.ndarray:
    """Where the least hash of every window is, the leftmost of equals."""
    n = len(hashes) - window + 1
    _, rank = np.unique(hashes, return_inverse=True)
    keyed = rank.astype(np.int64) << 32 | np.arange(len(hashes))
    blocks = -(-len(keyed) // window)
    grid = np.full(blocks * window, np.iinfo(np.int64).max)
    grid[: len(keyed)] = keyed
    grid = grid.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & 0xFFFFFFFF


def _runs_of_least(hashes: np.ndarray, window: int, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """First window of every run of windows with one least hash, and where this is.

    Where a window has a hash among the least ``1 / share`` of all there may be, its
    least one is among these; only they are compared. Windows without are done by
    themselves, and all of them where small hashes are no rarer than others.
    """
    n = len(hashes) - window + 1
    place = np.flatnonzero(hashes < np.uint64((1 << 64) // share))
    if len(place) * window > 8 * n * max(1, window // share) or not len(place):
        least = _least_of_all(hashes, window)
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        return begin, least[begin]
    value = hashes[place]

    def nearest(live: np.ndarray, step: int, less) -> np.ndarray:
        """The nearest one on this side, less than a window away, with a lesser hash; -1 for none."""
        found, k = np.full(len(place), -1), step
        while len(live):
            live = live[(live + k >= 0) & (live + k < len(place))]
            live = live[np.abs(place[live + k] - place[live]) < window]
            is_less = less(value[live + k], value[live])
            found[live[is_less]] = place[live[is_less] + k]
            live, k = live[~is_less], k + step
        return found

    ends = np.append(value[1:] != value[:-1], True)  # of a row of equal ones the last finds for all
    after = nearest(np.flatnonzero(ends), 1, np.less)[ends][np.cumsum(ends) - ends]
    before = nearest(np.arange(len(place)), -1, np.less_equal)
    first = np.maximum(np.maximum(before + 1, place - window + 1), 0)
    last = np.minimum(np.minimum(np.where(after < 0, place, after - window), place), n - 1)
    mine = first <= last
    first, last, place = first[mine], last[mine], place[mine]
    gap_from, gap_to = np.append(0, last + 1), np.append(first, n)
    out_first, out_place = [first], [place]
    for g in np.flatnonzero(gap_from < gap_to).tolist():
        a, b = int(gap_from[g]), int(gap_to[g])
        least = _least_of_all(hashes[a : b + window - 1], window)
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        out_first.append(begin + a)
        out_place.append(least[begin] + a)
    first, place = np.concatenate(out_first), np.concatenate(out_place)
    order = np.argsort(first)
    return first[order], place[order]


def _cut(hashes: np.ndarray, window: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string and number of strings of every run of strings with one anchor within ``begin`` to ``end``."""
    first, anchor = _runs_of_least(hashes, window)
    starts = np.unique(np.concatenate([first, begin]))
    text = np.searchsorted(begin, starts, "right") - 1
    mine = text >= 0
    mine[mine] = starts[mine] < end[text[mine]]
    stop = np.append(starts[1:], len(hashes) - window + 1)
    starts, stop, text = starts[mine], stop[mine], text[mine]
    counts = np.minimum(stop, end[text]) - starts
    # The least of many hashes is small: mixed again, anchors spread over all shards.
    return tx.mix(hashes[anchor[np.searchsorted(first, starts, "right") - 1]] + SECOND), starts, counts


def segments(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(anchor hash, first string, number of strings) of every segment, by the first and by the second hash."""
    n = len(buf) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return ((none.astype(np.uint64), none, none),) * 2
    whole = off[1:] - off[:-1] >= length  # texts with strings
    begin, end = off[:-1][whole], off[1:][whole] - length + 1
    hashes = gram_hashes(buf, gram)
    return tuple(_cut(h, length - gram + 1, begin, end) for h in (hashes, hashes * SECOND))


class Texts:
    """Segments of the rows of one range."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.length = length
        self.buf, self.off = tx.buffers(table.column("text"))
        found: list[list] = [[], []]
        a = 0
        while a < len(self.off) - 1:  # whole texts of about a megabyte at a time
            b = max(a + 1, int(np.searchsorted(self.off, self.off[a] + PART, "right")) - 1)
            base = self.off[a]
            for part, (anchors, starts, counts) in zip(found, segments(self.buf[base : self.off[b]], self.off[a : b + 1] - base, length, gram)):
                part.append((anchors, starts + base, counts))
            a = b
        none = np.zeros(0, np.int64)
        (self.anchors, self.starts, self.counts), self.second = (
            tuple(np.concatenate(x) for x in zip(*part)) if part else (none.astype(np.uint64), none, none) for part in found
        )

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors by either hash, which of them occur twice here, and each segment's (those by the first hash come first)."""
        both = np.concatenate([self.anchors, self.second[0]])
        order, first, group = grouped(both)
        size = np.diff(np.append(first, len(order)))
        return both[order][first], size > 1, group

    def keep(self, often: np.ndarray, group: np.ndarray) -> None:
        """Cuts the segments down to runs of strings both of whose anchors occur twice."""
        one, two = often[group[: len(self.anchors)]], often[group[len(self.anchors) :]]
        n = len(self.buf)
        ok = np.zeros(n + 1, bool)
        for a, c in zip(self.second[1][two].tolist(), self.second[2][two].tolist()):
            ok[a : a + c] = True
        mine = np.zeros(n + 1, bool)
        cut = np.zeros(n + 1, bool)
        for a, c in zip(self.starts[one].tolist(), self.counts[one].tolist()):
            mine[a : a + c] = True
            cut[a] = True
        ok &= mine
        begin = ok.copy()
        begin[1:] &= ~ok[:-1] | cut[1:]
        end = ok.copy()
        end[:-1] &= ~ok[1:] | cut[1:]
        starts = np.flatnonzero(begin)
        whose = np.searchsorted(self.starts, starts, "right") - 1
        self.anchors, self.starts, self.counts = self.anchors[whose], starts, np.flatnonzero(end) + 1 - starts

    def shared(self, answers: pa.Table, bits: int):
        """Distinct segments with anchors that occur twice: rows in their order, and the group of every such segment."""
        anchors, here, group = self.asked()
        self.keep(answered(answers, 1, anchors, 64 - bits) | here, group)
        rows = np.arange(len(self.anchors))
        content = tx.span_hashes(self.buf, self.starts[rows], self.starts[rows] + self.counts[rows] + self.length - 1)
        order = np.lexsort((content, self.anchors[rows]))
        r, c = rows[order], content[order]
        new = np.ones(len(r), bool)
        new[1:] = (c[1:] != c[:-1]) | (self.anchors[r][1:] != self.anchors[r][:-1])
        number = np.empty(len(r), np.int64)
        number[order] = np.cumsum(new) - 1
        twice = np.diff(np.append(np.flatnonzero(new), len(r))) > 1
        return rows, number, r[new], twice



def _noted(starts: np.ndarray, counts: np.ndarray, number: np.ndarray, distinct: np.ndarray, bucket: np.ndarray, twice: np.ndarray) -> bytes:
    """What a range keeps of its segments until their bits are back."""
    head = np.array([len(starts), len(distinct)], np.int64)
    return b"".join(x.tobytes() for x in (head, starts.astype(np.int64), counts.astype(np.int32), number.astype(np.int32), distinct.astype(np.int32), bucket.astype(np.int32), np.packbits(twice)))


def _read_note(note: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(note, np.int64, 2).tolist()
    at, out = 16, []
    for kind, size in ((np.int64, n), (np.int32, n), (np.int32, n), (np.int32, m), (np.int32, m)):
        out.append(np.frombuffer(note, kind, size, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return [*out, np.unpackbits(np.frombuffer(note, np.uint8, offset=at), count=m).astype(bool)]


def repeated(n: int, answers: pa.Table, length: int) -> np.ndarray:
    """Which of the ``n`` bytes of a range go, by its note and the bits of its segments' strings."""
    edge = np.zeros(n + 1, np.int32)
    told = list(zip(*(answers.column(c).to_pylist() for c in ("round", "bucket", "bits"))))
    for note in (x for r, _, x in told if r == NOTE):
        starts, counts, number, distinct, bucket, twice = _read_note(note)
        at = np.concatenate([[0], np.cumsum(counts[distinct])])
        flag = np.zeros(at[-1], bool)
        for r, b, packed in told:
            if r == 2:
                lo, hi = at[np.searchsorted(bucket, b, "left")], at[np.searchsorted(bucket, b, "right")]
                flag[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo).astype(bool)
        flag |= np.repeat(twice, counts[distinct])
        for a in range(0, len(starts), 4096):
            own = counts[a : a + 4096]
            before = np.repeat(np.cumsum(own) - own, own)
            nth = np.arange(own.sum()) - before
            gone = (np.repeat(starts[a : a + 4096], own) + nth)[flag[np.repeat(at[number[a : a + 4096]], own) + nth]]
            edge[gone] += 1
            edge[gone + length] -= 1
    np.cumsum(edge, out=edge)
    return edge[:-1] > 0


def _gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty(int(lengths.sum()), buf.dtype)
    at = 0
    for a, n in zip(starts.tolist(), lengths.tolist()):
        out[at : at + n] = buf[a : a + n]
        at += n
    return out


def repeats_of(text: np.ndarray, valid: np.ndarray, length: int, memory: Memory) -> np.ndarray:
    """Which valid positions begin a string of ``length`` bytes that another valid position begins too."""
    found = memory.vector(len(text), bool)
    alone = -1  # a valid position of the run of equal strings that the last block ended in, if it is its only one yet
    many = False  # whether that run has two
    for at, lcp in sorted_suffixes(text, length, memory):
        new = lcp < length
        run = np.cumsum(new)  # 0: the run that goes on
        mine = valid[at]
        size = np.bincount(run, weights=mine, minlength=int(run[-1]) + 1)
        if size[0] and alone >= 0:
            found[alone] = True
        size[0] += (2 if many else alone >= 0) if size[0] or run[-1] == 0 else 0
        found[at[mine & (size[run] > 1)]] = True
        last = run == run[-1]
        of_last = at[last & mine]
        if run[-1]:
            alone, many = (int(of_last[0]) if len(of_last) == 1 else -1), len(of_last) > 1
        elif len(of_last):
            alone, many = (int(of_last[0]), False) if size[0] == 1 else (-1, True)
    return found


def repeats_in_shard(anchors: np.ndarray, lengths: np.ndarray, data: np.ndarray, twice: np.ndarray, length: int, gram: int, folder: str | None = None) -> np.ndarray:
    """For each string of the segments, in their order, whether it occurs again.

    A string that repeats has its first and its last gram in common with another
    one: strings whose pair of these is alone here are out, which leaves of a common
    passage in thousands of contexts the strings that lie within it. What is left is
    cut to runs of strings, and these are compared whole, and sorted where they differ.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    counts = lengths - length + 1
    if not len(counts):
        return np.zeros(0, bool)
    hashes = gram_hashes(data, gram)
    segment = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    at = np.arange(len(segment)) + (starts - np.cumsum(counts) + counts)[segment]
    ends = tx.mix(hashes[at] * SECOND + hashes[at + length - gram])
    del hashes
    in_order = np.sort(ends)
    shared = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    left = twice[segment].astype(bool)
    if len(shared):
        left |= shared[np.minimum(np.searchsorted(shared, ends), len(shared) - 1)] == ends
    del in_order, ends, shared
    begin = left.copy()
    begin[1:] &= ~left[:-1] | (segment[1:] != segment[:-1])
    end = left.copy()
    end[:-1] &= ~left[1:] | (segment[1:] != segment[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    out = np.zeros(len(left), bool)
    out[left] = _repeats(anchors[segment[first]], at[first], last - first + 1, data, twice[segment[first]], length, folder)
    return out


def _repeats(anchors: np.ndarray, starts: np.ndarray, counts: np.ndarray, data: np.ndarray, twice: np.ndarray, length: int, folder: str | None) -> np.ndarray:
    """For each string of these runs, in their order, whether it occurs again."""
    if not len(counts):
        return np.zeros(0, bool)
    lengths = counts + length - 1
    content = tx.span_hashes(data, starts, starts + lengths)
    order = np.lexsort((content, anchors))
    new = np.ones(len(order), bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (anchors[order][1:] != anchors[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    again = np.diff(np.append(first, len(order))) > 1
    again |= np.bincount(number, weights=twice, minlength=len(first)) > 0
    one = order[first]  # one segment of each content, by anchor
    _, group = np.unique(anchors[one], return_inverse=True)
    several = np.bincount(group)[group] > 1
    kept = one[several]
    at = np.concatenate([[0], np.cumsum(counts[one])])
    flag = np.repeat(again, counts[one])
    flag_at = at[:-1][several]
    size = np.concatenate([[0], np.cumsum(lengths[kept])])
    own = group[several]
    a = 0
    while a < len(kept):
        # Equal strings have equal anchors, so whole groups of an anchor are sorted by themselves.
        b = max(a + 1, int(np.searchsorted(size, size[a] + SORTED, "right")) - 1)
        b = int(np.searchsorted(own, own[b - 1], "right"))
        memory = Memory(folder=folder)
        text = memory.vector(int(size[b] - size[a]), np.uint8)
        valid = memory.vector(len(text), bool)
        for k in range(a, b):
            lo = int(size[k] - size[a])
            text[lo : lo + int(lengths[kept[k]])] = data[starts[kept[k]] : starts[kept[k]] + lengths[kept[k]]]
            valid[lo : lo + int(counts[kept[k]])] = True
        found = repeats_of(text, valid, length, memory)
        for k in range(a, b):
            lo, f, n = int(size[k] - size[a]), int(flag_at[k]), int(counts[kept[k]])
            flag[f : f + n] |= found[lo : lo + n]
        a = b
    out = np.empty(int(counts.sum()), bool)
    begin = 0
    for k, n in zip(number.tolist(), counts.tolist()):
        out[begin : begin + n] = flag[at[k] : at[k] + n]
        begin += n
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, label: str = "suffix-dedup") -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_removed, n_spans and, in place of the text, kept."""
    scratch = Scratch(docs.sparkSession, label)
    # What a sort holds in files stays with its task; a shared folder that is a path here takes it, else the task's own.
    folder = scratch.path.removeprefix("file://").rpartition("/")[0] if scratch.path.startswith("file:") else None
    ranges = Ranges(docs, id_col, text_col)
    bits = ranges.bits

    def anchors(table: pa.Table, _):
        found, here, _group = Texts(table, length, gram).asked()
        return found, here, 64 - bits  # an anchor by one hash that equals one by the other costs a comparison, no more

    def twice(hashes: np.ndarray, _ranges, _flags) -> np.ndarray:
        if len(hashes) == 0:
            return np.zeros(0, bool)
        _, first, group = grouped(hashes)
        return np.bincount(group)[group] > 1

    often = scratch.keep(ranges.answer(ranges.ask(anchors), twice, 1, 64 - bits), "anchors")

    def send(key, texts, answers):
        t = Texts(in_order(texts), length, gram)
        _, number, rows, again = t.shared(answers, bits)
        bucket = (t.anchors[rows] >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else np.zeros(0, np.int64)
        out: list[list] = [[], [], [], [], []]
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            some = rows[a:b]
            lengths = t.counts[some] + length - 1
            data = _gather(t.buf, t.starts[some], lengths)
            for column, value in zip(out, (int(bucket[a]), t.anchors[some].tobytes(), lengths.astype(np.uint32).tobytes(), np.packbits(again[a:b]).tobytes(), data.tobytes())):
                column.append(value)
        if len(rows):  # by way of the shards, so that the last round need not hash the texts again
            for column, value in zip(out, (-1 - key[0].as_py(), b"", b"", b"", _noted(t.starts, t.counts, number, rows, bucket, again))):
                column.append(value)
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "__range": pa.array([key[0].as_py()] * len(out[0]), pa.int32()), **{n: pa.array(v, pa.binary()) for n, v in zip(("anchors", "lengths", "twice", "data"), out[1:])}})

    sent = ranges.texts().groupBy(RANGE).cogroup(often.groupBy(RANGE)).applyInArrow(send, SEGMENTS)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards():
            current, rows = None, []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "__range", "anchors", "lengths", "twice", "data"))):
                    if row[0] != current and rows:
                        yield rows
                        rows = []
                    current = row[0]
                    rows.append(row)
            if rows:
                yield rows

        for rows in shards():
            if rows[0][0] < 0:
                yield pa.RecordBatch.from_pydict({"__range": pa.array([r[1] for r in rows], pa.int32()), "round": pa.array([NOTE] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "bits": pa.array([r[5] for r in rows], pa.binary())})
                continue
            lengths = [np.frombuffer(r[3], np.uint32).astype(np.int64) for r in rows]
            flag = repeats_in_shard(
                np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]), np.concatenate(lengths), np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows]),
                np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=len(n)) for r, n in zip(rows, lengths)]), length, gram, folder)
            at = np.concatenate([[0], np.cumsum([int((n - length + 1).sum()) for n in lengths])])
            yield pa.RecordBatch.from_pydict({
                "__range": pa.array([r[1] for r in rows], pa.int32()), "round": pa.array([2] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "bits": pa.array([np.packbits(flag[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    repeats = scratch.keep(sent.repartition(ranges.n, "bucket").sortWithinPartitions("bucket", RANGE).mapInArrow(sort, ANSWER), "repeats")
    columns = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept")]

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        buf, off = tx.buffers(table.column("text"))
        gone = repeated(len(buf), answers, length)
        total = np.concatenate([[0], np.cumsum(gone)])
        first = gone.copy()  # the first byte of a removed run
        first[1:] &= ~gone[:-1]
        inner = off[1:-1]
        inner = inner[inner < len(gone)]
        first[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(first)])
        kept = buf[~gone]
        left = (off - total[off]).astype(np.int32)
        return pa.table({
            "row": table.column("row"), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(np.diff(total[off]), pa.int64()), "n_spans": pa.array(np.diff(spans[off]), pa.int64()),
            "kept": pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(kept.tobytes())])})

    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in columns])), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    out = ranges.finish(repeats, remove, schema, columns)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], "n_bytes", "n_removed", "n_spans", "kept")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
