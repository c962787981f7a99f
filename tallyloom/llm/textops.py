"""Vectorised word and n-gram hashing over the UTF-8 buffers of Arrow batches.

A batch is cut into slices of about ``SLICE`` bytes (one text at least), so the
arrays of a task stay small whatever the batch holds; a text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc



def _give_back(limit: int = 1 << 19) -> None:
    """Lets arrays of ``limit`` bytes or more go back to the system when they are freed.

    Otherwise the C library and Arrow keep them for later, and every Python worker
    of an executor, idle ones too, would stay as large as it ever was.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, limit)  # M_MMAP_THRESHOLD of glibc
        library.mallopt(-1, limit)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library: nothing to set
        pass


_give_back()

#: What empties the tables that operators keep in a worker from task to task.
_KEPT: list[Callable[[], None]] = []


def keeps(clear: Callable[[], None]) -> None:
    _KEPT.append(clear)


def let_go() -> None:
    """Empties those tables: called where a task of another operator begins, whose arrays would come on top of them."""
    for clear in _KEPT:
        clear()


SLICE = 4 << 20
_PIECE = 1 << 20

#: The six ASCII separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` leaves out.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 mod 8: of the largest order modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int) -> np.ndarray:
    if base not in _powers:
        table = np.full(_PIECE + 1, base, np.uint64)
        table[0] = 1
        _powers[base] = np.multiply.accumulate(table)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and len+1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each take about ``size`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // size
        starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:]):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def words(buf: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and len+1 offsets of the texts' words."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums of byte codes times powers of the base, for spans of up to one piece."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _power_table(_BASE)[: len(buf)], dtype=np.uint64)])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (ascending starts), equal wherever the bytes are equal."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + _PIECE // 2))
        last = int(ends[i:j].max())
        if last - base > _PIECE:  # one span longer than a piece: folded piece by piece
            over = i + np.flatnonzero(ends[i:j] - base > _PIECE)
            j = int(over[0])
            if j == i:
                h = np.uint64(0)
                for a in range(base, int(ends[i]), _PIECE):
                    piece = prefix_hash(buf[a : min(a + _PIECE, int(ends[i]))])[-1:]
                    h = mix(np.array([h], np.uint64) + piece)[0]
                out[i] = h
                i += 1
                continue
            last = int(ends[i:j].max())
        sums = prefix_hash(buf[base:last])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _power_table(_INVERSE)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ngram_hashes(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes, text borders ignored; len - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.full(size, (salt * 2 + 1) & (1 << 64) - 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + hashes[j : j + size]
    return mix(total)


def inside(word_off: np.ndarray, n: int) -> np.ndarray:
    """Which of the ``ngram_hashes`` lie within one text."""
    total = int(word_off[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    for j in range(1, n):  # a start less than n words before the end of its text
        at = word_off[1:] - j
        at = at[(at >= 0) & (at < len(ok)) & (at >= word_off[:-1])]
        ok[at] = False
    return ok


def binary(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(list(values), pa.binary())


def packed(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary values whose i-th holds the array elements ``off[i]:off[i+1]``."""
    flat = np.ascontiguousarray(flat)
    offsets = (np.asarray(off, np.int64) * flat.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
