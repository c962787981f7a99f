"""Texts dealt out in ranges of ids, lists of hashes per range, and answers as bits.

Operators that look for repeats between documents run in rounds. In each, a task
holds the texts of one range, sorts and dedupes the hashes it asks about, and
sends them to buckets by their leading bits; a bucket sees every hash once for
each range at most, whatever a hash's frequency, and answers one bit for each.
The next round sorts the same texts again, so the bits need no keys of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as tx
from .ordered import RANGE, bounds, range_of
from .scratch import partitions

LAST = (1 << 63) - 1
ASKED = "bucket int, __range int, hashes binary, flags binary"
ANSWER = "__range int, round int, bucket int, bits binary"


class Ranges:
    """How a table of documents is cut; null ids come after all others."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        self.n = partitions(spark)
        self.count = 2 * self.n
        self.bits = max(1, (self.n - 1).bit_length())
        cuts = bounds(docs, id_col, self.count)
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
        self.docs, self.own = docs, (range_of(key, cuts).alias(RANGE), key.alias("__key"), F.col(text_col).alias("text"))

    def texts(self) -> DataFrame:
        return self.docs.select(*self.own)

    def ask(self, fn: Callable[[pa.Table], Iterator], answers: DataFrame | None = None) -> DataFrame:
        """``fn(texts, answers)`` of every range gives its sorted distinct hashes and a flag for each."""
        bits = self.bits

        def rows(number: int, texts: pa.Table, found: pa.Table | None) -> pa.Table:
            tx.let_go()
            hashes, flags, width = fn(texts, found)
            return _dealt(hashes, flags, width, number, bits)

        if answers is None:
            return self.texts().groupBy(RANGE).applyInArrow(lambda key, t: rows(key[0].as_py(), in_order(t), None), ASKED)
        return self.texts().groupBy(RANGE).cogroup(answers.groupBy(RANGE)).applyInArrow(lambda key, t, a: rows(key[0].as_py(), in_order(t), a), ASKED)

    def answer(self, asked: DataFrame, fn: Callable, round_: int, width: int) -> DataFrame:
        """``fn(hashes, ranges, flags)`` of every bucket gives a bit for each entry; ``width`` as asked with."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tx.let_go()
            for bucket, rows in by_bucket(batches, _kind(width)):
                sizes = [len(h) for _, h, _ in rows]
                bits = fn(np.concatenate([h for _, h, _ in rows]), np.repeat([r for r, _, _ in rows], sizes), np.concatenate([f for _, _, f in rows]))
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_pydict({
                    "__range": pa.array([r for r, _, _ in rows], pa.int32()), "round": pa.array([round_] * len(rows), pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
                    "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

        dealt = asked.repartition(self.n, "bucket").sortWithinPartitions("bucket", RANGE)
        return dealt.mapInArrow(run, ANSWER)

    def finish(self, answers: DataFrame, fn: Callable, schema, columns: list[str]) -> DataFrame:
        """``fn(rows, answers)`` of every range, with these columns of the documents beside key and text."""
        def run(_, texts: pa.Table, found: pa.Table) -> pa.Table:
            tx.let_go()
            return fn(in_order(texts), found)

        rows = self.docs.select(*self.own, F.struct(*[F.col(c) for c in columns]).alias("row"))
        return rows.groupBy(RANGE).cogroup(answers.groupBy(RANGE)).applyInArrow(run, schema)


def in_order(texts: pa.Table) -> pa.Table:
    """Rows by id, those that repeat an id by text: the same order in every round."""
    return texts.sort_by([("__key", "ascending"), ("text", "ascending")]).combine_chunks()


def _dealt(hashes: np.ndarray, flags: np.ndarray, width: int, number: int, bits: int) -> pa.Table:
    """Rows by bucket of sorted hashes of ``bits + width`` bits."""
    bucket = (hashes >> np.uint64(width)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket)).astype(np.int64)
    low = (hashes & np.uint64((1 << width) - 1)).astype(_kind(width))
    return pa.table({
        "bucket": pa.array(bucket[starts], pa.int32()), "__range": pa.array([number] * len(starts), pa.int32()),
        "hashes": pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        "flags": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(starts, ends)], pa.binary())})


def _kind(width: int):
    return np.uint32 if width == 32 else np.uint64


def by_bucket(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple[int, list]]:
    """The rows of each bucket: range, hashes, flags."""
    current, rows = None, []
    for batch in batches:
        for bucket, number, hashes, flags in zip(*(batch.column(c).to_pylist() for c in ("bucket", "__range", "hashes", "flags"))):
            if bucket != current:
                if rows:
                    yield current, rows
                current, rows = bucket, []
            values = np.frombuffer(hashes, kind)
            rows.append((number, values, np.unpackbits(np.frombuffer(flags, np.uint8), count=len(values)).astype(bool)))
    if rows:
        yield current, rows


def answered(answers: pa.Table, round_: int, hashes: np.ndarray, width: int) -> np.ndarray:
    """The bits of a round for the sorted hashes that were asked about."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) == 0:
        return out
    bucket = (hashes >> np.uint64(width)).astype(np.int64)
    for r, b, bits in zip(*(answers.column(c).to_pylist() for c in ("round", "bucket", "bits"))):
        if r == round_:
            lo, hi = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by value, the distinct values' starts in it, and each entry's group."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group
