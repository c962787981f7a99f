"""Removal of repeated word sequences by fixed-block anchors.

A window of ``window`` words is removed from a document if a document with a
smaller id has it too. With blocks of (window + 1) / 2 words, laid out side by
side from the start of every document, any window of a reference document holds
a whole block; so the blocks are indexed, every rolling run of as many words of
every document probes them, and a window can only be a repeat where a probe hit.
Hits are then extended: of the windows around hit probes and hit blocks, the
hashes of all ``window`` words are compared, and a word goes if any window over
it repeats. Neighbouring windows that repeat join to maximal repeats.

Rounds over ranges of ids (see ``ranged``): 1 blocks and probes, by bits of the
run's hash (a false hit costs a comparison, no more); 2 the 64-bit hashes of the
windows around hits; 3 the removal. Within a range the comparison is by document,
between ranges by range, as ranges are in id order.

Defined results: null and empty texts, and those of fewer than ``window`` words,
keep all; rows that repeat an id are one document to each other (neither loses
words for the other); null ids rank after all ids and equal among themselves;
an empty table gives an empty one. Ids must be whole numbers (others raise an
error). Columns named like an output are replaced.

A task holds one range's texts and some arrays of eight bytes a word; there are
two ranges to a shuffle partition, so the number of those sets its memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textops as tx
from .ranged import Ranges, answered, grouped
from .scratch import Scratch

WINDOW = 13


class Texts:
    """Words of the rows of one range, and their runs and windows."""

    def __init__(self, table: pa.Table, window: int, bits: int):
        self.window, self.block, self.bits = window, (window + 1) // 2, bits
        self.keys = table.column("__key").to_numpy()
        self.buf, self.off = tx.buffers(table.column("text"))
        self.starts, self.ends, self.word_off = tx.words(self.buf, self.off, tx.SPACE)
        self.codes = tx.span_hashes(self.buf, self.starts, self.ends)
        rows = np.repeat(np.arange(len(self.keys)), np.diff(self.word_off))
        self.nth = np.arange(len(rows)) - self.word_off[rows]
        # Rows that repeat an id are one document.
        self.doc = (np.cumsum(np.concatenate([[0], self.keys[1:] != self.keys[:-1]])) if len(self.keys) else self.keys)[rows]
        self.long = (np.diff(self.word_off) >= window)[rows]

    def runs(self):
        """Position, group, distinct truncated hashes and anchor flag of the rolling runs, and which runs repeat here."""
        n = len(self.codes) - self.block + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(bool), none.astype(bool)
        at = np.flatnonzero(tx.inside(self.word_off, self.block) & self.long[:n])
        codes = tx.ngram_hashes(self.codes, self.block)[at] >> np.uint64(32 - self.bits)
        order, first, group = grouped(codes)
        anchor = np.zeros(len(first), bool)
        anchor[group[self.nth[at] % self.block == 0]] = True
        docs = self.doc[at][order]
        last = np.append(first[1:], len(order)) - 1
        return at, group, codes[order][first], anchor, anchor & (docs[first] != docs[last]) if len(first) else anchor

    def candidates(self, answers: pa.Table):
        """Starts and 64-bit hashes of the windows around hits."""
        at, group, codes, _, here = self.runs()
        flag = answered(answers, 1, codes, 32) | here
        hit = np.zeros(len(self.codes) + 1, np.int64)
        hit[at[flag[group]] + 1] = 1
        hit = np.cumsum(hit)
        n = len(self.codes) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        span = self.window - self.block + 1
        starts = np.flatnonzero(tx.inside(self.word_off, self.window) & (hit[span : span + n] > hit[:n]))
        return starts, self._window_hashes(starts)

    def _window_hashes(self, starts: np.ndarray) -> np.ndarray:
        total = np.full(len(starts), 1, np.uint64)
        for j in range(self.window):
            total = total * np.uint64(0x9E3779B97F4A7C15) + self.codes[starts + j]
        return tx.mix(total)

    def removed(self, answers: pa.Table) -> np.ndarray:
        """Which words go."""
        starts, hashes = self.candidates(answers)
        order, first, group = grouped(hashes)
        earlier = answered(answers, 2, hashes[order][first], 64 - self.bits)
        least = self.doc[starts][order][first]  # the order is stable, and documents ascend
        gone = starts[earlier[group] | (least[group] < self.doc[starts])]
        edge = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _hits(hashes: np.ndarray, ranges: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Probes of later ranges than the first with that block, and that first block if it was hit."""
    if len(hashes) == 0:
        return np.zeros(0, bool)
    _, first, group = grouped(hashes)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, group[anchors], ranges[anchors])
    hit = ranges > least[group]
    used = np.zeros(len(first), bool)
    used[group[hit]] = True
    return hit | (anchors & used[group] & (ranges == least[group]))


def _seen_earlier(hashes: np.ndarray, ranges: np.ndarray, _flags: np.ndarray) -> np.ndarray:
    if len(hashes) == 0:
        return np.zeros(0, bool)
    order, first, group = grouped(hashes)  # rows come by range, and the order is stable
    return ranges > ranges[order][first][group]


def _joined(t: Texts, removed: np.ndarray, a: int, b: int, layout: bool) -> pa.Array:
    """Texts of the rows a..b without the removed words."""
    lo, hi = int(t.word_off[a]), int(t.word_off[b])
    starts, ends, gone = t.starts[lo:hi], t.ends[lo:hi], removed[lo:hi]
    off = t.word_off[a : b + 1] - lo
    if layout:
        base = int(t.off[a])
        keep = np.ones(int(t.off[b]) - base, bool)
        stop = np.append(starts[1:], t.off[b])  # a removed word goes with the space behind it
        last = off[1:][np.diff(off) > 0] - 1
        stop[last] = t.off[a + 1 : b + 1][np.diff(off) > 0]
        for s, e in zip((starts[gone] - base).tolist(), (stop[gone] - base).tolist()):
            keep[s:e] = False
        flat = t.buf[base : int(t.off[b])][keep]
        ends_at = np.concatenate([[0], np.cumsum(keep)])[t.off[a : b + 1] - base]
        return pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(ends_at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
    kept = ~gone
    lengths = (ends - starts)[kept] + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    source = np.repeat(starts[kept] - at[:-1], lengths) + np.arange(at[-1])
    flat = np.append(t.buf, np.uint8(0x20))[source] if len(source) < len(t.buf) // 4 else np.append(t.buf, np.uint8(0x20)).take(source)
    flat[at[1:] - 1] = 0x20
    words = np.concatenate([[0], np.cumsum(kept)])[off]
    ends_at = at[words]
    drop = np.ones(len(flat), bool)
    drop[ends_at[1:][np.diff(words) > 0] - 1] = False  # no space behind the last word
    ends_at = ends_at - np.concatenate([[0], np.cumsum(np.diff(words) > 0)])
    return pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(ends_at.astype(np.int32).tobytes()), pa.py_buffer(flat[drop].tobytes())])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: bool = False, label: str = "block-dedup") -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed and, in place of the text, kept.

    ``kept`` is the text of the words that stay, joined by one space, or, with
    ``layout``, the text as it was but for removed words and the space behind them.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd: blocks of (window + 1) / 2 words cover each window exactly once")
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    ranges = Ranges(docs, id_col, text_col)
    bits = ranges.bits

    def runs(table: pa.Table, _):
        _, _, codes, anchor, _ = Texts(table, window, bits).runs()
        return codes, anchor, 32

    def windows(table: pa.Table, answers: pa.Table):
        hashes = np.unique(Texts(table, window, bits).candidates(answers)[1])
        return hashes, np.zeros(len(hashes), bool), 64 - bits

    hits = scratch.keep(ranges.answer(ranges.ask(runs), _hits, 1, 32), "hits")
    repeats = scratch.keep(ranges.answer(ranges.ask(windows, hits), _seen_earlier, 2, 64 - bits), "repeats")
    columns = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept")]

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = Texts(table, window, bits)
        removed = t.removed(answers)
        total = np.concatenate([[0], np.cumsum(removed)])
        parts = []
        step = max(1, len(t.keys) // max(1, len(t.buf) // tx.SLICE + 1))
        for a in range(0, len(t.keys), step):
            parts.append(_joined(t, removed, a, min(a + step, len(t.keys)), layout))
        kept = pa.chunked_array(parts, pa.string())
        return pa.table({"row": table.column("row"), "n_words": pa.array(np.diff(t.word_off), pa.int64()), "n_removed": pa.array(np.diff(total[t.word_off]), pa.int64()), "kept": kept})

    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in columns])), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    out = ranges.finish(hits.unionByName(repeats), remove, schema, columns)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], "n_words", "n_removed", "kept")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
