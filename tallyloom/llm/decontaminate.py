"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ``window`` consecutive words of the benchmark
items; an item of fewer words, but not none, is one pattern. Patterns of one
length m form a matcher: a shift table over blocks of ``block`` words tells how
far a search position may jump, buckets by the hash of a pattern's last block
select the patterns to test where the shift is nought, and a candidate counts
only if its words' bytes equal the pattern's. Many positions, each in a stretch
of its own, advance together, so the tables are read by whole arrays.

Defined results: a null or empty text has no words and no hits; a null or empty
item has no pattern; equal items each count, items that repeat an id once, and those
of null ids as one of the empty name; repeated rows are each searched;
an empty table gives no rows (or no hits, for an empty benchmark). Columns of
the input named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textops as tx
from .scratch import Scratch

BLOCK = 2
#: Words of a text that one search position walks through.
STRETCH = 512
#: Benchmark text that one broadcast may hold; more is searched for in further passes over the rows.
BROADCAST_BYTES = 16 << 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


class Matcher:
    """Wu-Manber tables for patterns of ``m`` words: ``codes`` (patterns x m word hashes) and their words as bytes."""

    def __init__(self, codes: np.ndarray, raw: list[bytes], owners: list[list[str]]):
        self.codes, self.raw, self.owners, self.m = codes, raw, owners, codes.shape[1]
        self.b = min(BLOCK, self.m)
        blocks = np.stack([self._blocks(codes[:, j : j + self.b]) for j in range(self.m - self.b + 1)], axis=1)
        keys = blocks.ravel()
        shifts = np.tile(self.m - self.b - np.arange(blocks.shape[1]), len(codes))
        order = np.lexsort((shifts, keys))  # the least shift of each block first
        keys, shifts = keys[order], shifts[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.keys, self.shifts = keys[first], shifts[first]
        # A direct-address filter in front of the sorted table: most blocks of a text are in no pattern.
        self.bits = max(12, int(np.ceil(np.log2(len(self.keys) * 16 + 1))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True
        suffix = blocks[:, -1]
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.by_suffix]

    @staticmethod
    def _blocks(codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[:, j]
        return tx.mix(total)

    def shift(self, block: np.ndarray) -> np.ndarray:
        out = np.full(len(block), self.m - self.b + 1, np.int64)
        maybe = np.flatnonzero(self.seen[block >> np.uint64(64 - self.bits)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, block[maybe]), len(self.keys) - 1)
            same = self.keys[at] == block[maybe]
            out[maybe[same]] = self.shifts[at[same]]
        return out

    def search(self, codes: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, pattern) of each place whose word hashes equal a pattern's."""
        counts = np.diff(word_off)
        lasts = np.maximum(counts - self.m + 1, 0)  # start positions per text
        pieces = -(-lasts // STRETCH)
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = word_off[text] + nth * STRETCH
        stop = np.minimum(at + STRETCH, word_off[text] + lasts[text])
        found_at, found = [], []
        while len(at):
            tail = at + self.m - self.b
            block = self._blocks(np.stack([codes[tail + j] for j in range(self.b)], axis=1))
            jump = self.shift(block)
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                lo = np.searchsorted(self.suffixes, block[zero], "left")
                n = np.searchsorted(self.suffixes, block[zero], "right") - lo
                who = np.repeat(zero, n)
                pattern = self.by_suffix[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                same = np.ones(len(who), bool)
                for j in range(self.m):
                    same &= codes[at[who] + j] == self.codes[pattern, j]
                found_at.append(at[who[same]])
                found.append(pattern[same])
                jump[zero] = 1
            at = at + jump
            more = at < stop
            at, stop = at[more], stop[more]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (empty, empty)


def _words(texts: pa.Array):
    buf, off = tx.buffers(texts)
    buf = tx.LOWER[buf]
    starts, ends, word_off = tx.words(buf, off, tx.NON_ALNUM)
    return buf, starts, ends, word_off, tx.span_hashes(buf, starts, ends)


def matchers(items: list[tuple[str, str]], window: int) -> list[Matcher]:
    """One matcher for each length of pattern; equal windows are one pattern with all its items."""
    patterns: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    if items:
        buf, starts, ends, word_off, codes = _words(pa.array([t for _, t in items], pa.string()))
        for (item, _), a, b in zip(items, word_off[:-1], word_off[1:]):
            m = int(min(window, b - a))
            for i in range(a, b - m + 1) if m else ():
                raw = b" ".join(buf[starts[k] : ends[k]].tobytes() for k in range(i, i + m))
                patterns.setdefault(m, {}).setdefault(raw, (codes[i : i + m], set()))[1].add(item)
    return [Matcher(np.stack([c for c, _ in group.values()]), list(group), [sorted(o) for _, o in group.values()]) for _, group in sorted(patterns.items())]


def _find(texts: pa.Array, tables: list[Matcher]):
    """Per text: words, hit words, items and runs of hit words."""
    buf, starts, ends, word_off, codes = _words(texts)
    edge = np.zeros(len(codes) + 1, np.int64)
    items: dict[int, set] = {}
    for table in tables:
        at, pattern = table.search(codes, word_off)
        for a, p in zip(at.tolist(), pattern.tolist()):
            if b" ".join(buf[starts[k] : ends[k]].tobytes() for k in range(a, a + table.m)) == table.raw[p]:
                edge[a] += 1
                edge[a + table.m] -= 1
                items.setdefault(int(np.searchsorted(word_off, a, "right")) - 1, set()).update(table.owners[p])
    hit = np.cumsum(edge[:-1]) > 0
    run = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    run_at, run_end = np.flatnonzero(run == 1), np.flatnonzero(run == -1)
    out = []
    totals = np.concatenate([[0], np.cumsum(hit)])
    for i, (a, b) in enumerate(zip(word_off[:-1].tolist(), word_off[1:].tolist())):
        n = int(totals[b] - totals[a])
        if not n:
            out.append((b - a, 0, [], []))
            continue
        lo, hi = np.searchsorted(run_end, a, "right"), np.searchsorted(run_at, b, "left")
        runs = [(max(int(s), a) - a, min(int(e), b) - a) for s, e in zip(run_at[lo:hi], run_end[lo:hi])]
        out.append((b - a, n, sorted(items.get(i, ())), [{"start": s, "end": e} for s, e in runs]))
    return out


def _merge(x: tuple, y: tuple) -> tuple:
    """The result of two passes over different items."""
    runs: list[dict] = []
    for r in sorted(x[3] + y[3], key=lambda r: (r["start"], r["end"])):
        if runs and r["start"] <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], r["end"])
        else:
            runs.append(dict(r))
    return x[0], sum(r["end"] - r["start"] for r in runs), sorted({*x[2], *y[2]}), runs


def _portions(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        n = len(row.t.encode())
        if part and size + n > BROADCAST_BYTES:
            yield part
            part, size = [], 0
        part.append((row.i if row.i is not None else "", row.t))
        size += n
    yield part


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and hit_words (runs of word positions).

    The benchmark is broadcast in portions of at most ``BROADCAST_BYTES`` of
    text; each portion beyond the first is one more pass over the rows, without
    a shuffle. Passes are written in between, so that tasks hold one portion's tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    out = docs.drop(*[f.name for f in RESULT if f.name in docs.columns and f.name != text_col])
    plain = out.columns
    for k, portion in enumerate(_portions(benchmark, item_col, item_text_col)):
        if k:
            out = scratch.keep(out, f"pass-{k}")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(matchers(portion, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=bool(k)) -> Iterator[pa.RecordBatch]:
            arrow = pa.schema([pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("hit_words", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            for batch in tx.slices(batches, text_col):
                found = _find(batch.column(text_col), shared.value)
                if again:
                    old = zip(*(batch.column(f.name).to_pylist() for f in arrow))
                    found = [_merge(x, y) for x, y in zip(old, found)]
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [pa.array(v, f.type) for v, f in zip(cols, arrow)], names=plain + arrow.names)

        schema = T.StructType([out.schema[c] for c in plain] + RESULT.fields)
        out = out.mapInArrow(run, schema)
    return out


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every document against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = search(docs, bench)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
