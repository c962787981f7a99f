"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed (a polynomial over the code points,
taken from running sums); of every ``window`` consecutive hashes the least is
chosen, the rightmost one among equals, and kept with its position. Two texts
that share any run of ``window + k - 1`` code points share a chosen hash, and no
match shorter than ``k`` is reported.

Defined results: a text of fewer than ``k`` code points is one run; a null or
empty text has no fingerprint and is unlike every text but another empty one;
a text with fewer than ``window`` hashes keeps the least of them. Equal texts
have equal fingerprints wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as tx
from .ordered import RANGE, bounds, range_of
from .scratch import partitions

K = 16
WINDOW = 33
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 32-bit hashes and their positions, in the order of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(points))
    codes = tx.mix(points + _MULT)
    # The hash of a run rolls by doubling: runs of 2 from runs of 1, of 4 from runs of 2, and the rest added.
    total, size, done, done_size = None, 1, None, 0
    run = codes
    left = k
    while left:
        if left & 1:
            if done is None:
                done, done_size = run, size
            else:
                n = len(points) - done_size - size + 1
                done = done[:n] * np.uint64(pow(int(_MULT), size, 1 << 64)) + run[done_size : done_size + n]
                done_size += size
        left >>= 1
        if left:
            n = len(points) - 2 * size + 1
            run = run[:n] * np.uint64(pow(int(_MULT), size, 1 << 64)) + run[size : size + n]
            size *= 2
    total = tx.mix(done) >> np.uint64(32)
    n = len(total)
    window = min(window, n)
    # The position, reversed, breaks ties towards the right.
    keyed = total << np.uint64(32) | (_LOW - np.arange(n, dtype=np.uint64))
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keyed
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted distinct hashes; two empty sets are alike."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def _string(hashes: np.ndarray) -> str:
    """Eight hex digits for each hash, in the order of the text."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprint(df: DataFrame, text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with ``hashes`` (array of long) and ``positions`` (array of long). Narrow: no shuffle."""
    names = [c for c in df.columns if c not in ("hashes", "positions")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, text_col):
            found = [winnow(t or "", k, window) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array([x[j].astype(np.int64) for x in found], pa.list_(pa.int64())) for j in (0, 1)], names=names + ["hashes", "positions"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("hashes", "positions")]))


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's, and the places of
    the text's chosen k-grams (code points from its start, in order), which any shared run of window + k - 1 code points meets.

    The next document follows in descending id order (rows that repeat an id in
    the order of their texts, null ids last), the first after the last. Rows are
    dealt out by ranges of ids cut at ids of the table; the row at a cut is sent
    to both sides, so one shuffle serves and a task holds two texts at a time.
    The edited text has its last third replaced by as much of the next one's start.
    """
    n = partitions(df.sparkSession)
    cuts = bounds(df, id_col, n)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Of rows at a cut, or with the last id, only the first in order is someone's next one.
    top = df.agg(F.max(id_col).alias("m")).first().m
    part = range_of("id", cuts)
    own = F.struct(part.alias(RANGE), F.lit(True).alias("own"))
    copies = F.when(F.col("id").isin(cuts) if cuts else F.lit(False), F.array(own, F.struct((part + 1).cast("int").alias(RANGE), F.lit(False).alias("own")))).otherwise(F.array(own))
    # The greatest id is next to the least; with null ids only, to itself.
    is_top = F.col("id").isNull() if top is None else F.coalesce(F.col("id") == F.lit(top), F.lit(False))
    copies = F.when(is_top, F.concat(copies, F.array(F.struct(F.lit(-1).alias(RANGE), F.lit(False).alias("own"))))).otherwise(copies)
    rows = rows.select("id", "text", F.explode(copies).alias("c")).select("id", "text", "c.*")
    # Range -1 holds the first rows only to close the circle: they are put below the least id, in range 0.
    rows = rows.withColumn("wrap", F.col(RANGE) < 0).withColumn(RANGE, F.greatest(F.col(RANGE), F.lit(0)))
    rows = rows.repartition(n, RANGE).sortWithinPartitions(F.col(RANGE), F.col("wrap"), F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for batch in tx.slices(batches, "text"):
                yield from zip(*(batch.column(c).to_pylist() for c in ("id", "text", RANGE, "own")))
            yield None, "", None, False

        out: list[tuple] = []
        last = None  # the own row that waits for its next one: id, text, range, hashes, positions

        for doc, text, r, own in entries():
            mine, places = winnow(text, k, window) if r is not None and (own or last) else (None, None)
            if last is not None:
                if r != last[2]:
                    raise ValueError("a range ended without the row that follows it")
                cut = len(last[1]) // 3
                edited = last[1][: len(last[1]) - cut] + text[:cut]
                prints = winnow(edited, k, window)[0]
                a = np.unique(last[3])
                out.append((last[0], len(last[1]), edited, _string(last[3]), _string(prints), likeness(a, np.unique(prints)), likeness(a, np.unique(mine)), ",".join(map(str, last[4].tolist()))))
                last = None
            if own:
                last = (doc, text, r, mine, places)
            if len(out) >= 256:
                yield _rows(out, kind)
                out = []
        if out:
            yield _rows(out, kind)

    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(kind)
    return rows.select("id", "text", RANGE, "own").mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions string")


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=list("abcdefgh"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compare_neighbours(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions")
