"""SentencePiece encoding and decoding through a table of distinct marked words.

A text is marked the way the library does it: a space becomes U+2581 and one
U+2581 is put in front. If no piece of the model has a marker after another
character, no merge crosses such a border, so each run of markers with the
characters up to the next marker is segmented by itself. Every distinct marked
word of a batch is segmented once by the library (a bounded table of recent
words is kept between batches) and the ids are joined back by position.

Models for which that does not hold (pieces that cross markers, a normaliser
other than identity, no dummy prefix, removal of extra spaces, user-defined
symbols) are encoded text by text instead.

Defined results: null and empty texts have no ids and decode to the empty text;
all other columns pass through; columns named like an output are replaced.
Repeated rows are each encoded; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import textops as tx

MARK = "▁"
#: Distinct words kept from batch to batch; the table is emptied beyond it.
TABLE_WORDS = 400_000


class Codec:
    """The model, its table of distinct words and its table of pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        crossing = any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds) if k in (1, 4))
        plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        self.by_word = plain and not crossing and 4 not in kinds and not model.trainer_spec.treat_whitespace_as_suffix
        # What a piece stands for: nothing for control symbols, a byte for byte pieces.
        self.bytes = pa.array([b"" if k == 3 else bytes([int(p[3:-1], 16)]) if k == 6 else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds)], pa.large_binary())
        self.odd = np.array([k in (2, 3, 5, 6) for k in kinds])
        # A marker with nothing after it: the library gives nothing for an empty input, so its ids come from a longer one.
        self.lone = self.sp.encode("\n ")[len(self.sp.encode("\n")) :]
        self.table: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = [0]

    def _segment(self, words: list[str]) -> np.ndarray:
        """Rows of the table for the given marked words, without their last marker in front."""
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table.clear()
            self.begin = [0]
            new = words
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            for w, ids in zip(part, self.sp.encode(part, num_threads=1)):
                ids = ids if w else self.lone
                end = self.begin[-1] + len(ids)
                while end > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.begin[-1] : end] = ids
                self.table[w] = len(self.begin) - 1
                self.begin.append(end)
        return np.array([self.table[w] for w in words], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and len+1 offsets of the texts' ids."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            lists = self.sp.encode(texts.to_pylist(), num_threads=1)
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            return np.array([i for x in lists for i in x], np.int32), off
        # A literal marker is a marker like a space; neither is confused with the other afterwards, as ids are the same.
        texts = pc.replace_substring(texts, MARK, " ")
        buf, off = tx.buffers(texts)
        if len(buf) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space = buf == 0x20
        # A word starts at the first byte of a text, and at a space after another character.
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(buf))
        first = np.zeros(len(buf), bool)
        first[off[:-1][np.diff(off) > 0]] = True
        # The library puts one marker in front, so a word after the first goes without one of its own spaces.
        own = ~first[starts]
        keep = np.ones(len(buf), bool)
        keep[starts[own]] = False
        flat = buf[keep]
        offsets = np.concatenate([[0], np.cumsum(ends - starts - own)]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
        coded = chunks.dictionary_encode()
        rows = self._segment(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begins = np.array(self.begin, np.int64)
        low, n = begins[rows], begins[rows + 1] - begins[rows]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(low - total[:-1], n) + np.arange(total[-1])]
        word_off = np.searchsorted(np.flatnonzero(begin), off)
        return ids, total[word_off]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The texts, as the library's decode(ids) gives them."""
        n_ids = np.diff(off)
        flat = self.bytes.take(pa.array(ids))
        data, at = np.frombuffer(flat.buffers()[2], np.uint8) if len(ids) and flat.buffers()[2] is not None else np.zeros(0, np.uint8), np.frombuffer(flat.buffers()[1], np.int64)
        begin, end = at[off[:-1]], at[off[1:]]
        odd = np.concatenate([[0], np.cumsum(self.odd[ids])])
        odd = odd[off[1:]] > odd[off[:-1]]
        raw = data.tobytes()
        out = []
        for i in range(len(n_ids)):
            text = raw[begin[i] : end[i]]
            if odd[i]:
                # Byte pieces may not join to characters, and symbols have forms of their own: left to the library.
                out.append(self.sp.decode(ids[off[i] : off[i + 1]].tolist()))
            else:
                out.append((text[1:] if text[:1] == b" " else text).decode())
        return pa.array(out, pa.string())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


tx.keeps(codec.cache_clear)


def _without(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def encode(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``, the array of all ids of the whole text. Narrow: no shuffle."""
    names = _without(df, ids_col) if ids_col != text_col else df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in tx.slices(batches, text_col, 1 << 20):
            ids, off = c.encode(batch.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [lists], names=names + [ids_col])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``, the text of the ids (null: the empty text)."""
    names = _without(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                lists = batch.column(ids_col)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                ids = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [c.decode(ids, off)], names=names + [text_col])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField(text_col, T.StringType())]))


def round_trip(df: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the ids of the whole text and the text of these ids, as ``decode`` over ``encode``.

    Both in one pass, so that a task has one Python worker (and one table of words) and not two.
    """
    names = _without(df, ids_col, decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in tx.slices(batches, text_col, 1 << 20):
            ids, off = c.encode(batch.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [lists, c.decode(ids, off)], names=names + [ids_col, decoded_col])

    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + new))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, model).drop("text").withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    return decode(coded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
