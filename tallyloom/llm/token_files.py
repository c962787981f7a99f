"""Token ids in seekable zstandard files.

A file holds whole documents in ascending id order: independent zstandard
frames of little-endian unsigned 32-bit ids (a document never crosses frames),
a skippable frame with the documents' ids and lengths, and a trailing seek
table (the public seekable format: per frame the two sizes and the low 32 bits
of the XXH64 of its content). A reader reads the two tables and decompresses
only the frames of the documents it was asked for, checking each.

Where the tokenizer lower-cases, drops white space, and cuts texts in runs of
letters, single digits and runs of signs (its own description is examined), its
pieces never cross white space nor most borders between these; so every distinct
run between such borders, A-Z lowered, is encoded once per table and the ids are
joined back by position. Other tokenizers get whole texts.

Defined results: a null or empty text has the end id alone; rows with a null id
come first; rows that repeat an id follow one another in the order of their
texts; an empty table gives no files. Ids must be whole numbers (others raise an
error). Other columns are not written.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import files, textops as tx
from .ordered import RANGE, bounds, range_of
from .scratch import Scratch, partitions

# Fixed values of the public formats.
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80

#: Ids in a frame, but for documents that are longer.
FRAME_IDS = 1 << 18
#: Distinct pieces that a worker remembers.
TABLE_WORDS = 400_000
MANIFEST = "path string, part int, n_docs long, n_tokens long, n_bytes long"


# How a tokenizer must be made for its texts to be cut at the borders below.
NORMALISER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Kinds of bytes of a text with A-Z lowered: other, letter, digit, sign, apostrophe.
OTHER, LETTER, DIGIT, SIGN, QUOTE = range(5)
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[0x61:0x7B] = LETTER
KIND[0x27] = QUOTE
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
ACCENTED = np.zeros(256, bool)
ACCENTED[0x80:0xC0] = True
ACCENTED[[0x97, 0xB7]] = False


def separable(tokenizer) -> bool:
    """Whether white space, and the borders that ``borders`` finds, are borders of this tokenizer's pieces."""
    made = json.loads(tokenizer.to_str())
    normaliser, pre, model = made["normalizer"], made["pre_tokenizer"], made["model"]
    if not normaliser or not pre or normaliser["type"] != "Sequence" or pre["type"] != "Sequence":
        return False
    first = pre["pretokenizers"][0]
    return (
        normaliser["normalizers"] == NORMALISER
        and len(pre["pretokenizers"]) == 2
        and (first["type"], first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and first["pattern"] == {"Regex": SPLIT}
        and pre["pretokenizers"][1]["type"] == "ByteLevel"
        and not pre["pretokenizers"][1]["use_regex"]
        and not pre["pretokenizers"][1]["add_prefix_space"]
        and model["type"] == "BPE"
        and not model.get("dropout")
        and bool(model.get("end_of_word_suffix"))
    )


def borders(buf: np.ndarray) -> np.ndarray:
    """Which bytes begin a piece behind a byte that is no white space.

    A run of letters ends at a digit or sign, and a digit is a piece of its own;
    a sign ends at a letter unless it is an apostrophe, which may begin a contraction.
    """
    kind = KIND[buf]
    accent = np.zeros(len(buf), bool)  # second bytes of accented letters
    accent[1:] = (buf[:-1] == 0xC3) & ACCENTED[buf[1:]]
    after = np.where(accent, np.uint8(LETTER), kind)  # the kind that a byte ends
    before = kind.copy()  # the kind that a byte begins
    before[:-1][accent[1:]] = LETTER
    left, right = after[:-1], before[1:]
    out = np.zeros(len(buf), bool)
    out[1:] = (
        (left != right)
        & (left != OTHER)
        & (right != OTHER)
        & ~((left >= SIGN) & (right >= SIGN))
        & ~((left == QUOTE) & (right == LETTER))
    )
    return out


class WordTable:
    """Ids of distinct pieces of texts; emptied when it is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separable = separable(self.tokenizer)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        if self.separable:
            suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
            self.last[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.begin[-1] + np.cumsum(sizes)
        while len(ends) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.begin[-1] : self.begin[-1] + len(flat)] = flat
        self.row.update(zip(words, range(len(self.begin) - 1, len(self.begin) - 1 + len(words))))
        self.begin = np.concatenate([self.begin, ends])

    def _encode_each(self, words: list[str]) -> None:
        lists = [coded.ids for coded in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self._add(words, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes)

    def _encode_runs(self, words: list[str]) -> None:
        """Runs of letters, each one pre-token, as texts of many; the ids that end a pre-token part them again."""
        texts = [" ".join(words[a : a + 512]) for a in range(0, len(words), 512)]
        lists = [coded.ids for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) == len(words) and (not len(flat) or ends[-1] == len(flat)):
            self._add(words, flat, np.diff(ends, prepend=0))
        else:
            self._encode_each(words)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > TABLE_WORDS:
            self._reset()
            new = words
        runs, others = [], []
        for w in new:
            (runs if w.isalpha() and (w.isascii() or max(w) < "\u0180") else others).append(w)
        for words_, encode in ((runs, self._encode_runs), (others, self._encode_each)):
            for a in range(0, len(words_), 16384):
                encode(words_[a : a + 16384])
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def _whole(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        lists = [coded.ids for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        return np.insert(flat, ends, end_id), np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and len+1 offsets.

        Texts that hold a string of an added token (which may cross borders and
        is told by case), and all texts of a tokenizer of another make, are
        encoded as they are.
        """
        texts = pc.fill_null(texts, "")
        if not self.separable:
            return self._whole(texts.to_pylist(), end_id)
        odd = np.zeros(len(texts), bool)
        for content in self.added:
            odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_pieces(texts, end_id)
        plain = self._by_pieces(pc.if_else(pa.array(odd), "", texts), end_id)
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist(), end_id)
        parts, sizes, nth = [], np.diff(plain[1]), np.cumsum(odd) - 1
        sizes[odd] = np.diff(whole[1])
        for i, of_whole in enumerate(odd):
            (ids, off), j = (whole, nth[i]) if of_whole else (plain, i)
            parts.append(ids[off[j] : off[j + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _by_pieces(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        buf, off = tx.buffers(texts)
        n_texts = len(off) - 1
        if len(buf) == 0:
            return np.full(n_texts, end_id, np.uint32), np.arange(n_texts + 1, dtype=np.int64)
        buf = tx.LOWER[buf]
        inside = ~tx.SPACE[buf]
        begin = borders(buf)
        begin[0] = True
        begin[1:] |= ~inside[:-1]
        begin[off[off < len(buf)]] = True
        begin &= inside
        starts = np.flatnonzero(begin)
        if len(starts) == 0:
            return np.full(n_texts, end_id, np.uint32), np.arange(n_texts + 1, dtype=np.int64)
        # The pieces side by side are the texts without white space.
        at = np.concatenate([[0], np.cumsum(inside)])[np.append(starts, len(buf))]
        words = pa.Array.from_buffers(
            pa.string(), len(starts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(buf[inside].tobytes())]
        )
        coded = words.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        low = self.begin[rows]
        total = np.concatenate([[0], np.cumsum(self.begin[rows + 1] - low)])
        ids = self.ids[np.repeat(low - total[:-1], np.diff(total)) + np.arange(total[-1])]
        ends_at = total[np.searchsorted(starts, off[1:])]
        return np.insert(ids, ends_at, end_id).astype(np.uint32), np.concatenate([[0], ends_at + np.arange(1, n_texts + 1)])


@lru_cache(maxsize=1)
def word_table(path: str) -> WordTable:
    return WordTable(path)


class Writer:
    """One seekable file."""

    def __init__(self, out):
        self.out, self.level = out, zstandard.ZstdCompressor(level=3)
        self.pending: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list = []
        self.lengths: list[int] = []
        self.written = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        if self.size and self.size + len(ids) > FRAME_IDS:
            self._flush()
        self.pending.append(ids.astype("<u4").tobytes())
        self.size += len(ids)
        self.docs.append(doc_id)
        self.lengths.append(len(ids))

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        frame = self.level.compress(raw)
        self._put(frame, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.pending, self.size = [], 0

    def _put(self, frame: bytes, content: int, check: int) -> None:
        self.out.write(frame)
        self.table.append((len(frame), content, check))
        self.written += len(frame)

    def close(self) -> tuple[int, int, int]:
        if self.pending:
            self._flush()
        index = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "n": pa.array(self.lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(index)
        body = sink.getvalue().to_pybytes()
        self._put(struct.pack("<II", INDEX_FRAME, len(body)) + body, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEK_MAGIC)
        tail = struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)) + entries + footer
        self.out.write(tail)
        return len(self.docs), sum(self.lengths), self.written + len(tail)


class Reader:
    """The tables of a seekable file, and its documents by number."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.contents, self.checks = table[:, 0], table[:, 1], table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.first_id = np.concatenate([[0], np.cumsum(self.contents // 4)])
        source.seek(int(self.at[n - 1]) + 8)
        index = pa.ipc.open_stream(pa.py_buffer(source.read(int(self.sizes[n - 1]) - 8))).read_all()
        self.doc_ids = index.column("doc_id").to_pylist()
        self.start = np.concatenate([[0], np.cumsum(index.column("n").to_numpy())]).astype(np.int64)
        self._frame: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def frame(self, k: int) -> np.ndarray:
        if self._frame[0] != k:
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.sizes[k])), max_output_size=int(self.contents[k]))
            if len(raw) != self.contents[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, np.frombuffer(raw, "<u4"))
        return self._frame[1]

    def document(self, i: int) -> np.ndarray:
        a, b = self.start[i], self.start[i + 1]
        k = int(np.searchsorted(self.first_id, a, "right")) - 1
        return self.frame(k)[a - self.first_id[k] : b - self.first_id[k]] if b > a else np.zeros(0, np.uint32)


def write(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the files below ``folder`` (shared by all executors); one manifest row for each, in part order."""
    n = partitions(df.sparkSession)
    cuts = bounds(df, id_col, n)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), range_of(id_col, cuts).alias(RANGE))
    rows = rows.repartition(n, RANGE).sortWithinPartitions(RANGE, F.asc_nulls_first("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        part = None
        stack = None

        def finish():
            made = writer.close()
            stack.__exit__(None, None, None)
            return pa.RecordBatch.from_pydict({"path": [name], "part": pa.array([part], pa.int32()), "n_docs": [made[0]], "n_tokens": [made[1]], "n_bytes": [made[2]]})

        for batch in tx.slices(batches, "text", 2 << 20):
            ids, off = table.encode(batch.column("text"), end_id)
            for i, (doc, p) in enumerate(zip(batch.column("id").to_pylist(), batch.column(RANGE).to_pylist())):
                if p != part:
                    if part is not None:
                        yield finish()
                    part, name = p, files.own_name(folder, f"tokens-{p:06d}", ".zst")
                    stack = files.writing(name)
                    writer = Writer(stack.__enter__())
                writer.add(doc, ids[off[i] : off[i + 1]])
        if part is not None:
            yield finish()

    return rows.mapInArrow(run, MANIFEST)


def read(spark, manifest: list, wanted: list | None = None) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids (little-endian bytes) from the files.

    ``manifest``: the collected rows of ``write``, one for each file. With
    ``wanted``, only the frames that hold these document ids are decompressed.
    """
    parts, base = [], 0
    for row in sorted(manifest, key=lambda r: r["part"]):
        parts.append((row["path"], base))
        base += row["n_tokens"]
    paths = spark.createDataFrame(parts, "path string, base long").repartition(max(1, len(parts)), "path")
    keep = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with files.reading(path) as source:
                    reader = Reader(source)
                    chosen = [i for i, d in enumerate(reader.doc_ids) if keep is None or d in keep]
                    for a in range(0, len(chosen), 256):
                        some = chosen[a : a + 256]
                        found = [reader.document(i) for i in some]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([reader.doc_ids[i] for i in some], pa.int64()),
                            "start": pa.array([before + int(reader.start[i]) for i in some], pa.int64()),
                            "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                            "ids": pa.array([x.tobytes() for x in found], pa.binary())})

    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "token-files")
    manifest = scratch.keep(write(docs, scratch.at("data"), public_tokenizers.path("word_bpe_49k.json")), "manifest")
    return read(spark, manifest.collect()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
