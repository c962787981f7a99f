"""Token files, WARC archives and fingerprints against plain loops and round trips."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tallyloom.llm import fingerprints as fp
from tallyloom.llm import token_files as tf
from tallyloom.llm import warc
from tallyloom.llm.scratch import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_encoded_as_the_library_encodes_texts(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [None, "", " ", "a  b\n\tC", "Don't WE'LL", "x y　z\x85w", "É ́e", "ΣΑΣ Σ", "<|endoftext|>a <|startoftext|>", "日本語 テスト", "1234 5.6"]
    texts += ["".join(rng.choice("aB '<|>\n éΣ1.　") for _ in range(rng.randrange(50))) for _ in range(800)]
    want = [e.ids + [1] for e in Tokenizer.from_file(WORD_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    table = tf.WordTable(WORD_BPE)
    for limit in (10**6, 50):
        monkeypatch.setattr(tf, "TABLE_WORDS", limit)
        ids, off = table.encode(pa.array(texts, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_frames_are_independent_and_checked(monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 10)
    out = io.BytesIO()
    writer = tf.Writer(out)
    docs = [np.arange(n, dtype=np.uint32) + n for n in (3, 0, 9, 25, 1, 1)]
    for i, d in enumerate(docs):
        writer.add(i if i else None, d)
    n, total, size = writer.close()
    raw = out.getvalue()
    assert (n, total, size) == (6, 39, len(raw))

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = tf.Reader(Source(raw))
    assert reader.doc_ids == [None, 1, 2, 3, 4, 5]
    assert all((reader.document(i) == d).all() for i, d in enumerate(docs))
    bad = bytearray(raw)
    bad[-13 - 12] ^= 1  # the last data frame's checksum or the index entry's; a data frame's byte below
    bad[5] ^= 0xFF
    with pytest.raises(Exception):
        r = tf.Reader(Source(bytes(bad)))
        for i in range(6):
            r.document(i)


def test_written_files_read_back(spark):
    rows = [(5, "b a"), (None, "n"), (3, None), (9, ""), (5, "a b"), (5, "a b"), (1, "w " * 500)] + [(i, f"t{i} x") for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    manifest = scratch.keep(tf.write(df, scratch.at("data"), WORD_BPE), "m").collect()
    got = sorted(tf.read(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 3, 5, 5, 5, 9, *range(20, 60)]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    table = tf.WordTable(WORD_BPE)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [table.encode(pa.array([t], pa.string()), 1)[0].tolist() for _, t in order]
    assert {r.doc_id for r in tf.read(spark, manifest, wanted=[3, 59]).collect()} == {3, 59}
    empty = scratch.keep(tf.write(df.where("false"), scratch.at("none"), WORD_BPE), "e")
    assert tf.read(spark, empty.collect()).count() == 0


def plain_winnow(text, k, window):
    from tallyloom.llm import textops as tx

    if not text:
        return []
    k = min(k, len(text))
    mult = int(fp._MULT)
    code = [int(x) for x in tx.mix(np.array([ord(c) for c in text], np.uint32) + fp._MULT)]
    hashes = []
    for i in range(len(text) - k + 1):
        h = 0
        for c in code[i : i + k]:
            h = (h * mult + c) % (1 << 64)
        hashes.append(int(tx.mix(np.array([h], np.uint64))[0]) >> 32)
    window = min(window, len(hashes))
    chosen = []
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        at = max(j for j in range(window) if part[j] == min(part)) + i
        if not chosen or chosen[-1][1] != at:
            chosen.append((hashes[at], at))
    return chosen


@pytest.mark.parametrize("k,window", [(1, 1), (4, 3), (5, 4), (7, 9), (16, 33)])
def test_winnowing_equals_a_plain_loop(k, window):
    rng = random.Random(k)
    for n in [0, 1, 2, 3, 6, 15, 16, 17, 40, 48, 49, 200]:
        text = "".join(rng.choice("aab é😀") for _ in range(n))
        h, p = fp.winnow(text, k, window)
        assert list(zip(h.tolist(), p.tolist())) == plain_winnow(text, k, window)


def test_shared_runs_share_a_hash():
    rng = random.Random(5)
    for _ in range(50):
        common = "".join(rng.choice("abcdef") for _ in range(fp.K + fp.WINDOW - 1))
        texts = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(90))) + common + "zz" * rng.randrange(30) for _ in range(2)]
        assert {*fp.winnow(texts[0])[0].tolist()} & {*fp.winnow(texts[1])[0].tolist()}


@pytest.mark.parametrize("rows", [
    [(i, f"text {i} " * (i % 7)) for i in range(50)] + [(7, "again"), (49, "top too"), (None, "n2"), (None, "n1"), (0, None)],
    [(3, "alone in the table")], [(None, "x"), (None, "a")], [], [(1, "b"), (1, "a"), (1, "a")],
])
def test_neighbours_equal_a_plain_loop(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fp.compare_neighbours(df, k=4, window=3).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        sets = [{h for h, _ in plain_winnow(x, 4, 3)} for x in (t, edited, nxt)]
        like = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
        want.append((str(d), len(t), edited, like(sets[0], sets[1]), like(sets[0], sets[2])))
    assert sorted((str(r.doc_id), r.n_chars, r.edited, r.near_edited, r.near_next) for r in got) == sorted(want)
    prints = {}
    for r, t in zip(sorted(got, key=lambda r: (str(r.doc_id), r.edited)), range(99)):
        prints.setdefault(r.edited, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())


PAGES = "page_id long, url string, html string, digest string"


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 5000)
    big, odd = "é" * 700, "\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/é x", big), (2, None, big), (9, "u", big), (9, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "s" * 999), (6, "u", "s" * 999), (7, "u", odd), (8, "u", "x" * 20000), (None, "u", big), (None, "u", odd + "n"), (1, "u", "z" * 1200), (12, "u", "z" * 1200)]
    df = spark.createDataFrame([(*r, "own") for r in rows], PAGES).repartition(2)
    scratch = Scratch(spark, "w")
    whole = scratch.keep(warc.write(df, scratch.at("a")), "m")
    members = scratch.keep(warc.normalise(whole, scratch.at("b")), "n")
    got = warc.read(members).collect()
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, x in rows if (x or "") == (h or "") and q is not None]
        revisit = len(raw) >= 1000 and same and p != max(same)
        want.append((str(p), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert whole.count() > 2 and sum(r.n_records for r in members.collect()) == len(rows)
    none = scratch.keep(warc.write(df.where("false"), scratch.at("c")), "o")
    assert warc.read(scratch.keep(warc.normalise(none, scratch.at("d")), "p")).count() == 0


def test_normalising_many_members_and_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    raws = [warc.record(i, "u", bytes(range(256)) * i, None) for i in range(6)]
    stream = gzip.compress(b"".join(raws[:3])) + gzip.compress(b"".join(raws[3:]))
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise_file(io.BytesIO(stream), out, index)[0] == 6
    assert [raw for raw, _ in warc.records(io.BytesIO(out.getvalue()))] == raws
    assert zlib.decompress(out.getvalue(), 31) == raws[0]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(stream[:-30])))
