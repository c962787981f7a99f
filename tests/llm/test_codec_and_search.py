"""SentencePiece against the library text by text; Wu-Manber search against a plain scan."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from tallyloom.llm import decontaminate as dc
from tallyloom.llm import sentencepiece_codec as spc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "a ", " a", "a  b", "  a b  ", "\n", "\n ", " \n", "a\n b", "▁", "▁a ▁b", "a▁", "<s> x </s>", "日本 語", "é́ 😀😀", "\t\tx", "  　", "<0x41>", "a\0b", "x" * 3000]


def test_encode_and_decode_equal_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ab▁\n<éß.0") for _ in range(rng.randrange(60))) for _ in range(2000)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = spc.Codec(MODEL)
    assert codec.by_word
    ids, off = codec.encode(pa.array(texts))
    want = sp.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    assert [t for t, x, y in zip(texts, got, want) if x != y] == []
    assert codec.decode(ids, off).to_pylist() == [sp.decode(x) for x in want]
    codec.by_word = False
    ids2, off2 = codec.encode(pa.array(texts))
    assert (ids2 == ids).all() and (off2 == off).all()


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(spc, "TABLE_WORDS", 3)
    codec = spc.Codec(MODEL)
    for t in ["a b c", "d e f g h", "a b"]:
        ids, _ = codec.encode(pa.array([t]))
        assert ids.tolist() == codec.sp.encode(t)


def test_codec_frames(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", None), (None, "a b", "x"), (2, "a b", "y")], "doc_id long, text string, ids string")
    rows = spc.decode(spc.encode(df, MODEL), MODEL).orderBy("decoded", "doc_id").collect()
    assert [(r.doc_id, r.text, len(r.ids), r.decoded) for r in rows] == [(1, None, 0, ""), (2, "", 0, ""), (None, "a b", 2, "a b"), (2, "a b", 2, "a b")]
    assert spc.decode(spc.encode(df.where("false"), MODEL), MODEL).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items, window):
    low = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = low(text), set(), set()
    for item, t in items:
        w = low(t)
        m = min(window, len(w))
        wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in wins:
                hit.update(range(i, i + m))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("portion", [1 << 20, 12])
def test_search_equals_a_plain_scan(spark, monkeypatch, portion):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", portion)
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice(["a", "B", "b", "é", "Éx", "7"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([3, 4, 9, 2, 1, 30, 6])] + [(20, None), (21, ""), (22, "..."), (None, "q r s")]
    docs = [(i, make(rng.randrange(80)), "own") for i in range(60)] + [(100, None, ""), (101, "", None), (None, "Q, R; s", "x"), (3, items[5][1] * 2, "z"), (3, items[5][1] * 2, "z")]
    got = dc.search(spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    assert len(got) == len(docs)
    want = sorted((str(d), str(t), *plain(t, [(i if i is not None else "", x) for i, x in items], 4)) for d, t, _ in docs)
    assert sorted((str(r.doc_id), str(r.text), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert all(sum(h.end - h.start for h in r.hit_words) == r.n_hit for r in got)


def test_stretches_meet_at_their_borders(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice("ab") for _ in range(200))
    items = [("x", " ".join(rng.choice("ab") for _ in range(40)))]
    want = plain(text, items, 6)
    for stretch in (1, 2, 7, 512):
        monkeypatch.setattr(dc, "STRETCH", stretch)
        n, hit, ids, runs = dc._find(pa.array([None, text, ""]), dc.matchers(items, 6))[1]
        assert (n, hit, ids) == want and hit > 0


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.search(docs, none).collect()[0].n_hit == 0
    assert dc.search(docs.where("false"), none).count() == 0
