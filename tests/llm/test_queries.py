"""Every registered query on a small fixture: the contract's columns against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyloom.llm import fingerprints as fp
from tallyloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_block_dedup import plain as plain_runs
from tests.llm.test_codec_and_search import plain as plain_search
from tests.llm.test_files_and_prints import plain_winnow
from tests.llm.test_ngram_join import plain as plain_groups
from tests.llm.test_suffix_dedup import plain as plain_bytes

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeinorstÉß") for _ in range(rng.randrange(2, 9)))
    make = lambda n: [word() + rng.choice(["", "", ",", "."]) for _ in range(n)]
    passage, item = make(90), ["alpha", "Beta", "gamma"] * 5
    docs, labels = [], []
    for i in range(70):
        words = make(rng.randrange(1, 160))
        y = int(rng.random() < 0.3)
        if y:
            words[1:1] = ["kwimble", "blurgh!"]
        if i % 6 == 0:
            words += passage
        if i % 9 == 4:
            words += item[: rng.randrange(8, 15)] + ["it's", "1234"]
        docs.append((i, rng.choice([" ", "\n"]).join(words)))
        labels.append((i, y))
    for i in range(70, 80):
        near = docs[i - 70][1].split(" ")
        near[len(near) // 2 : len(near) // 2 + i % 2] = ["other"] * (i % 2)
        docs.append((i, " ".join(near)))
    docs += [(100, None), (101, ""), (102, " \n"), (103, "Released under the MIT License.\n" + docs[3][1]), (104, docs[3][1])]
    spark.createDataFrame([(*d, "en", "s", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [("b1", " ".join(item)), ("b2", "tone"), ("b3", None), ("a9", " ".join(item[2:12]))]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(i, f"http://h/{i}", html) for i, html in enumerate(["é" * 700, "x" * 999, "é" * 700, None, "", "x" * 999, "y" * 3000, "é" * 700])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, docs, dict(labels), items, pages


def run(spark, corpus, name, columns):
    found = QUERIES[name](spark, corpus[0])
    assert dict(found.dtypes).items() >= columns.items()
    return sorted(tuple(r[c] for c in columns) for r in found.collect())


def test_op1(spark, corpus):
    got = run(spark, corpus, "op1_ngram_jaccard", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert sorted((str(d), n, str(c)) for d, n, c in got) == plain_groups(corpus[1], 5, 75)
    assert len({c for _, _, c in got}) < len(got) - 5


def test_op2(spark, corpus):
    got = run(spark, corpus, "op2_substring_dedup", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    want = plain_runs(corpus[1], 13)
    assert sorted((str(d), *r) for d, *r in got) == sorted((d, n, gone, sha(kept)) for d, n, gone, kept in want) and sum(r[2] for r in got) > 100


def test_op3(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = run(spark, corpus, "op3_sentencepiece", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    ids = {d: sp.encode(t or "") for d, t in corpus[1]}
    assert got == sorted((d, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for d, x in ids.items())


def test_op4(spark, corpus):
    got = run(spark, corpus, "op4_suffix_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    want = plain_bytes([(t or "").encode() for _, t in corpus[1]], 400)
    assert got == sorted((d, n, gone, spans, sha(kept)) for (d, _), (n, gone, spans, kept) in zip(corpus[1], want)) and sum(r[2] for r in got) > 1000


def test_op5(spark, corpus):
    duckdb = pytest.importorskip("duckdb")
    got = run(spark, corpus, "op5_license_scan", {"doc_id": "bigint", "n_matches": "bigint", "licence_names": "string", "best_dice": "double"})
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{corpus[0]}/documents.parquet/*.parquet')")
    want = db.execute(ORACLE_SQL["op5_license_scan"]).fetchall()
    assert [(d, n, x, round(v, 6)) for d, n, x, v in got] == sorted((d, n, x, round(v, 6)) for d, n, x, v in want)
    assert (103, "MIT") in {(d, x) for d, _, x, _ in got}


def test_op6(spark, corpus):
    got = run(spark, corpus, "op6_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert [d for d, *_ in got] == sorted(d for d, _ in corpus[1])
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= s <= 1 and p == int(s >= 0.5) for d, h, s, p in got)
    held = [(p, corpus[2][d]) for d, h, _, p in got if h and d in corpus[2]]
    assert sum(p == y for p, y in held) >= 0.9 * len(held) > 5


def test_op7(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, corpus, "op7_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    want, start = [], 0
    for d, t in sorted(corpus[1]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_op8(spark, corpus):
    got = run(spark, corpus, "op8_fingerprints", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "positions": "string"})
    order = sorted(((d, t or "") for d, t in corpus[1]), reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    want, prints = [], {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        own, other, after = (plain_winnow(x, fp.K, fp.WINDOW) for x in (t, edited, nxt))
        sets = [{h for h, _ in x} for x in (own, other, after)]
        want.append((d, len(t), sha(edited), like(sets[0], sets[1]), like(sets[0], sets[2]), ",".join(str(p) for _, p in own)))
        prints[t], prints[edited] = tuple(own), tuple(other)
    assert [(d, n, e, x, y, p) for d, n, e, _, _, x, y, p in got] == sorted(want)
    # Equal fingerprints are those of equal chosen hashes.
    texts = dict(order)
    told = {}
    for d, _, _, f, *_ in got:
        told.setdefault(f, set()).add(tuple(h for h, _ in prints[texts[d]]))
    assert all(len(x) == 1 for x in told.values())


def test_op9(spark, corpus):
    got = run(spark, corpus, "op9_warc", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})
    want = []
    for p, _, html in corpus[4]:
        raw = (html or "").encode()
        first = max(q for q, _, h in corpus[4] if (h or "") == (html or ""))
        revisit = len(raw) >= 1000 and p != first
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == want


def test_op10(spark, corpus):
    got = run(spark, corpus, "op10_benchmark_decontamination", {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"})
    want = []
    for d, t in corpus[1]:
        n, hit, items = plain_search(t, corpus[3], 10)
        want.append((d, n, hit, len(items), sha(",".join(items)), hit > 0))
    assert got == sorted(want) and any(r[5] for r in got) and not all(r[5] for r in got)
