import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import induced_sort as ind
from tallyloom.llm import suffix_dedup as sd


def check_order(t, depth, memory, base):
    order, lcp = ind.suffix_array(t, depth, memory, base)
    assert sorted(order.tolist()) == list(range(len(t)))
    for i in range(1, len(t)):
        a, b = t[order[i - 1] :], t[order[i] :]
        assert a[:depth] <= b[:depth]
        shared = next((k for k, (x, y) in enumerate(zip(a[:depth], b[:depth])) if x != y), min(depth, len(a), len(b)))
        assert shared == lcp[i], (t, depth, i)


def test_order_and_common_prefixes(monkeypatch):
    rng = random.Random(0)
    for _ in range(700):
        alphabet = rng.choice(["ab", "abc", "a", "abcdefgh", "\x00\x01a", "ÿ\x00"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))).encode("latin-1") * rng.choice([1, 1, 2, 4])
        monkeypatch.setattr(ind, "CHUNK", rng.choice([4, 16, 1 << 18]))
        memory = ind.Memory(rng.choice([1, 100, 1 << 20]))
        check_order(t, rng.choice([1, 2, 3, 5, 8, 16, 50, 400]), memory, rng.choice([1, 2, 7, 1 << 20]))
    check_order(bytes(range(256)) * 2 + b"z" * 300 + bytes(range(255, -1, -1)), 400, ind.Memory(64), 7)


def test_a_shard_far_larger_than_its_memory_is_sorted_through_files(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))).encode() for _ in range(60)]
    t = b" ".join(rng.choice(words) for _ in range(9000))
    want = ind.suffix_array(t, 50)
    monkeypatch.setattr(ind, "CHUNK", 1000)
    memory = ind.Memory(4096)
    got = ind.suffix_array(t, 50, memory, 500)  # names are sorted by recursion, with heaps of 500 tuples
    keys = [t[i : i + 50] for i in got[0].tolist()]
    assert keys == [t[i : i + 50] for i in want[0].tolist()] and (got[1] == want[1]).all()
    assert len(t) > 10 * memory.bound and memory.spilled > 8 * len(t)


def test_repeats_do_not_depend_on_the_blocks_of_the_sort(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        text = np.array([rng.choice(b"ab") for _ in range(rng.randrange(6, 90))], np.uint8)
        valid = np.array([rng.random() < 0.6 for _ in text])
        valid[-3:] = False
        monkeypatch.setattr(ind, "CHUNK", rng.choice([1, 3, 1000]))
        found = sd.repeats_of(text, valid, 4, ind.Memory(rng.choice([1, 1 << 20])))
        strings = [bytes(text[i : i + 4]) for i in range(len(text))]
        want = [bool(v) and sum(strings[j] == strings[i] and len(strings[i]) == 4 for j in np.flatnonzero(valid)) > 1 for i, v in enumerate(valid)]
        assert found.tolist() == want


def plain(texts, length):
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("length,gram,seed", [(400, 64, 1), (20, 6, 2), (9, 9, 3), (12, 1, 4)])
def test_equals_brute_force(spark, length, gram, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [make(rng.randrange(length // 2, 3 * length)) for _ in range(5)]
    rows = [(i, "".join(rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.5 else make(rng.randrange(length)) for _ in range(rng.randrange(5)))) for i in range(70)]
    rows += [(3, None), (None, ""), (None, passages[0]), (200, "a" * 3 * length), (201, "ab" * 2 * length), (201, "ab" * 2 * length), (7, make(4000))]
    df = spark.createDataFrame([(*r, "own", "en") for r in rows], "doc_id long, text string, kept string, __key string").repartition(3)
    got = sd.dedup(df, length=length, gram=gram).collect()
    want = plain([(t or "").encode() for _, t in rows], length)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((str(d), *w) for (d, _), w in zip(rows, want))
    assert sum(w[1] for w in want) > length


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [bytes(r.kept) for r in sd.dedup(df).collect()] == [b""]
    assert sd.dedup(df.where("false")).count() == 0


def test_long_matches_are_not_compared_again_for_every_suffix(monkeypatch):
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    text = np.frombuffer(passage + b"!" + passage[500:] + b"?" + passage[:2000], np.uint8)
    compared, plain_prefix = [], ind.common_prefix

    def counted(*args):
        found = plain_prefix(*args)
        compared.append(int(found.sum()))
        return found

    monkeypatch.setattr(ind, "common_prefix", counted)
    ind.suffix_array(text, 400)
    assert sum(compared) < 6 * len(text)  # some 60 times that otherwise


def test_common_prefixes_of_pairs_equal_a_plain_loop():
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice(rng.choice(["a", "ab", "abcd"])) for _ in range(rng.randrange(2, 60))).encode() * rng.choice([1, 2, 3])
        depth = rng.choice([1, 3, 8, 20, 400])
        pairs = [(i, j) for i in range(len(t)) for j in [rng.randrange(len(t)), (i + 7) % len(t)] if i != j]
        pairs = list(dict.fromkeys(pairs))
        a, b = (np.array(x) for x in zip(*pairs))
        want = [next((k for k in range(depth) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), depth) for i, j in pairs]
        assert ind.common_prefixes(np.frombuffer(t, np.uint8), a, b, depth).tolist() == want


def test_anchors_are_the_least_hashes_of_their_windows():
    rng = np.random.default_rng(5)
    for k in range(200):
        window, n = int(rng.integers(1, 40)), int(rng.integers(40, 400))
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        if k % 3:
            hashes = hashes[rng.integers(0, int(rng.integers(1, 30)), n)]  # equal ones
        if k % 5 == 0:
            hashes[100:160] = 7  # a row of equal least ones
        first, place = sd._runs_of_least(hashes, window, int(rng.choice([2, 8, 32, 1 << 40])))
        want = np.array([s + int(np.argmin(hashes[s : s + window])) for s in range(n - window + 1)])
        assert np.repeat(place, np.diff(np.append(first, len(want)))).tolist() == want.tolist()


def test_the_last_round_does_not_hash_the_texts_again(monkeypatch):
    table = pa.table({"text": ["x" * 3 + "abcdefgh" * 3, "abcdefgh" * 2, "zzzz"]})
    t = sd.Texts(table, 8, 3)
    found, here, group = t.asked()
    _, number, rows, again = t.shared(pa.table({"round": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())}), 1)
    note = sd._noted(t.starts, t.counts, number, rows, (t.anchors[rows] >> np.uint64(63)).astype(np.int64), again)
    monkeypatch.setattr(sd, "gram_hashes", None)
    buckets = t.anchors[rows] >> np.uint64(63)
    bits = [np.packbits(np.ones(int(t.counts[rows][buckets == b].sum()), bool)).tobytes() for b in (0, 1)]
    answers = pa.table({"round": [sd.NOTE, 2, 2], "bucket": [-1, 0, 1], "bits": [note, *bits]})
    gone = sd.repeated(len(t.buf), answers, 8)
    assert gone[3:27].all() and gone[27:43].all() and not gone[43:].any() and not gone[:3].all()
