import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import components as components_module
from tallyloom.llm import ngram_join as nj
from tallyloom.llm.components import components
from tallyloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TYPES = "doc_id long, text string, component_id string"


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def plain(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            common = len(sets[i] & sets[j])
            if same_id or (common and 100 * common >= percent * len(sets[i] | sets[j])):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    boiler = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(14):
        base = [f"w{k}x{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 6, 9, 14, 40, 130, 300]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(words) // 40, len(words) // 30])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"] if rng.random() < 0.8 else []
                words = words or ["x"]
            rows.append((len(rows) * 3 % 97 + 100 * (len(rows) // 90), " ".join(rng.choice([w, w.upper()]) for w in words)))
    for k in range(40):  # mostly common text: all hot keys, mostly unlinked
        own = [f"o{k}y{i}" for i in range(rng.randrange(1, 30))]
        rows.append((1000 + k, " ".join(boiler + own)))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "a"), (2004, "A"), (2005, "a b"), (None, "a b"), (None, None), (2003, "quite another text of words here"), (2006, "z " * 900), (2007, "z z z z z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,chunk,percent,n", [(1, 32, 1 << 20, 75, 5), (2, 2, 1 << 20, 75, 5), (3, 1, 50, 75, 5), (4, 3, 200, 60, 2)])
def test_components_equal_brute_force(spark, seed, hot, chunk, percent, n, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(components_module, "FEW", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "own") for r in rows], TYPES).repartition(4)
    got = nj.Join(df, n=n, percent=percent, hot=hot, chunk=chunk).result().collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got) == plain(rows, n, percent)


def test_links_are_true_links(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, "x y")]
    join = nj.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    edges, _ = join.links()
    assert edges.count() == 1 and join.digests.select("set_id").distinct().count() == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(df).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(1)
    for _ in range(100):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))]
        b = a[: rng.randrange(1, len(a))] + [f"v{rng.randrange(40)}" for _ in range(rng.randrange(5, 200))]
        texts = [" ".join(a), " ".join(b)]
        flat, off = nj.shingle_sets(pa.array(texts), 3)
        x, y = (np.frombuffer(s, np.uint64) for s in nj.sketches(flat, off))
        assert nj.hamming(x, y) <= len(shingles(texts[0], 3) ^ shingles(texts[1], 3))


def test_a_bucket_taken_in_pieces_finds_the_same():
    rng = np.random.default_rng(0)
    codes, sets = rng.integers(0, 40, 600).astype(np.uint32), rng.integers(0, 50, 600)
    sizes = {c: len({s for k, s in zip(codes, sets) if k == c}) for c in set(codes.tolist())}
    warm = {(min(a, b), max(a, b)) for c in sizes if sizes[c] <= 8 for a in sets[codes == c] for b in sets[codes == c] if a != b}
    hot = {(c, s) for c, s in zip(codes.tolist(), sets.tolist()) if sizes[c] > 8}
    for step in (600, 37):
        bucket, pairs, members = nj.Bucket(0, 8), set(), []
        for a in range(0, 600, step):
            z = slice(a, a + step)
            p, (key, s, _) = bucket.take(codes[z], sets[z], np.zeros(len(codes[z]), np.uint8))
            pairs |= {tuple(x[:2]) for x in p.tolist()}
            members += zip(key.tolist(), s.tolist())
        assert warm <= pairs and hot <= set(members)


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_long_chains_are_one_component(spark, few, monkeypatch):
    monkeypatch.setattr(components_module, "FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
