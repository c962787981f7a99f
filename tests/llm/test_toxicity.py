import random
import zlib

import numpy as np
import pyarrow as pa

from tallyloom.llm import toxicity as tox


def plain_kernel(s, t, order, decay):
    """Sums over all pairs of equal subsequences, by positions."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_the_sum_over_subsequences():
    rng = random.Random(0)
    for _ in range(60):
        s, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(2))
        order = rng.randrange(1, 4)
        grid, _ = tox.codes_of([s, "zzz"])
        got = tox.subsequence_kernel(grid, np.array([ord(c) for c in t], np.uint32), order)
        assert abs(got[0] - plain_kernel(s, t, order, tox.DECAY)) < 1e-4 and got[1] == 0


def sample(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        y = rng.random() < 0.25
        for _ in range(rng.randrange(1, 4) if y else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["blurgh", "kwimble", "vezzu" + rng.choice(vocabulary)]))
        texts.append(" ".join(w + rng.choice(["", "", "", ".", "\n"]) for w in words))
        labels.append(int(y))
    return texts, np.array(labels)


def test_held_out_accuracy_and_obfuscated_words():
    texts, labels = sample(600, 1)
    model = tox.train(texts, labels)
    assert any("blurgh" in m or m in "blurgh" for m in model.landmarks) and len(model.landmarks) < 12
    more, truth = sample(300, 2)
    found = model.score(pa.array(more)) >= 0.5
    assert (found == (truth == 1)).mean() > 0.98
    for word in ("blurgh", "blu-rgh", "b l u r g h", "bluXrgh", "BLURGH!"):
        assert model.score(pa.array([f"tone is {word} son"]))[0] >= 0.5
    for text in (None, "", "   ", "tone son", "x" * 10000):
        assert model.score(pa.array([text], pa.string()))[0] < 0.5
    # Whole texts count, however long.
    assert model.score(pa.array(["tone son. " * 30000 + "kwimble"]))[0] >= 0.5


def test_a_small_table_of_words_changes_nothing(monkeypatch):
    texts, labels = sample(200, 3)
    model = tox.train(texts, labels)
    want = model.score(pa.array(texts))
    monkeypatch.setattr(tox, "TABLE_WORDS", 20)
    assert np.allclose(model.score(pa.array(texts)), want)
    assert np.allclose(np.concatenate([model.score(pa.array([t])) for t in texts]), want)


def test_frames(spark):
    texts, labels = sample(300, 4)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)] + [(None, None, 0.0), (5, texts[5], 1.0)], "doc_id long, text string, score double")
    truth = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = tox.fit(docs, truth)
    got = tox.score(docs, model).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (labels[r.doc_id] == 1) for r in held) >= 0.95 * len(held)
    none = tox.fit(docs, truth.where("false"))
    assert {r.score for r in tox.score(docs, none).collect()} == {0.0}
    assert tox.score(docs.where("false"), model).count() == 0
    # Rows of the held-out fold teach nothing.
    other = truth.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = tox.fit(docs, other)
    assert again.landmarks == model.landmarks and np.allclose(again.weights, model.weights)
