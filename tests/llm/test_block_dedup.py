import random
import re

import pytest

from tallyloom.llm import block_dedup as bd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TYPES = "doc_id long, text string, n_words string, lang string"


def plain(rows, window):
    """(n_words, kept words) per row: a window goes if it starts in a document with a smaller id."""
    rank = lambda d: d if d is not None else 1 << 70
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 71), rank(d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone[i : i + window] = [True] * window
        out.append((str(d), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window,seed", [(13, 1), (5, 2), (3, 3)])
def test_equals_brute_force(spark, window, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.randrange(window - 2, 3 * window))] for k in range(6)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randrange(2 * window))]
        rows.append((rng.choice([i, i, i, 7, None]), "".join(w + rng.choice([" ", "\n", "\t "]) for w in words)))
    rows += [(500, None), (501, ""), (502, " \n"), (0, "x " * 400), (503, "x " * 400), (503, "é　ß " * 30), (504, "é　ß " * 30)]
    df = spark.createDataFrame([(*r, "own", "en") for r in rows], TYPES).repartition(3)
    got = bd.dedup(df, window=window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == plain(rows, window)
    laid = bd.dedup(df, window=window, layout=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, " ".join(WORD.findall(r.kept))) for r in laid) == plain(rows, window)
    originals = {t or "" for _, t in rows}
    assert all(r.kept in originals for r in laid if r.n_removed == 0)
    assert {r.lang for r in got} == {"en"}


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, "", ""), (2, "  ", "", "")], TYPES)
    assert [(r.n_words, r.kept) for r in bd.dedup(df).collect()] == [(0, ""), (0, "")]
    assert bd.dedup(df.where("false")).count() == 0
