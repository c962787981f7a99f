import random
import re

from tallyloom.llm import licenses as lic


def plain(text):
    out = []
    lines = (text or "").split("\n")
    units = list(enumerate(lines)) + ([(-1, " ".join(lines))] if len(lines) > 1 else [])
    for i, unit in units:
        words = [w for w in (x.rstrip(".") for x in re.sub(r"[^a-z0-9.]+", " ", unit.lower()).split(" ")) if w]
        grams = {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)
        best = None
        for name, t in sorted(lic.TEMPLATES.items()):
            g = set(lic.template_bigrams(t))
            d = 2 * len(g & grams) / (len(g) + len(grams)) if grams else 0
            if d >= lic.THRESHOLD and (best is None or d > best[2]):
                best = (i, name, d)
        if best:
            out.append(best)
    return out


def test_scan_equals_a_plain_loop(spark):
    rng = random.Random(7)
    texts = [None, "", "\n", "..", "All rights reserved", "ALL   RIGHTS\treserved...", "x" * 5000]
    for _ in range(400):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(list(lic.TEMPLATES.values())).split(" ")
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.randrange(2)] = rng.choice([[], ["foo"], ["All", "rights"], ["4.0..."]])
            lines.append(rng.choice([" ", "  ", " - "]).join(words))
        texts.append(rng.choice(["\n", " "]).join(lines))
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    got = {r.doc_id: [(m.unit, m.name, m.dice) for m in r.licences] for r in lic.scan(df).collect()}
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: (got[i], want[i], texts[i]) for i in got if got[i] != want[i]} == {}
    assert sum(map(len, want.values())) > 200
    assert lic.scan(df.where("false")).count() == 0


def test_the_plan_is_native_and_narrow(spark, tmp_path):
    spark.createDataFrame([(1, "MIT License")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lic.op5_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
