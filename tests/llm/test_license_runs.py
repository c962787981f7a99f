import random
import re
import textwrap

from pyspark.sql import functions as F

from tallyloom.llm import licenses as lic


def words_of(text):
    return [w for w in (x.rstrip(".") for x in re.sub(r"[^a-z0-9.]+", " ", text.lower()).split(" ")) if w]


def grams_of(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def apart(runs):
    out = []
    for r in runs:
        if all(r["e"] < q["s"] or q["e"] < r["s"] for q in out):
            out.append(r)
    return out


def plain_runs(text, old, wide):
    """All runs against all templates."""
    tables = {n: set(lic.template_bigrams(t)) for n, t in {**lic.TEMPLATES, **wide}.items()}
    shared = []
    for unit, name, _ in old:
        words = words_of(text.split("\n")[unit] if unit >= 0 else text)
        shared.append((unit, len((grams_of(words) or set(words)) & tables[name])))
    pieces = [(i, w) for i, line in enumerate((text or "").split("\n")) for p in re.split(r"(?:(?<=[.!?])|(?<=[.!?][\"')\]]))\s+", line) if (w := words_of(p))]
    every = []
    for name, t in tables.items():
        found = []
        for s in range(len(pieces)):
            best, words = None, []
            for e in range(s, len(pieces)):
                words = words + pieces[e][1]
                g = grams_of(words)
                dice = 2 * len(g & t) / (len(g) + len(t))
                if dice >= lic.THRESHOLD and (best is None or dice > best["dice"]):
                    best = {"c": len(g & t), "dice": dice, "name": name, "s": s, "e": e, "l0": pieces[s][0], "l1": pieces[e][0]}
            if best and not any(c >= best["c"] and (u == -1 or best["l0"] <= u <= best["l1"]) for u, c in shared):
                found.append(best)
        every += apart(sorted(found, key=lambda r: (-r["dice"], -r["s"])))
    return [(r["l0"], r["name"], r["dice"]) for r in apart(sorted(every, key=lambda r: (-r["c"], -r["dice"], r["name"], r["s"])))]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lic.scan(df, runs=lic.wide_templates()).collect()
    return {r.doc_id: [(m.unit, m.name, m.dice) for m in r.licences] for r in rows}


def test_real_licences_and_notices_are_found(spark):
    text = {n.removesuffix("-text"): t for n, t in lic.wide_templates().items()}
    filler = [f"def value{i}(x): return x * {i}" for i in range(60)]
    wrapped = lambda name, width, lead: [lead + x for x in textwrap.wrap(" ".join(text[name].split()), width)]
    cases = {
        "MIT-text": "\n".join(["Copyright (c) 2020 Someone", ""] + wrapped("MIT", 72, "# ") + filler),
        "ISC-text": "\n".join(filler + wrapped("ISC", 60, " * ") + filler),
        "GPL-3.0-notice": "\n".join(filler + wrapped("GPL-3.0-notice", 75, "// ") + filler),
        "MIT": "\n".join(filler + ["This is a small tool. Released under the MIT License. Have fun with it today."] + filler),
        "CC-BY-4.0": "\n".join(filler + ["All pictures are ours. Licensed", "under CC BY 4.0. See the site."] + filler),
        "ISC": "\n".join(filler + textwrap.wrap(lic.TEMPLATES["ISC"], 75) + filler),
        "Apache-2.0-text": "\n".join(filler + text["Apache-2.0"].split("\n") + filler),
        "GPL-3.0-text": "\n".join(text["GPL-3.0"].split("\n") + filler),
    }
    got = scanned(spark, list(cases.values()))
    for i, name in enumerate(cases):
        assert max((d for _, n, d in got[i] if n == name), default=0) > 0.9, (name, got[i])
    both = scanned(spark, ["\n".join(wrapped("MIT", 70, "") + filler + wrapped("MIT", 50, ""))])[0]
    assert [n for _, n, _ in both] == ["MIT-text", "MIT-text"]


def test_runs_equal_a_plain_loop(spark):
    rng = random.Random(11)
    sources = list(lic.TEMPLATES.values()) + [t for t in lic.wide_templates().values() if len(t) < 1500]
    texts = [None, "", "\n\n", ". . .", "one"]
    for _ in range(60):
        out = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(sources).split()
            for _ in range(rng.randrange(6)):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.randrange(3)] = rng.choice([[], ["foo."], ["All", "rights"], ["under", "the", "License."]])
            out += words + rng.choice([[], ["Some", "other", "text."]])
        texts.append("".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\n\n"][: rng.choice([3, 6])]) for w in out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = lic.wide_templates()
    old = {r.doc_id: [(m.unit, m.name, m.dice) for m in r.licences] for r in lic.scan(df).collect()}
    got = scanned(spark, texts)
    want = {i: old[i] + plain_runs(t, old[i], wide) for i, t in enumerate(texts)}
    assert {i: (got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert sum(len(want[i]) > len(old[i]) for i in want) > 20


def test_separators_are_matched_by_the_quick_class(spark):
    texts = ["a\x00b-c.d/e:f`g{h|i", "Aé0 9.ø.퟿z￿y", "\U0001f600x\U0010ffffy..", "ÀB İ K ...", "a.b. .c .. d...\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", "text", lic._words(F.col("text")).alias("w"), F.lower("text").alias("l")).collect()
    assert {r.id: r.w for r in rows} == {r.id: words_of(r.l) for r in rows}
    # The complement of a class is some ten times slower in Java's matcher.
    plan = lic.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), runs=lic.wide_templates())._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9.]" not in plan
