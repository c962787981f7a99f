"""The stages against plain loops over a small corpus with planted cases."""

import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from tallyloom.llm import toxicity
from tests.llm.test_block_dedup import plain as plain_runs
from tests.llm.test_codec_and_search import plain as plain_search
from tests.llm.test_ngram_join import plain as plain_groups


FOREIGN = ["kept", "n_words", "items", "hit_words", "score", "row", "key", "no_text", "__key", "__range"]


def test_the_stages_equal_plain_loops(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(3, 9)))
    make = lambda n: [word() for _ in range(n)]
    passage, item = make(40), make(25)
    rows, labels = [], []
    for i in range(150):
        words = make(rng.randrange(20, 120))
        toxic = rng.random() < 0.2
        if toxic:
            words[3:3] = ["kwimble", "blurgh"]
        if i % 11 == 0:
            words += passage
        if i % 13 == 5:
            words += item[4:18]
        rows.append((i, " ".join(words) + "\n", "en", f"s{i % 3}", 0))
        labels.append((i, int(toxic)))
    for i in range(150, 170):
        near = rows[i - 150][1].split()
        if i % 2:
            near[7:8] = ["changed"]
        rows.append((i, " ".join(near), "en", "copy", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (None, rows[2][1], "en", "s", 1), (4, rows[4][1], "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *[f"{c} of {r[0]}" for c in FOREIGN]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in FOREIGN))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(item)), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got, frame = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, frame, str(tmp_path))
        assert k == len(cp.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{k}")
        frame = spark.read.parquet(f"{tmp_path}/out-{k}")
        assert all(r[c] == f"{c} of {r.doc_id}" for r in frame.select("doc_id", *FOREIGN).collect() for c in FOREIGN)
        got[name] = sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    # 1: every toxic document goes, hardly any other
    told = {i for i, y in labels if y}
    left = {d for d, _ in got["toxicity"]}
    assert not {i for i, t, *_ in rows if t and "kwimble" in t} & left
    assert len(left & ({r[0] for r in rows} - told)) >= 0.97 * len({i for i, t, *_ in rows if not t or "kwimble" not in t})
    # 2: the least of each group stays
    before = got["toxicity"]
    groups = {(d, c) for d, _, c in plain_groups([(d, t) for d, t in before], 5, 75)}
    assert {str(d) for d, _ in got["near_duplicates"]} == {d for d, c in groups if d == c}
    assert len(got["near_duplicates"]) == len({d for d, _ in got["near_duplicates"]})
    # 3: the words that plain loops leave
    want = plain_runs(got["near_duplicates"], 13)
    assert [(str(d), " ".join((t or "").split())) for d, t in sorted(got["substring_dedup"], key=lambda r: str(r[0]))] == sorted((d, kept) for d, _, _, kept in want)
    assert sum(n for _, _, n, _ in want) > 0 and (300, None) in got["substring_dedup"]
    # 4: exactly the documents with a window go
    clean = [(d, t) for d, t in got["substring_dedup"] if plain_search(t, items, 10)[1] == 0]
    assert got["decontamination"] == clean and len(clean) < len(got["substring_dedup"])
    # 5: the library's ids and texts
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(r.ids) == sp.encode(r.text or "") and r.decoded == sp.decode(list(r.ids)) for r in frame.collect())
    whole = cp.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.n_tokens) for r in whole.collect()), key=str) == sorted(((r.doc_id, r.n_tokens) for r in frame.collect()), key=str)
