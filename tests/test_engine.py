"""Operators of the engine against hand-made cases, brute force and the SQL of their queries."""

import csv
import hashlib
import itertools
import json
import os
import random
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import clean
from tallyloom.functions.similarity import partial_ratio, ratio, weighted_ratio
from tallyloom.operators import name_letters as letters, resolve as rs
from tallyloom.operators.dedupe import collapse
from tallyloom.operators.upsert import target_rows, upsert_crosswalk, upsert_rows, violations
from tallyloom.operators.validate import as_json, validate
from tallyloom.plans import measures
from tallyloom.schemas import CROSSWALK, ERP_COLUMNS, SEQ

MOJI = lambda s: s.encode("utf-8").decode("cp1252", errors="replace")


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_missing_markers(spark):
    assert one(spark, ["", "N/A", "NULL", "--", "unknown", None, "N/A ", "n/a", "Alice Smith"], clean.missing_to_null) == [None] * 6 + ["N/A ", "n/a", "Alice Smith"]


def test_dates(spark):
    day = date(2024, 3, 7)
    seconds = str(int(datetime(2024, 3, 7, tzinfo=timezone.utc).timestamp()))
    good = ["2024-03-07", "03/07/2024", "3/7/2024", "07-03-2024", "07 Mar 2024", "7  mar 2024", "2024/03/07", "20240307", " 2024-03-07\t", seconds]
    bad = ["0000-00-00", "TBD", "N/A", "", "2024", None, "2024-03", "2024-3-7", "2024-02-30", "13/13/2024", "9" * 30]
    got = one(spark, good + bad, clean.parse_date)
    assert got[: len(good)] == [day] * len(good)
    assert [x for v, x in zip(bad, got[len(good) :]) if v != "2024"] == [None] * (len(bad) - 1)
    assert got[len(good) + 4] == date(1970, 1, 1)  # digits alone are seconds


def test_mojibake(spark):
    def want(text):
        if text is None or "�" in text:
            return None
        try:
            fixed = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text
        return None if "�" in fixed else fixed

    texts = ["RenÃ©e", "Bob Jones", "café", "x�", None, "", MOJI("Ñandú"), MOJI("Á"), "€5", MOJI("naïve – “q”"), "日本", "\x81", "Ã", MOJI("ü") * 3 + "é"]
    assert one(spark, texts, clean.repair_mojibake) == [want(t) for t in texts]


def test_contacts_and_money(spark):
    assert one(spark, [" A@B.c\t", "", "  ", None], clean.normal_email) == ["a@b.c", None, None, None]
    assert one(spark, ["+1 (2) 3x4", "none", None], clean.normal_phone) == ["1234", None, None]
    assert one(spark, ["1e3", " 12 ", "NaN", "12.50", "x", None], clean.money) == [Decimal(1000), Decimal(12), None, Decimal("12.5"), None, None]
    assert one(spark, ["A-DUP2", "A-DUP2-DUP13", "A-DUP", "A-DUP2 ", None], clean.base_key) == ["A", "A-DUP2", "A-DUP", "A-DUP2 ", None]


def pick(values):
    seen = list(dict.fromkeys(values))
    if len(seen) == 1 or any(v is None for v in seen):
        return seen[0]
    tidy = [v for v in seen if v == v.strip()] or seen
    return ([v for v in tidy if v != v.upper()] or tidy)[0]


def test_collapse_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["A", "A-DUP2", "B", "C-DUP3", "D", "D-DUP2", None]), rng.choice([None, "", "x", " x ", "X", "\tÉ", "é"]), rng.choice(["p", "P", " p", None]), i) for i in range(60)]
    rows.append(("lone-DUP7", "v", "w", 60))
    df = spark.createDataFrame(rows, f"k string, a string, b string, {SEQ} int").repartition(3)
    out, log = collapse(df, "k")
    groups, want, logs = {}, [], []
    for r in rows:
        if r[0] is None:
            want.append(r[:3])
        else:
            groups.setdefault(r[0].split("-DUP")[0], []).append(r)
    for base, members in groups.items():
        if len(members) == 1:
            want.append(members[0][:3])
            continue
        want.append((base, pick([m[1] for m in members]), pick([m[2] for m in members])))
        logs.append((base, len(members), [c for c, i in (("a", 1), ("b", 2)) if len({m[i] for m in members}) > 1]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.k, r.a, r.b) for r in out.collect()), key=key) == sorted(want, key=key)
    assert sorted((r.key_value, r.row_count, r.differing_columns) for r in log.collect()) == sorted(logs)


def test_validation_reasons_and_raw_rows(spark):
    good = {"CUST_ID": "C1", "CUST_NAME": "RenÃ©e", "EMAIL_ADDR": "--", "CREATED_DT": "07 Mar 2024"}
    cases = [({}, None, None), ({"CUST_NAME": "N/A"}, "missing_required_field", "schema_validation"), ({"CREATED_DT": "TBD"}, "unparseable_date", "cleaning"), ({"CITY": "a�"}, "unrecoverable_encoding", "cleaning"), ({"CREATED_DT": "TBD", "CITY": "a�", "CUST_ID": ""}, "unparseable_date", "cleaning"), ({"CREATED_DT": "N/A"}, None, None)]
    rows = [{**dict.fromkeys(ERP_COLUMNS["customer"]), **good, **c} for c, _, _ in cases]
    df = spark.createDataFrame([tuple(r[c] for c in ERP_COLUMNS["customer"]) for r in rows], ", ".join(f"{c} string" for c in ERP_COLUMNS["customer"]))
    ok, bad = validate(df, "customer", "erp")
    assert [(r.full_name, r.email) for r in ok.collect()] == [("Renée", None)] * 2
    found = [(r.reason_code, r.stage, json.loads(r.original_data)) for r in bad.collect()]
    assert sorted((a, b, json.dumps(c)) for a, b, c in found) == sorted((reason, stage, json.dumps(r)) for r, (_, reason, stage) in zip(rows, cases) if reason)
    pay = spark.createDataFrame([("P1", "I1", "2024-01-01", "not-a-number"), ("P2", "I1", "2024-01-01", "5")], "PMT_NO string, INV_NO string, PMT_DT string, AMT string")
    ok, bad = validate(pay, "payment", "erp")
    assert [r.method for r in ok.collect()] == [None] and [r.reason_code for r in bad.collect()] == ["schema_invalid"]


def test_weighted_ratio_vectors():
    assert weighted_ratio("Alice Smith", "Alice Smith") == 100.0 and weighted_ratio("", "x") == 0.0
    assert ratio("ab", "ac") == 50.0
    assert weighted_ratio("Smith Alice", "Alice Smith") == 95.0
    assert weighted_ratio("this is a test", "this is a test!") == pytest.approx(96.551724, abs=1e-5)
    assert partial_ratio("this is a test", "this is a test!") == 100.0
    assert weighted_ratio("fuzzy", "a fuzzy bear that was") == 90.0
    rng = random.Random(0)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        assert ratio(a, b) == pytest.approx(200 * plain(a, b) / (len(a) + len(b)))


PERSON = "source_system string, business_key string, full_name string, email string, phone string"


def people(spark, system, rows):
    return spark.createDataFrame([(system, k, n, e, p) for k, n, e, p in rows], PERSON)


def resolved(crosswalk):
    return sorted(((r.erp_key, r.crm_key) for r in crosswalk.collect()), key=str)


def test_customers(spark):
    erp = people(spark, "erp", [("A1", "Alice Smith", "a@x", None), ("A2", "Bob Stone", None, None), ("A3", "Carla Diaz", None, None)])
    crm = people(spark, "crm", [("B9", "Alice Smith", "A@x ", None), ("B2", "Bob Stone", None, None), ("B3", "Bob Stone", None, None), ("B4", "Zoe Quill", None, None)])
    crosswalk, bad = rs.resolve_customers(erp, crm)
    assert resolved(crosswalk) == sorted([("A1", "B9"), ("A3", None), (None, "B4")], key=str)
    assert sorted(json.loads(r.original_data)["business_key"] for r in bad.collect()) == ["A2", "B2", "B3"]
    assert {(r.reason_code, r.stage) for r in bad.collect()} == {("ambiguous_match", "resolution")}


@pytest.mark.parametrize("threshold,side", [(0.75, 0), (0.75, 1000), (0.78, 0), (0.78, 1000), (0.9, 1000)])
def test_pruned_pairs_equal_the_nested_loop(spark, threshold, side, monkeypatch):
    monkeypatch.setattr(rs, "FEW", 0)
    monkeypatch.setattr(rs, "SIDE", side)
    rng = random.Random(int(threshold * 100))
    first, last = ["Ann", "Anna", "Maria", "Jon", "Jonathan", "R", "Al", "Ann Ann Ann"], ["Lee", "Li", "Smith", "Smyth-Jones", "de la Cruz", "Oberhausen-Winterberg", "X", "von und zu Hohenlohe-Waldenburg-Schillingsfuerst auf Bartenstein und Jagstberg"]

    def draw(n, tag):
        out = []
        for i in range(n):
            name = " ".join(rng.choice(first) for _ in range(rng.randrange(1, 3))) + " " + rng.choice(last)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(name) + 1)
                name = name[:at] + rng.choice(["", "x", "é", " "]) + name[at + rng.randrange(2) :]
            out.append((f"{tag}{i}", name or "q", rng.choice([None, None, "m1@x", "m2@x"]), rng.choice([None, None, "1", "2"])))
        return out

    erp, crm = people(spark, "erp", draw(90, "a")), people(spark, "crm", draw(90, "b"))
    pairs = lambda pruned: sorted((r.erp_key, r.crm_key, r.score) for r in rs.score_customers(erp, crm, threshold, pruned).collect())
    assert pairs(True) == pairs(False) and len(pairs(False)) > 5


def test_letters_meet_in_blocks_that_pass_no_driver(spark, monkeypatch):
    monkeypatch.setattr(letters, "BLOCK", 7)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    monkeypatch.setattr(rs, "NESTED", 0)  # these bound the nested loop only
    monkeypatch.setattr(rs, "FEW", 0)
    names = [hashlib.md5(str(i).encode()).hexdigest() for i in range(40)] + ["", "ab cd", "x y x", "a" * 40, "\u2003ab cd"]
    erp = people(spark, "erp", [(f"a{i}", n, None, None) for i, n in enumerate(names)])
    crm = people(spark, "crm", [(f"b{i}", n + "x" * (i % 3 == 0), None, None) for i, n in enumerate(names)])
    pairs = lambda pruned: sorted(map(tuple, rs.score_customers(erp, crm, 0.75, pruned).collect()))
    found = pairs(True)
    assert found == pairs(False) and {(f"a{i}", f"b{i}") for i in range(40)} <= {(a, b) for a, b, _ in found}


def test_names_of_the_same_letters_are_told_apart_before_they_are_paired(spark, monkeypatch):
    monkeypatch.setattr(letters, "PORTION", 100, raising=False)
    monkeypatch.setattr(rs, "FEW", 0)
    words = ["".join(p) for p in itertools.permutations(["bako", "duru", "gopa", "jexo", "pwat"])]
    long = "von und zu Hohenlohe-Waldenburg-Schillingsfuerst auf Bartenstein und Jagstberg"
    odd = [long, " ".join(sorted(long.split())), long + " und", long.replace("zu", "zum"), "Lee Ann Lee", "Ann Lee", "Ann\u2003Lee", "Ann", "Lee Anns", None, ""]
    erp = people(spark, "erp", [(f"a{i}", n, None, None) for i, n in enumerate(["BUILDING " + w.title() for w in words] + odd)])
    crm = people(spark, "crm", [(f"b{i}", n, None, None) for i, n in enumerate([w.title() + ("hilu" if i % 2 else "x") + " BUILDING" * (i % 3 > 0) for i, w in enumerate(words)] + ["BUILDING " + w.title() for w in words[::2]] + words[:9] + odd[::-1])])
    named = lambda df: df.select(F.col("business_key").alias("id"), F.col("full_name").alias("s"))
    near = letters.near_by_letters(named(erp), named(crm), (131, 211), 4, 0.9375 - 1e-9, rs.TOKEN_SCALE)
    assert near.count() < 2000  # of 27,000; 120 times 60 and more have the same letters
    pairs = lambda pruned: sorted(map(tuple, rs.score_customers(erp, crm, 0.75, pruned).collect()))
    found = pairs(True)
    assert found == pairs(False) and len(found) > 60


def test_blocks_hold_names_of_the_same_letters_and_are_of_even_size():
    names = ["Ann Lee"] * 5000 + [hashlib.md5(str(i // 2).encode()).hexdigest()[:: 1 - 2 * (i % 2)] for i in range(5000)]
    near = letters.neighbours(names, [str(i) for i in range(10000)])
    assert len(set(near[:5000])) > 4990 and len(set(near[:5000] >> 32)) == 1 and len(set(near[5000:] >> 32)) == 2500
    assert list(letters.neighbours(["a b", "ba", "b\ta"], ["x"] * 3) - letters.neighbours(["ab"], ["x"])[0]) == [0, 0, 0]


def test_a_report_reads_what_was_resolved_and_leaves_the_session_as_it_was(spark):
    from tallyloom import queries_exports
    from tallyloom.sources.workspace import CLEANUP, brief_shuffles

    before = spark.conf.get(CLEANUP)
    with brief_shuffles(spark):
        result = queries_exports._result(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == before
    for df in (result.crosswalk, result.clean["erp", "payment"], result.clean["crm", "payment"]):
        assert "Exchange" not in df._jdf.queryExecution().toString()


def test_quarantined_decimals_are_written_in_full(spark):
    # to_json alone writes the first two as 0E-18 and 1E-18
    amounts = ["0.000000000000000000", "0.000000000000000001", "-12345678901234567890.000000000000000005", "7.500000000000000000", None]
    rows = spark.createDataFrame([(f'a"{i},\n{{}}', x, None) for i, x in enumerate(amounts)], "key string, x string, none string")
    rows = rows.select("key", F.col("x").cast("decimal(38,18)").alias("amount"), F.col("x").cast("decimal(38,18)").cast("decimal(25,0)").alias("whole"), "none")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        found = [r[0] for r in rows.select(as_json(rows, rows.columns)).collect()]
        spark.conf.unset("spark.sql.ansi.enabled")
        whole = ["0", "0", "-12345678901234567890", "8", "null"]
        assert found == [f'{{"key":{json.dumps(f"""a"{i},{chr(10)}{{}}""")},"amount":{x or "null"},"whole":{w},"none":null}}' for i, (x, w) in enumerate(zip(amounts, whole))]


def test_non_reciprocal_top_is_ambiguous(spark):
    pairs = spark.createDataFrame([("A1", "B1", 0.8), ("A2", "B1", 0.9)], "erp_key string, crm_key string, score double")
    pairs = rs.mutual_top(pairs, "erp_key", "crm_key", "score")
    erp, crm = people(spark, "erp", [("A1", "x", None, None), ("A2", "y", None, None)]), people(spark, "crm", [("B1", "z", None, None)])
    crosswalk, bad = rs.outcomes("customer", erp, crm, pairs)
    assert resolved(crosswalk) == [("A2", "B1")] and [json.loads(r.original_data)["business_key"] for r in bad.collect()] == ["A1"]


def test_invoices_and_payments(spark):
    schema = "source_system string, business_key string, customer_business_key string, issue_date date, currency string, amount decimal(38,18)"
    d = date(2024, 1, 1)
    parents = spark.createDataFrame([("customer", "i", "E1", "C1"), ("customer", "j", "E2", None)], CROSSWALK)
    erp = spark.createDataFrame([("erp", "I1", "E1", d, "USD", Decimal("100.0")), ("erp", "I2", "E2", d, "USD", Decimal(5)), ("erp", "I3", "E1", d, "EUR", Decimal(7)), ("erp", "I4", "E1", d, "EUR", Decimal(7)), ("erp", "I5", "E1", d, "USD", Decimal(9))], schema)
    crm = spark.createDataFrame([("crm", "J1", "C1", d, "USD", Decimal("100.00")), ("crm", "J2", "C9", d, "USD", Decimal(5)), ("crm", "J3", "C1", d, "EUR", Decimal(7)), ("crm", "J5", "C1", d, "USD", Decimal(10))], schema)
    crosswalk, bad = rs.resolve_invoices(erp, crm, parents)
    assert resolved(crosswalk) == sorted([("I1", "J1"), ("I2", None), ("I5", None), (None, "J2"), (None, "J5")], key=str)
    assert sorted(json.loads(r.original_data)["business_key"] for r in bad.collect()) == ["I3", "I4", "J3"]
    again = {r.canonical_id for r in rs.resolve_invoices(erp, crm, parents)[0].collect()}
    assert again == {r.canonical_id for r in crosswalk.collect()} and all(len(x) == 36 for x in again)
    schema = "source_system string, business_key string, invoice_business_key string, payment_date date, amount decimal(38,18)"
    paid = rs.resolve_payments(spark.createDataFrame([("erp", "P1", "I1", d, Decimal("101.50")), ("erp", "P2", "I2", d, Decimal(1))], schema), spark.createDataFrame([("crm", "Q1", "J1", d, Decimal(100)), ("crm", "Q2", "J2", d, Decimal(1))], schema), crosswalk)[0]
    assert resolved(paid) == sorted([("P1", "Q1"), ("P2", None), (None, "Q2")], key=str)


def test_upserts(spark):
    old = spark.createDataFrame([("invoice", "keep", "I1", None), ("invoice", "same", "I2", "J2")], CROSSWALK)
    new = spark.createDataFrame([("invoice", "n1", "I1", None), ("invoice", "n2", "I1", "J1"), ("invoice", "n3", None, "J9"), ("invoice", "n4", None, "J9")], CROSSWALK)
    out = upsert_crosswalk(new, old)
    assert sorted((r.canonical_id for r in out.collect())) == ["keep", "n2", "n3", "same"]
    assert upsert_crosswalk(new, out).exceptAll(out).count() == 0 and upsert_crosswalk(new, out).count() == 4
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    assert sorted(upsert_rows(b, a, ["k"]).collect()) == [(1, "x"), (2, None), (3, "z")]
    money = spark.createDataFrame([(Decimal("1.005"),), (Decimal("-2.675"),)], "amount decimal(38,18)")
    assert [r.amount for r in target_rows(money).collect()] == [Decimal("1.01"), Decimal("-2.68")]
    bad = spark.createDataFrame([("thing", "a", None, None), ("invoice", "a", "I", None)], CROSSWALK)
    none = spark.createDataFrame([], "reason_code string, source_system string")
    assert {r.rule: r.n for r in violations(bad, none).collect() if r.n} == {"crosswalk.entity_type": 1, "crosswalk.keys": 1, "crosswalk.canonical_id": 1}


def test_measures(spark):
    walk = spark.createDataFrame([("payment", "1", "P1", "Q1"), ("payment", "2", "P2", "Q2"), ("payment", "3", "P3", None), ("invoice", "4", "P1", "Q9")], CROSSWALK)
    side = lambda *v: spark.createDataFrame([(k, Decimal(x)) for k, x in v], "business_key string, amount decimal(38,18)")
    drift = measures.payment_drift(walk, side(("P1", "101.50"), ("P2", "100.001"), ("P3", "1")), side(("Q1", "100.00"), ("Q2", "100.00")))
    assert [(r.erp_key, r.drift) for r in drift.collect()] == [("P1", Decimal("1.50"))]
    rates = {r.entity_type: (r.matched, r.total, r.rate) for r in measures.match_rates(walk).collect()}
    assert rates == {"customer": (0, 0, None), "invoice": (1, 1, 1.0), "payment": (2, 3, 2 / 3)}
    truth = spark.createDataFrame([("payment", "P1", "Q1"), ("invoice", "P2", "Q2")], "entity_type string, erp_key string, crm_key string")
    s = measures.score(walk, truth).first()
    assert (s.hits, s.predicted, s.expected) == (1, 3, 2) and s.precision == pytest.approx(1 / 3) and s.recall == 0.5
    assert measures.score(walk.where("false"), truth).first().f1 == 0.0
    reasons = measures.reason_counts(spark.createDataFrame([("schema_invalid",)], "reason_code string"))
    assert sorted(r.n for r in reasons.collect()) == [0, 0, 0, 0, 1]


@pytest.fixture(scope="module")
def dataset(tmp_path_factory, spark):
    from tallyloom.plans.generate import Config, generate

    folder = str(tmp_path_factory.mktemp("generated"))
    generate(spark, Config(seed=3, num_customers=25, output_dir=folder, as_of="2025-06-01"))
    return folder


def test_generated_exports(dataset, spark):
    with open(f"{dataset}/crm/customers.json", encoding="utf-8") as f:
        text = f.read()
    documents = json.loads(text)
    assert "NaN" not in text and len({d["customerId"] for d in documents}) == len(documents)
    numbers = [i["invoiceNumber"] for d in documents for i in d["invoices"]]
    assert len(numbers) == len(set(numbers))
    with open(f"{dataset}/erp/invoices.csv", encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    with open(f"{dataset}/erp/customers.csv", encoding="utf-8", newline="") as f:
        known = {r["CUST_ID"] for r in csv.DictReader(f)}
    assert rows and {r["CUST_ID"] for r in rows} <= known
    with open(f"{dataset}/ground_truth.json") as f:
        truth = json.load(f)
    assert truth["summary"]["total_invoices"] == len(truth["invoices"]) and all(x["expected_match"] == (x["exists_in_erp"] and x["exists_in_crm"]) for x in truth["invoices"])


def test_a_whole_run_twice(dataset, spark, tmp_path):
    from tallyloom.plans import persist, report
    from tallyloom.plans.reconcile import reconcile
    from tallyloom.sources.exports import read_ground_truth

    result = reconcile(spark, dataset)
    clean_rows = sum(df.count() for df in result.clean.values())
    stages = {r.stage: r["count"] for r in result.quarantine.groupBy("stage").count().collect()}
    pairs = result.crosswalk.select(F.count("erp_key").alias("a"), F.count("crm_key").alias("b")).first()
    assert pairs.a + pairs.b + stages.get("resolution", 0) == clean_rows
    path = f"{tmp_path}/out/crosswalk.json"
    n = persist.save_crosswalk(result, path)
    before = json.load(open(path))
    assert persist.save_crosswalk(reconcile(spark, dataset), path) == n == len(before) and json.load(open(path)) == before
    persist.save_quarantine(result, f"{tmp_path}/q.json")
    assert len(json.load(open(f"{tmp_path}/q.json"))) == sum(stages.values())
    text = report.render(result, 1.0, measures.score(result.crosswalk, read_ground_truth(spark, f"{dataset}/ground_truth.json")).first())
    assert text.startswith("# Reconciliation Report\n\n## Executive summary\n") and "Precision: 100.0%" in text
    for _ in range(2):
        persist.load_targets(spark, result, f"{tmp_path}/targets")
    assert spark.read.parquet(f"{tmp_path}/targets/crosswalk").count() == n
    assert sum(v.n for v in violations(result.crosswalk, result.quarantine).collect()) == 0


def test_settings(tmp_path):
    from tallyloom.plans.generate import Config

    with open(f"{tmp_path}/c.yaml", "w") as f:
        f.write("seed: 9\nmessiness:\n  orphan_ratio: 0.5\n")
    c = Config.from_yaml(f"{tmp_path}/c.yaml")
    assert c.seed == 9 and c.messiness["orphan_ratio"] == 0.5 and c.messiness["bad_date_ratio"] == 0.08 and "seed: 9" in c.to_yaml()
    for wrong in ({"num_customers": 0}, {"payment_coverage_ratio": 2.0}, {"messiness": {"orphan_ratio": -1}}, {"min_invoices_per_customer": 9}):
        with pytest.raises(ValueError):
            Config(**wrong)


SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="the driver's tables are not here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from tallyloom.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SAMPLE):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SAMPLE}/{f}'")
    plain = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    for name in sorted(ORACLE_SQL):
        df, rel = QUERIES[name](spark, SAMPLE), con.sql(ORACLE_SQL[name])
        names = sorted(df.columns)
        assert names == sorted(rel.columns), name
        want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
        assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want, name
