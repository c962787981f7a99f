"""Seeded synthetic exports of one truth by two messy systems.

Every draw is a hash of (seed, purpose, row key), so rows come out alike in any
order and on any number of tasks. Each system has streams of its own.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..schemas import CUSTOMER
from .persist import write_json_array

RATIOS = ("missing_value_ratio", "bad_date_ratio", "encoding_issue_ratio", "duplicate_ratio", "orphan_ratio", "amount_drift_ratio")
# Fixed values of the data model: states and methods with their weights, missing markers, date placeholders, look-alikes.
STATUSES = {"paid": 0.55, "partial": 0.15, "unpaid": 0.10, "overdue": 0.15, "void": 0.05}
METHODS = {"credit_card": 0.45, "bank_transfer": 0.35, "check": 0.10, "cash": 0.10}
PAID = ("paid", "partial", "overdue")
MARKERS = (None, "", "N/A", "NULL", "--", "unknown")
PLACEHOLDERS = ("0000-00-00", "N/A", "", "TBD")
PLAIN, ACCENTED = "aeiouncAEIOUNC", "áéíóúñçÁÉÍÓÚÑÇ"
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "SEK")
FIRST = ("Alice", "Bruno", "Carmen", "Diego", "Elena", "Felix", "Greta", "Hugo", "Irene", "Jonas", "Karin", "Lucia", "Marco", "Nadia", "Oscar", "Paula")
LAST = ("Anderson", "Becker", "Castillo", "Dubois", "Eriksen", "Fischer", "Garnier", "Hansen", "Ibarra", "Jensen", "Keller", "Lindqvist", "Moreau", "Novak", "Olsen", "Pereira")
PLACES = ("Ashford", "Brookside", "Clearwater", "Dunmore", "Eastvale", "Fairmont", "Glenwood", "Harborview")


@dataclass(frozen=True)
class Config:
    seed: int = 42
    num_customers: int = 500
    min_invoices_per_customer: int = 1
    max_invoices_per_customer: int = 5
    payment_coverage_ratio: float = 0.85
    output_dir: str = "data/raw"
    with_ground_truth: bool = True
    messiness: dict = field(default_factory=lambda: dict(zip(RATIOS, (0.05, 0.08, 0.03, 0.02, 0.05, 0.04))))
    as_of: str | None = None

    def __post_init__(self):
        ratios = dict(zip(RATIOS, (0.05, 0.08, 0.03, 0.02, 0.05, 0.04))) | dict(self.messiness)
        if set(ratios) != set(RATIOS) or not all(0 <= v <= 1 for v in [*ratios.values(), self.payment_coverage_ratio]):
            raise ValueError("ratios must lie between 0 and 1, and have known names")
        if self.num_customers <= 0 or not 0 <= self.min_invoices_per_customer <= self.max_invoices_per_customer:
            raise ValueError("there must be a customer, and at least as many invoices at most as at least")
        object.__setattr__(self, "messiness", ratios)

    @classmethod
    def from_yaml(cls, path: str) -> "Config":
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        unknown = set(given) - {x.name for x in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump({k: v for k, v in asdict(self).items() if v is not None}, sort_keys=False)


class Draw:
    """Uniform numbers of one stream."""

    def __init__(self, seed: int, stream: str):
        self.seed, self.stream = seed, stream

    def u(self, purpose: str, *key: Column | str) -> Column:
        bits = F.xxhash64(F.lit(self.seed), F.lit(f"{self.stream}/{purpose}"), *key).bitwiseAND((1 << 53) - 1)
        return bits / float(1 << 53)

    def below(self, purpose: str, n: int, *key) -> Column:
        return F.floor(self.u(purpose, *key) * n).cast("int")

    def one_of(self, purpose: str, values, *key) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.below(purpose, len(values), *key) + 1)

    def weighted(self, purpose: str, weights: dict[str, float], *key) -> Column:
        u, edge, out = self.u(purpose, *key), 0.0, None
        for value, weight in weights.items():
            edge += weight
            out = F.when(u < edge, value) if out is None else out.when(u < edge, value)
        return out.otherwise(list(weights)[-1])

    def uuid(self, purpose: str, *key) -> Column:
        h = F.md5(F.concat_ws("/", F.lit(str(self.seed)), F.lit(f"{self.stream}/{purpose}"), *[F.col(k) if isinstance(k, str) else k for k in key]))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _orphaned(d: Draw, ratio: float, able: Column, *key):
    hit = able & (d.u("orphan", *key) < ratio)
    left = d.u("side", *key) < 0.5
    return hit & left, hit & ~left


def truth(spark: SparkSession, c: Config, draw: type[Draw] = Draw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, invoices and payments before any mess."""
    today = F.lit(c.as_of or date.today().isoformat()).cast("date")
    d = draw(c.seed, "customer")
    n = F.col("customer_no")
    customers = spark.range(1, c.num_customers + 1).select(F.col("id").cast("int").alias("customer_no"))
    customers = customers.withColumns({"first": d.one_of("first", FIRST, n), "last": d.one_of("last", LAST, n)})
    mail = F.lower(F.concat_ws(".", "first", "last"))
    nth = F.row_number().over(Window.partitionBy("first", "last").orderBy("customer_no"))
    customers = customers.select(
        "customer_no", F.concat_ws(" ", "first", "last").alias("name"), F.concat(mail, F.when(nth > 1, nth.cast("string")).otherwise(F.lit("")), F.lit("@example.com")).alias("email"),
        F.format_string("%03d-%03d-%04d", 200 + d.below("area", 800, n), d.below("office", 1000, n), d.below("line", 10000, n)).alias("phone"),
        F.concat_ws(" ", (1 + d.below("house", 999, n)).cast("string"), d.one_of("street", LAST, n), F.lit("Street")).alias("street"), d.one_of("city", PLACES, n).alias("city"),
        d.one_of("region", PLACES, n).alias("region"), F.format_string("%05d", d.below("postal", 100000, n)).alias("postal"), d.one_of("country", ("United States", "France", "Germany", "Spain"), n).alias("country"),
        F.date_sub(today, 30 + d.below("created", 1065, n)).alias("created"))
    d = draw(c.seed, "invoice")
    count = c.min_invoices_per_customer + d.below("count", c.max_invoices_per_customer - c.min_invoices_per_customer + 1, "customer_no")
    rows = customers.select("customer_no", count.alias("n")).where("n > 0").select("customer_no", F.explode(F.sequence(F.lit(1), "n")).alias("nth"))
    k = ("customer_no", "nth")
    # Each customer has room for the most invoices, so numbers need no pass over all customers.
    rows = rows.withColumn("invoice_no", ((F.col("customer_no") - 1) * c.max_invoices_per_customer + F.col("nth")).cast("int"))
    erp_gone, crm_gone = _orphaned(d, c.messiness["orphan_ratio"], F.lit(True), *k)
    invoices = rows.select(
        "customer_no", "invoice_no", F.date_sub(today, 1 + d.below("issued", 729, *k)).alias("issued"), d.one_of("term", (15, 30, 45, 60), *k).alias("term"),
        d.one_of("currency", CURRENCIES, *k).alias("currency"), (50 + d.u("amount", *k) * 4950).cast("decimal(14,2)").alias("amount"), d.weighted("status", STATUSES, *k).alias("status"),
        (~erp_gone).alias("in_erp"), (~crm_gone).alias("in_crm")).withColumn("due", F.date_add("issued", F.col("term")))
    d = draw(c.seed, "payment")
    k = ("invoice_no",)
    rows = invoices.where(F.col("status").isin(*PAID) & (d.u("covered", *k) <= c.payment_coverage_ratio))
    erp_gone, crm_gone = _orphaned(d, c.messiness["orphan_ratio"], F.col("in_erp") & F.col("in_crm"), *k)
    portion = F.when(F.col("status") == "partial", (0.3 + d.u("portion", *k) * 0.6).cast("decimal(4,2)")).otherwise(F.lit(1).cast("decimal(4,2)"))
    size = (0.01 + d.u("drift size", *k) * 4.99).cast("decimal(14,2)")
    drift = F.when(d.u("drift", *k) < c.messiness["amount_drift_ratio"], F.when(d.u("drift side", *k) < 0.5, size).otherwise(-size)).otherwise(F.lit(0)).cast("decimal(14,2)")
    payments = rows.select(
        "customer_no", "invoice_no", F.col("invoice_no").alias("payment_no"), F.date_add("issued", d.below("paid", 45, *k)).alias("paid"), (F.col("amount") * portion).cast("decimal(14,2)").alias("amount"),
        drift.alias("drift"), d.weighted("method", METHODS, *k).alias("method"), (F.col("in_erp") & ~erp_gone).alias("in_erp"), (F.col("in_crm") & ~crm_gone).alias("in_crm"))
    return customers, invoices, payments


# -- mess ------------------------------------------------------------------------


def corrupt_text(c: Column, d: Draw, purpose: str, *key) -> Column:
    """Look-alike accents on some letters, read in the wrong encoding."""
    letters = F.split(c, "")
    chosen = F.transform(letters, lambda x, i: F.when(d.u(purpose + " letter", *key, i) < 0.25, F.translate(x, PLAIN, ACCENTED)).otherwise(x))
    text = F.array_join(chosen, "")
    # At least one letter changes, where one can.
    text = F.when(text == c, F.regexp_replace(c, f"^([^{PLAIN}]*)([{PLAIN}])", F.concat(F.lit("$1"), F.translate(F.regexp_extract(c, f"([{PLAIN}])", 1), PLAIN, ACCENTED)))).otherwise(text)
    specials = "".join(bytes([b]).decode("cp1252", errors="replace") for b in range(0x80, 0xA0))
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), specials)


def corrupt_date(c: Column, d: Draw, purpose: str, *key) -> Column:
    day = c.cast("date")
    forms = [F.date_format(day, f) for f in ("MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "yyyy/MM/dd")] + [F.unix_timestamp(day.cast("timestamp")).cast("string")]
    return F.element_at(F.array(*forms, *[F.lit(x) for x in PLACEHOLDERS]), d.below(purpose, len(forms) + len(PLACEHOLDERS), *key) + 1)


def messy(df: DataFrame, d: Draw, c: Config, key: str, kept: tuple[str, ...], dates: list[str], texts: list[str] = []) -> DataFrame:
    """Encoding, missing cells, dates, then near-duplicate rows in a shuffled order; key columns stay whole."""
    r = c.messiness
    out = df
    for name in texts:
        out = out.withColumn(name, F.when(d.u(f"encoding {name}", key) < r["encoding_issue_ratio"], corrupt_text(F.col(name), d, name, F.col(key))).otherwise(F.col(name)))
    for name in [x for x in df.columns if x not in kept]:
        hit = d.u(f"missing {name}", key) < r["missing_value_ratio"]
        out = out.withColumn(name, F.when(hit, d.one_of(f"marker {name}", MARKERS, key)).otherwise(F.col(name).cast("string")))
    for name in dates:
        is_date = F.col(name).rlike(r"^\d{4}-\d\d-\d\d$")
        out = out.withColumn(name, F.when(is_date & (d.u(f"date {name}", key) < r["bad_date_ratio"]), corrupt_date(F.when(is_date, F.col(name)), d, f"form {name}", F.col(key))).otherwise(F.col(name)))
    if r["duplicate_ratio"]:
        # So many rows as the ratio says, each once: those of the least draws.
        n = round(out.count() * r["duplicate_ratio"])
        least = out.select(F.col(key).alias("__key"), d.u("duplicate", key).alias("__u")).orderBy("__u", "__key").limit(n).select("__key")
        again = out.join(least, F.col(key) == F.col("__key"), "left_semi")
        names = [x for x in df.columns if x not in kept]
        which = d.below("perturbed", 2 * len(names), key)
        for i, name in enumerate(names):
            pad = d.u("pad", key) < 0.5
            again = again.withColumn(name, F.when((which == i) & (F.col(name) != ""), F.when(pad, F.concat(F.lit(" "), name, F.lit(" "))).otherwise(F.upper(name))).otherwise(F.col(name)))
        out = out.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))
        out = out.orderBy(F.xxhash64(F.lit(d.seed), F.lit(d.stream), key, "copy")).drop("copy")
    return out


def suffixed(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Keys of the second and later rows of a key with ``-DUP<n>`` behind, in row order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__nth", nth).withColumn(key, F.when(F.col("__nth") > 1, F.concat(F.col(key), F.lit("-DUP"), F.col("__nth").cast("string"))).otherwise(F.col(key))).drop("__nth")


def erp_frames(tables, c: Config, draw: type[Draw] = Draw) -> dict[str, DataFrame]:
    customers, invoices, payments = tables
    key = lambda form, col: F.format_string(form, F.col(col).cast("int"))
    cust = customers.select(key("C%06d", "customer_no").alias("CUST_ID"), F.col("name").alias("CUST_NAME"), F.col("email").alias("EMAIL_ADDR"), F.col("phone").alias("PHONE_NUM"), F.col("street").alias("ADDR_LINE1"), F.col("city").alias("CITY"), F.col("region").alias("REGION"), F.col("postal").alias("POSTAL_CD"), F.col("country").alias("COUNTRY"), F.col("created").cast("string").alias("CREATED_DT"))
    inv = invoices.where("in_erp").select(key("INV-%06d", "invoice_no").alias("INV_NO"), key("C%06d", "customer_no").alias("CUST_ID"), F.col("issued").cast("string").alias("ISSUE_DT"), F.col("due").cast("string").alias("DUE_DT"), F.col("currency").alias("CURR_CD"), F.col("amount").cast("string").alias("AMT"), F.upper("status").alias("STATUS_CD"))
    pay = payments.where("in_erp").select(key("PMT-%06d", "payment_no").alias("PMT_NO"), key("INV-%06d", "invoice_no").alias("INV_NO"), key("C%06d", "customer_no").alias("CUST_ID"), F.col("paid").cast("string").alias("PMT_DT"), (F.col("amount") + F.col("drift")).cast("string").alias("AMT"), F.upper("method").alias("PMT_METHOD_CD"))
    return {
        "customers": messy(cust, draw(c.seed, "erp customers"), c, "CUST_ID", ("CUST_ID",), ["CREATED_DT"], ["CUST_NAME", "ADDR_LINE1", "CITY"]),
        "invoices": messy(inv, draw(c.seed, "erp invoices"), c, "INV_NO", ("INV_NO", "CUST_ID", "AMT", "CURR_CD"), ["ISSUE_DT", "DUE_DT"]),
        "payments": messy(pay, draw(c.seed, "erp payments"), c, "PMT_NO", ("PMT_NO", "INV_NO", "CUST_ID", "AMT"), ["PMT_DT"]),
    }


def crm_documents(tables, c: Config, draw: type[Draw] = Draw) -> DataFrame:
    """Nested customer documents; invoices and payments without a parent in the export are left out."""
    customers, invoices, payments = tables
    key = lambda form, col: F.format_string(form, F.col(col).cast("int"))
    cust = customers.select(key("CUST-%06d", "customer_no").alias("customerId"), F.col("name").alias("customerName"), "email", "phone", F.col("created").cast("string").alias("createdAt"), "street", "city", "region", F.col("postal").alias("postalCode"), "country")
    inv = invoices.where("in_crm").select(key("INV%06d", "invoice_no").alias("invoiceNumber"), key("CUST-%06d", "customer_no").alias("customerId"), F.col("issued").cast("string").alias("issueDate"), F.col("due").cast("string").alias("dueDate"), "currency", F.col("amount").cast("string").alias("amount"), "status")
    pay = payments.where("in_crm").select(key("PAY%06d", "payment_no").alias("paymentNumber"), key("INV%06d", "invoice_no").alias("invoiceNumber"), F.col("paid").cast("string").alias("paymentDate"), F.col("amount").cast("string").alias("amount"), "method")
    cust = messy(cust, draw(c.seed, "crm customers"), c, "customerId", ("customerId",), ["createdAt"], ["customerName", "street", "city"])
    inv = messy(inv, draw(c.seed, "crm invoices"), c, "invoiceNumber", ("invoiceNumber", "customerId", "amount", "currency"), ["issueDate", "dueDate"])
    pay = messy(pay, draw(c.seed, "crm payments"), c, "paymentNumber", ("paymentNumber", "invoiceNumber", "amount"), ["paymentDate"])
    # Copies get keys of their own; children hang on the first row of their parent's key.
    order = F.xxhash64(F.lit(c.seed), F.to_json(F.struct("*")))
    cust, inv = suffixed(cust, "customerId", order), suffixed(inv, "invoiceNumber", order)
    below = pay.groupBy("invoiceNumber").agg(F.sort_array(F.collect_list(F.struct("paymentNumber", "paymentDate", F.col("amount").cast("double").alias("amount"), "method"))).alias("payments"))
    inv = inv.join(below, "invoiceNumber", "left")
    item = F.struct("invoiceNumber", "issueDate", "dueDate", "currency", F.col("amount").cast("double").alias("amount"), "status", F.coalesce("payments", F.array().cast(below.schema["payments"].dataType)).alias("payments"))
    lists = inv.groupBy("customerId").agg(F.sort_array(F.collect_list(item)).alias("invoices"))
    out = cust.join(lists, "customerId", "left")
    address = F.struct(*CUSTOMER["address"].dataType.names).alias("address")
    return out.select("customerId", "customerName", "email", "phone", "createdAt", address, F.coalesce("invoices", F.array().cast(lists.schema["invoices"].dataType)).alias("invoices"))


def ground_truth(tables) -> tuple[DataFrame, DataFrame]:
    _, invoices, payments = tables
    both = F.col("in_erp") & F.col("in_crm")
    make = lambda df, no, erp, crm, name: df.select(
        Draw(0, name).uuid("id", F.col(no).cast("string")).alias(f"{name}_id"), F.format_string(erp, F.col(no)).alias("erp_key"), F.format_string(crm, F.col(no)).alias("crm_key"),
        F.col("in_erp").alias("exists_in_erp"), F.col("in_crm").alias("exists_in_crm"), both.alias("expected_match"), *([F.col("drift").cast("double").alias("amount_drift"), (F.col("drift") != 0).alias("has_amount_mismatch")] if name == "payment" else []))
    return make(invoices, "invoice_no", "INV-%06d", "INV%06d", "invoice"), make(payments, "payment_no", "PMT-%06d", "PAY%06d", "payment")


def truth_summary(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """One row: how many there are, how many have no counterpart, how many amounts differ."""
    first = invoices.agg(F.count("*").alias("total_invoices"), F.count_if(~F.col("expected_match")).alias("invoice_orphans"))
    second = payments.agg(F.count("*").alias("total_payments"), F.count_if(~F.col("expected_match")).alias("payment_orphans"), F.count_if("has_amount_mismatch").alias("payment_amount_mismatches"))
    return first.crossJoin(second)  # a row with a row


def _write_csv(df: DataFrame, path: str) -> None:
    import csv

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def generate(spark: SparkSession, c: Config) -> None:
    """Writes erp/*.csv, crm/customers.json, the settings and, if asked for, ground_truth.json below ``output_dir``."""
    tables = truth(spark, c)
    for name, df in erp_frames(tables, c).items():
        _write_csv(df, f"{c.output_dir}/erp/{name}.csv")
    write_json_array(crm_documents(tables, c), f"{c.output_dir}/crm/customers.json")
    with open(f"{c.output_dir}/generation_config.yaml", "w", encoding="utf-8") as f:
        f.write(c.to_yaml())
    if c.with_ground_truth:
        frames = ground_truth(tables)
        invoices, payments = ([r.asDict() for r in df.toLocalIterator()] for df in frames)
        summary = truth_summary(*frames).first().asDict()
        with open(f"{c.output_dir}/ground_truth.json", "w", encoding="utf-8") as f:
            json.dump({"invoices": invoices, "payments": payments, "summary": summary}, f, indent=2)
