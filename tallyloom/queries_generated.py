"""Queries of the data generator, its draws replaced by arithmetic on keys that SQL can follow.

The generator's own functions run: only the source of its uniform numbers is another.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, functions as F

from .functions import clean
from .plans import generate as g
from .queries import query, table

PRIMES = (7919, 104729, 15485863)
SEED, MODULUS = 7, 997
DAY = "2024-06-30"


class KeyDraw(g.Draw):
    """Uniform numbers by remainders of the digits in the keys."""

    def u(self, purpose: str, *key: Column | str) -> Column:
        total = F.lit(zlib.crc32(f"{self.stream}/{purpose}".encode()) % MODULUS).cast("long")
        for k, prime in zip(key, PRIMES):
            digits = F.regexp_replace((F.col(k) if isinstance(k, str) else k).cast("string"), "[^0-9]", "")
            total = total + digits.cast("long") * prime
        return (total % MODULUS + 0.37) / float(MODULUS)


def u(stream: str, purpose: str, *key: str) -> str:
    """The same number in SQL."""
    total = str(zlib.crc32(f"{stream}/{purpose}".encode()) % MODULUS)
    for k, prime in zip(key, PRIMES):
        total += f" + regexp_replace(({k})::varchar, '[^0-9]', '', 'g')::bigint * {prime}"
    return f"((({total}) % {MODULUS} + 0.37e0) / {MODULUS}e0)"


def below(stream: str, purpose: str, n: int, *key: str) -> str:
    return f"floor({u(stream, purpose, *key)} * {n})::int"


def one_of(stream: str, purpose: str, values, *key: str) -> str:
    names = ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{names}])[{below(stream, purpose, len(values), *key)} + 1]"


def weighted(stream: str, purpose: str, weights: dict, *key: str) -> str:
    edge, cases = 0.0, ""
    for value, weight in weights.items():
        edge += weight
        cases += f" when {u(stream, purpose, *key)} < {edge!r}e0 then '{value}'"
    return f"case{cases} else '{list(weights)[-1]}' end"


def _config(spark, sf_dir, **messiness) -> g.Config:
    ratios = {**dict.fromkeys(g.RATIOS, 0.0), "orphan_ratio": 0.05, "amount_drift_ratio": 0.04, **messiness}
    return g.Config(seed=SEED, num_customers=table(spark, sf_dir, "customer").count(), as_of=DAY, messiness=ratios)


def _orphan(stream: str, able: str, *key: str) -> tuple[str, str]:
    hit = f"({able}) and {u(stream, 'orphan', *key)} < 0.05"
    left = f"{u(stream, 'side', *key)} < 0.5"
    return f"not ({hit} and {left})", f"not ({hit} and not {left})"


NO = "customer_no"
_IE, _IC = _orphan("invoice", "true", "customer_no", "nth")
_PE, _PC = _orphan("payment", "in_erp and in_crm", "invoice_no")
TRUTH_SQL = f"""
n as (select unnest(generate_series(1, (select count(*) from customer)))::int as customer_no),
named as (select customer_no, {one_of('customer', 'first', g.FIRST, NO)} as f, {one_of('customer', 'last', g.LAST, NO)} as l from n),
people as (select *, row_number() over (partition by f, l order by customer_no) as nth from named),
customers as (select customer_no, f || ' ' || l as name, lower(f || '.' || l) || case when nth > 1 then nth::varchar else '' end || '@example.com' as email,
  printf('%03d-%03d-%04d', 200 + {below('customer', 'area', 800, NO)}, {below('customer', 'office', 1000, NO)}, {below('customer', 'line', 10000, NO)}) as phone,
  (1 + {below('customer', 'house', 999, NO)}) || ' ' || {one_of('customer', 'street', g.LAST, NO)} || ' Street' as street, {one_of('customer', 'city', g.PLACES, NO)} as city, {one_of('customer', 'region', g.PLACES, NO)} as region,
  printf('%05d', {below('customer', 'postal', 100000, NO)}) as postal, {one_of('customer', 'country', ("United States", "France", "Germany", "Spain"), NO)} as country, date '{DAY}' - (30 + {below('customer', 'created', 1065, NO)}) as created from people),
counts as (select customer_no, 1 + {below('invoice', 'count', 5, NO)} as k from n),
rows as (select customer_no, unnest(generate_series(1, k))::int as nth from counts),
invoice0 as (select customer_no, (customer_no - 1) * 5 + nth as invoice_no, date '{DAY}' - (1 + {below('invoice', 'issued', 729, 'customer_no', 'nth')}) as issued, {one_of('invoice', 'term', (15, 30, 45, 60), 'customer_no', 'nth')} as term,
  {one_of('invoice', 'currency', g.CURRENCIES, 'customer_no', 'nth')} as currency, (50 + {u('invoice', 'amount', 'customer_no', 'nth')} * 4950)::decimal(14,2) as amount, {weighted('invoice', 'status', g.STATUSES, 'customer_no', 'nth')} as status, {_IE} as in_erp, {_IC} as in_crm from rows),
invoices as (select *, issued + term as due from invoice0),
payments as (select customer_no, invoice_no, invoice_no as payment_no, issued + {below('payment', 'paid', 45, 'invoice_no')} as paid,
  (amount * case when status = 'partial' then (0.3e0 + {u('payment', 'portion', 'invoice_no')} * 0.6e0)::decimal(4,2) else 1::decimal(4,2) end)::decimal(14,2) as amount,
  case when {u('payment', 'drift', 'invoice_no')} < 0.04 then case when {u('payment', 'drift side', 'invoice_no')} < 0.5 then 1 else -1 end * (0.01e0 + {u('payment', 'drift size', 'invoice_no')} * 4.99e0)::decimal(14,2) else 0 end::decimal(14,2) as drift,
  {weighted('payment', 'method', g.METHODS, 'invoice_no')} as method, in_erp and {_PE} as in_erp, in_crm and {_PC} as in_crm
  from invoices where status in ('paid', 'partial', 'overdue') and {u('payment', 'covered', 'invoice_no')} <= 0.85e0)"""


def _truth(spark, sf_dir, **messiness):
    c = _config(spark, sf_dir, **messiness)
    return g.truth(spark, c, KeyDraw), c


@query(f"with {TRUTH_SQL} select * from customers")
def q_generate_customers(spark, sf_dir):
    """Names, unique addresses, days of creation."""
    return _truth(spark, sf_dir)[0][0]


@query(f"with {TRUTH_SQL} select customer_no, invoice_no, issued, term, currency, amount, status, in_erp, in_crm, due from invoices")
def q_generate_invoices(spark, sf_dir):
    """Terms, amounts, weighted states, and the systems that have an invoice."""
    return _truth(spark, sf_dir)[0][1]


@query(f"with {TRUTH_SQL} select * from payments")
def q_generate_payments(spark, sf_dir):
    """Portions, drift, methods, and the systems that have a payment."""
    return _truth(spark, sf_dir)[0][2]


@query(f"""with {TRUTH_SQL} select printf('PMT-%06d', payment_no) as "PMT_NO", printf('INV-%06d', invoice_no) as "INV_NO", printf('C%06d', customer_no) as "CUST_ID", paid::varchar as "PMT_DT", (amount + drift)::decimal(14,2)::varchar as "AMT", upper(method) as "PMT_METHOD_CD" from payments where in_erp""")
def q_export_payments(spark, sf_dir):
    """The flat export of payments: keys, filter, drift of one system alone."""
    tables, c = _truth(spark, sf_dir)
    return g.erp_frames(tables, c, KeyDraw)["payments"]


def _missing(stream: str, name: str, key: str, ratio: str) -> str:
    return f"case when {u(stream, 'missing ' + name, key)} < {ratio} then {one_of(stream, 'marker ' + name, g.MARKERS, key)} else \"{name}\" end"


def _bad_date(stream: str, name: str, key: str, ratio: str) -> str:
    day = f'"{name}"::date'
    forms = [f"strftime({day}, '{f}')" for f in ("%m/%d/%Y", "%d-%m-%Y", "%d %b %Y", "%Y/%m/%d")] + [f"epoch({day})::bigint::varchar"] + [f"'{x}'" for x in g.PLACEHOLDERS]
    cases = " ".join(f"when {i} then {f}" for i, f in enumerate(forms))
    return f"""case when regexp_full_match("{name}", '\\d{{4}}-\\d\\d-\\d\\d') and {u(stream, 'date ' + name, key)} < {ratio} then case {below(stream, 'form ' + name, len(forms), key)} {cases} end else "{name}" end"""


_S, _K = "erp invoices", '"INV_NO"'
_NAMES = ("ISSUE_DT", "DUE_DT", "STATUS_CD")


def _perturbed(i: int, name: str) -> str:
    pad = f"{u(_S, 'pad', _K)} < 0.5"
    return f"case when {below(_S, 'perturbed', 2 * len(_NAMES), _K)} = {i} and \"{name}\" <> '' then case when {pad} then ' ' || \"{name}\" || ' ' else upper(\"{name}\") end else \"{name}\" end as \"{name}\""


@query(f"""with {TRUTH_SQL},
plain as (select printf('INV-%06d', invoice_no) as "INV_NO", printf('C%06d', customer_no) as "CUST_ID", issued::varchar as "ISSUE_DT", due::varchar as "DUE_DT", currency as "CURR_CD", amount::varchar as "AMT", upper(status) as "STATUS_CD" from invoices where in_erp),
gaps as (select "INV_NO", "CUST_ID", {_missing(_S, 'ISSUE_DT', _K, '0.05')} as "ISSUE_DT", {_missing(_S, 'DUE_DT', _K, '0.05')} as "DUE_DT", "CURR_CD", "AMT", {_missing(_S, 'STATUS_CD', _K, '0.05')} as "STATUS_CD" from plain),
dated as (select "INV_NO", "CUST_ID", {_bad_date(_S, 'ISSUE_DT', _K, '0.08')} as "ISSUE_DT", {_bad_date(_S, 'DUE_DT', _K, '0.08')} as "DUE_DT", "CURR_CD", "AMT", "STATUS_CD" from gaps),
least as (select *, row_number() over (order by {u(_S, 'duplicate', _K)}, "INV_NO") as r from dated),
again as (select "INV_NO", "CUST_ID", {_perturbed(0, 'ISSUE_DT')}, {_perturbed(1, 'DUE_DT')}, "CURR_CD", "AMT", {_perturbed(2, 'STATUS_CD')} from least where r <= round_even((select count(*) from dated) * 0.02, 0))
select * from dated union all select * from again""")
def q_export_messy_invoices(spark, sf_dir):
    """The flat export of invoices with missing cells, corrupted dates and perturbed copies."""
    tables, c = _truth(spark, sf_dir, missing_value_ratio=0.05, bad_date_ratio=0.08, duplicate_ratio=0.02)
    return g.erp_frames(tables, c, KeyDraw)["invoices"]


@query(f"""with {TRUTH_SQL},
pay as (select invoice_no, count(*) as n, sum(amount) as paid from payments where in_crm group by all),
inv as (select customer_no, count(*) as invoices, min(printf('INV%06d', i.invoice_no)) as first, sum(coalesce(n, 0))::bigint as payments, sum(amount)::decimal(14,2) as amount from invoices i left join pay using (invoice_no) where in_crm group by all)
select printf('CUST-%06d', customer_no) as "customerId", name as "customerName", city, coalesce(invoices, 0) as invoices, coalesce(payments, 0) as payments, first, amount from customers left join inv using (customer_no)""")
def q_nest_children(spark, sf_dir):
    """The nested export: payments under invoices under customers, empty lists for none."""
    tables, c = _truth(spark, sf_dir)
    docs = g.crm_documents(tables, c, KeyDraw)
    money = F.aggregate("invoices", F.lit(0).cast("decimal(14,2)"), lambda s, x: (s + x.amount.cast("decimal(14,2)")).cast("decimal(14,2)"))
    paid = F.aggregate("invoices", F.lit(0).cast("long"), lambda s, x: s + F.size(x.payments).cast("long"))
    n = F.size("invoices").cast("long")
    return docs.select("customerId", "customerName", F.col("address.city").alias("city"), n.alias("invoices"), paid.alias("payments"), F.try_element_at(F.col("invoices.invoiceNumber"), F.lit(1)).alias("first"), F.when(n > 0, money).alias("amount"))


@query(f"""with {TRUTH_SQL}, h as (select *, md5('0/invoice/id/' || invoice_no) as h from invoices)
select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) as invoice_id, printf('INV-%06d', invoice_no) as erp_key, printf('INV%06d', invoice_no) as crm_key,
  in_erp as exists_in_erp, in_crm as exists_in_crm, in_erp and in_crm as expected_match from h""")
def q_ground_truth(spark, sf_dir):
    """Which invoices should match, with seeded ids."""
    return g.ground_truth(_truth(spark, sf_dir)[0])[0]


@query(f"""with {TRUTH_SQL}, i as (select count(*) as total_invoices, count(*) filter (not (in_erp and in_crm)) as invoice_orphans from invoices),
p as (select count(*) as total_payments, count(*) filter (not (in_erp and in_crm)) as payment_orphans, count(*) filter (drift <> 0) as payment_amount_mismatches from payments)
select * from i, p""")
def q_truth_summary(spark, sf_dir):
    return g.truth_summary(*g.ground_truth(_truth(spark, sf_dir)[0]))


@query("select c_custkey, c_name as repaired, true as changed from customer")
def q_corrupt_text(spark, sf_dir):
    """Look-alike accents in the wrong encoding: repaired and without accents, the names are as they were."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", g.corrupt_text(F.col("c_name"), KeyDraw(SEED, "names"), "name", F.col("c_custkey")).alias("raw"))
    return rows.select("c_custkey", F.translate(clean.repair_mojibake(F.col("raw")), g.ACCENTED, g.PLAIN).alias("repaired"), (F.col("raw") != F.col("c_name")).alias("changed"))
