"""Queries of scans, routing, resolution, constraints, targets and the report over exports made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.resolve import ambiguous_candidates, mutual_top, resolve_customers, resolve_payments
from .operators.upsert import violations
from .operators.validate import validate
from .plans import measures, persist, report
from .plans.reconcile import Result
from .queries import INVOICE_SQL, LINES, PAYMENT_SQL, _customers, _invoices, _lines, _payments, _raw_invoices, _resolved, nested, query, table
from .schemas import ENTITIES, ERP_COLUMNS, REASONS, SYSTEMS
from .sources.exports import RawTables, ingest, read_crosswalk
from .sources.workspace import Workspace, brief_shuffles


def _exported(spark, sf_dir, lines: bool) -> RawTables:
    """The tables written as the two systems' exports, and ingested."""
    folder = Workspace(spark, "exports").path
    money = lambda c: F.col(c).cast("decimal(14,2)").cast("string")
    text = lambda *names: [F.col(c).cast("string") for c in names]
    none = F.lit("").alias
    customer = table(spark, sf_dir, "customer").select(*text("c_custkey"), F.concat(F.lit(' say "'), "c_name", F.lit('", or so ')).alias("n"), none("e"), none("p"), none("a"), "c_mktsegment", none("r"), none("z"), none("c"), none("d"))
    orders = table(spark, sf_dir, "orders").select(*text("o_orderkey", "o_custkey"), F.col("o_orderdate").cast("date").cast("string").alias("d"), none("u"), F.lit("USD").alias("c"), money("o_totalprice").alias("a"), "o_orderstatus")
    pay = _payments(spark, sf_dir, "erp").select("business_key", "invoice_business_key", none("c"), F.col("payment_date").cast("string").alias("d"), F.col("amount").cast("decimal(14,2)").cast("string").alias("a"), none("m"))
    for entity, df in zip(ENTITIES, (customer, orders, pay)):
        writer = df.toDF(*ERP_COLUMNS[entity]).write.option("header", True).option("quote", '"').option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/erp/{persist.FOLDERS[entity]}.csv")
    nested(spark, sf_dir).write.json(f"{folder}/crm/customers.json")
    return ingest(spark, folder, lines)


@query(f"""
select * from (select 'erp' as system, 'customer' as entity, count(*) as n from customer union all select 'erp', 'invoice', count(*) from orders
union all select 'erp', 'payment', count(*) from ({LINES}) where o % 4 <> 0 union all select 'crm', 'customer', count(*) from customer
union all select 'crm', 'invoice', count(*) from orders join customer on c_custkey = o_custkey
union all select 'crm', 'payment', count(*) from ({LINES}) join orders on o = o_orderkey join customer on c_custkey = o_custkey)""")
def q_ingest_counts(spark, sf_dir):
    """Rows of the six tables as ingested."""
    counts = _exported(spark, sf_dir, True).counts()
    return spark.createDataFrame([(s, e, n) for (s, e), n in counts.items()], "system string, entity string, n long")


@query("""
select c_custkey::varchar as key, ' say "' || c_name || '", or so ' as name, c_mktsegment as city, null as amount from customer
union all select o_orderkey::varchar, o_custkey::varchar, null, o_totalprice::decimal(14,2)::varchar from orders""")
def q_scan_csv(spark, sf_dir):
    """Flat exports read back: quotes, commas, padding and empty cells."""
    raw = _exported(spark, sf_dir, False)
    one = raw["erp", "customer"].select(F.col("CUST_ID").alias("key"), F.col("CUST_NAME").alias("name"), F.col("CITY").alias("city"), F.col("EMAIL_ADDR").alias("amount"))
    return one.unionAll(raw["erp", "invoice"].select("INV_NO", "CUST_ID", "DUE_DT", "AMT"))


@query(f"""
select o || '/' || d as payment, o::varchar as invoice, (cents / 100)::decimal(14,2)::varchar as amount from ({LINES}) join orders on o = o_orderkey join customer on c_custkey = o_custkey""")
def q_scan_json(spark, sf_dir):
    """Nested exports read back, every value a string."""
    return _exported(spark, sf_dir, True)["crm", "payment"].select(F.col("paymentNumber").alias("payment"), F.col("invoiceNumber").alias("invoice"), "amount")


# -- routing ---------------------------------------------------------------------


RAW_SQL = """
raw as (select o_orderkey as k, 'INV-' || o_orderkey as no, case when o_orderkey % 11 = 0 then 'N/A' else 'C' || o_custkey end as cust,
  case when o_orderkey % 13 = 0 then 'TBD' when o_orderkey % 17 = 0 then '' else o_orderdate::date::varchar end as issue, case when o_orderkey % 19 = 0 then '0000-00-00' else '--' end as due,
  case when o_orderkey % 23 = 0 then 'much' else o_totalprice::decimal(14,2)::varchar end as amt, o_orderstatus as status from orders),
told as (select *, case when k % 13 = 0 or k % 19 = 0 then 'unparseable_date' when k % 11 = 0 or k % 17 = 0 then 'missing_required_field' when k % 23 = 0 then 'schema_invalid' end as reason_code from raw)"""


@query(f"""with {RAW_SQL} select reason_code, '{{"INV_NO":"' || no || '","CUST_ID":"' || cust || '","ISSUE_DT":"' || issue || '","DUE_DT":"' || due || '","CURR_CD":"USD","AMT":"' || amt || '","STATUS_CD":"' || status || '"}}' as original_data
from told where reason_code is not null""")
def q_quarantine_rows(spark, sf_dir):
    """Quarantined rows keep the raw row as JSON."""
    return validate(_raw_invoices(spark, sf_dir), "invoice", "erp")[1].select("reason_code", "original_data")


@query(f"""with {RAW_SQL} select r.reason_code, count(no) as n from (select unnest({list(REASONS)}) as reason_code) r left join told using (reason_code) group by all""")
def q_reason_counts(spark, sf_dir):
    """All reasons, those without rows too."""
    return measures.reason_counts(validate(_raw_invoices(spark, sf_dir), "invoice", "erp")[1]).select("reason_code", "n")


@query("""
select 'customer' as entity, c_custkey % 9 as kind, case c_custkey % 9 when 0 then 'unrecoverable_encoding' when 1 then 'missing_required_field' when 2 then 'unparseable_date' else 'clean' end as outcome, count(*) as n,
  max(case when c_custkey % 9 > 2 then 'Zoë ' || c_name end) as largest from customer group by all
union all select 'payment', l_orderkey % 5, case l_orderkey % 5 when 0 then 'unparseable_date' when 1 then 'schema_invalid' else 'clean' end, count(*), null from lineitem group by all""")
def q_validate_entities(spark, sf_dir):
    """Customers of the nested and payments of the flat system, by outcome; names come garbled and leave repaired."""
    name = "decode(encode(concat('Zoë ', c_name), 'UTF-8'), 'ISO-8859-1')"
    raw = table(spark, sf_dir, "customer").selectExpr(
        "concat(c_custkey % 9, '/', c_custkey) as customerId", f"case c_custkey % 9 when 0 then concat(c_name, '�') when 1 then 'unknown' else {name} end as customerName", "if(c_custkey % 9 = 2, 'TBD', '2024/02/29') as createdAt", "c_name as email")
    pay = table(spark, sf_dir, "lineitem").selectExpr("concat(l_orderkey % 5, '/', l_orderkey) as PMT_NO", "'I' as INV_NO", "if(l_orderkey % 5 = 0, '2024-02-30', '20240229') as PMT_DT", "if(l_orderkey % 5 = 1, 'x', ' 1e2 ') as AMT")
    out = []
    for entity, df, system, key in (("customer", raw, "crm", "customerId"), ("payment", pay, "erp", "PMT_NO")):
        good, bad = validate(df, entity, system)
        label = F.col("full_name") if entity == "customer" else F.lit(None).cast("string")
        rows = good.select(F.col("business_key").alias("key"), F.lit("clean").alias("outcome"), label.alias("name")).unionAll(
            bad.select(F.get_json_object("original_data", f"$.{key}"), "reason_code", F.lit(None).cast("string")))
        kind = F.split("key", "/")[0].cast("long")
        out.append(rows.groupBy(F.lit(entity).alias("entity"), kind.alias("kind"), "outcome").agg(F.count("*").alias("n"), F.max("name").alias("largest")))
    return out[0].unionAll(out[1])


# -- resolution ------------------------------------------------------------------


def _planted(spark, sf_dir, system: str):
    """Customers under names far apart (32 hexadecimal digits), some with a letter more in one system."""
    rows = table(spark, sf_dir, "customer").withColumn("name", F.md5(F.col("c_custkey").cast("string"))).where("c_custkey % 5 <> 0" if system == "erp" else "c_custkey % 7 <> 0")
    full = F.col("name") if system == "erp" else F.when(F.col("c_custkey") % 3 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))
    mail = F.when(F.col("c_custkey") % 2 == 0, F.concat("name", F.lit("@example.com")))
    return rows.select(F.lit(system).alias("source_system"), F.concat(F.lit(system), F.col("c_custkey").cast("string")).alias("business_key"), full.alias("full_name"), mail.alias("email"), F.lit(None).cast("string").alias("phone"))


ID_SQL = "(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12))"


@query(f"""select erp_key, crm_key, {ID_SQL} as canonical_id from (select *, md5('customer' || chr(31) || coalesce(erp_key, chr(0)) || chr(31) || coalesce(crm_key, chr(0))) as h from (
  select case when c_custkey % 5 <> 0 then 'erp' || c_custkey end as erp_key, case when c_custkey % 7 <> 0 then 'crm' || c_custkey end as crm_key from customer where c_custkey % 35 <> 0))""")
def q_resolve_customers_planted(spark, sf_dir):
    """Customers whose names are far apart match their own, with one letter more or without; ids are hashes of the keys."""
    return resolve_customers(_planted(spark, sf_dir, "erp"), _planted(spark, sf_dir, "crm"))[0].select("erp_key", "crm_key", "canonical_id")


@query("""
with s as (select l_partkey as a, l_suppkey as b, sum(l_quantity)::bigint as score from lineitem group by all),
ma as (select a, max(score) as m, count(*) filter (score = x) as na from (select *, max(score) over (partition by a) as x from s) group by a), mb as (select b, max(score) as m, count(*) filter (score = x) as nb from (select *, max(score) over (partition by b) as x from s) group by b),
done as (select a, b from s join ma using (a) join mb using (b) where s.score = ma.m and s.score = mb.m and na = 1 and nb = 1)
select 'erp' as source_system, a as business_key, b as candidate, score from s join ma using (a) where score = m and a not in (select a from done)
union all select 'crm', b, a, score from s join mb using (b) where score = m and b not in (select b from done)""")
def q_ambiguous_candidates(spark, sf_dir):
    """The top candidates of every record that found no match."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("erp_key"), F.col("l_suppkey").alias("crm_key")).agg(F.sum("l_quantity").cast("long").alias("score"))
    return ambiguous_candidates(mutual_top(pairs, "erp_key", "crm_key", "score"))


@query(f"""with {INVOICE_SQL} select source_system, reason_code, stage, original_data from (
  select 'erp' as source_system, key, p, d, a, 'E' as own from e where known and exists (select 1 from met where not sole and met.p = e.p and met.d = e.d and met.a = e.a)
  union all select 'crm', key, p, d, a, 'C' from c where known and exists (select 1 from met where not sole and met.p = c.p and met.d = c.d and met.a = c.a)),
(select 'ambiguous_match' as reason_code, 'resolution' as stage), lateral (select '{{"source_system":"' || source_system || '","business_key":"' || key || '","customer_business_key":"' || own || p || '","issue_date":"' || d || '","currency":"USD","amount":' || a || '.000000000000000000}}' as original_data)""")
def q_ambiguous_entries(spark, sf_dir):
    """Quarantine entries of ambiguous invoices hold the clean row."""
    return _resolved(spark, sf_dir)[1].select("source_system", "reason_code", "stage", "original_data")


@query(f"""with {INVOICE_SQL}, t as (select unnest([0.75, 0.9, 0.97]) as threshold),
truth as (select o_orderkey as k, o_custkey as p from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0),
known2 as (select threshold, c_custkey as k from t, customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0 and
  round(0.8 * case when c_custkey % 3 = 0 then 64.0 / 65 else 1 end + 0.15 * (c_custkey % 2 = 0)::int, 9) >= threshold),
hit as (select threshold, count(*) as hits from known2 join truth on p = known2.k group by all)
select threshold::decimal(3,2) as threshold, round(2.0 * coalesce(hits, 0) / (coalesce(hits, 0) + (select count(*) from truth)), 9) as f1 from t left join hit using (threshold)""")
def q_sweep(spark, sf_dir):
    """F1 of the invoices at three customer thresholds; each invoice has an amount of its own."""
    clean = {}
    for system, mod in (("erp", 5), ("crm", 7)):
        clean[system, "customer"] = _planted(spark, sf_dir, system)
        rows = table(spark, sf_dir, "orders").where(f"o_orderkey % {mod} <> 0")
        key = f"concat('{'I' if system == 'erp' else 'J'}', o_orderkey)"
        clean[system, "invoice"] = rows.selectExpr(f"'{system}' as source_system", f"{key} as business_key", f"concat('{system}', o_custkey) as customer_business_key", "date'2024-01-01' as issue_date", "'USD' as currency", "cast(o_orderkey as decimal(38,18)) as amount")
        clean[system, "payment"] = _payments(spark, sf_dir, system).where("false")
    truth = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0").selectExpr("'invoice' as entity_type", "concat('I', o_orderkey) as erp_key", "concat('J', o_orderkey) as crm_key")
    result = Result(None, clean, None, None, None)
    found = measures.sweep(result, truth, [0.75, 0.9, 0.97])
    return spark.createDataFrame(found, "threshold double, f1 double").select(F.col("threshold").cast("decimal(3,2)"), F.round("f1", 9).alias("f1"))


# -- constraints, targets, report --------------------------------------------------


def _entities(spark, sf_dir) -> dict:
    """Entity tables with planted breaches: repeated keys, nulls, a system that is none."""
    rows = table(spark, sf_dir, "orders")
    invoice = rows.selectExpr(
        "if(o_orderkey % 50 = 1, 'other', if(o_orderkey % 50 = 2, null, 'erp')) as source_system", "concat('I', o_orderkey div if(o_orderkey % 20 < 2, 20, 1), if(o_orderkey % 20 < 2, 'twice', '')) as business_key",
        "if(o_orderkey % 9 = 0, null, 'C') as customer_business_key", "if(o_orderkey % 10 = 3, null, o_orderdate) as issue_date", "'USD' as currency", "if(o_orderkey % 11 = 0, null, o_totalprice) as amount")
    people = table(spark, sf_dir, "customer").selectExpr("'crm' as source_system", "concat('C', c_custkey) as business_key", "if(c_custkey % 4 = 0, null, c_name) as full_name")
    return {"customer": people, "invoice": invoice}


@query("""
with i as (select case when o_orderkey % 50 = 1 then 'other' when o_orderkey % 50 = 2 then null else 'erp' end as s, 'I' || (o_orderkey // case when o_orderkey % 20 < 2 then 20 else 1 end) || case when o_orderkey % 20 < 2 then 'twice' else '' end as k, o_orderkey as o from orders),
x as (select 'E' || c_custkey as e, case when c_custkey % 3 = 0 then null else 'C' || (c_custkey // 2) end as c, case when c_custkey % 8 = 0 then 'none' else 'customer' end as t from customer)
select 'crosswalk.entity_type' as rule, count(*) filter (t = 'none') as n from x union all select 'crosswalk.keys', 0 union all select 'crosswalk.natural', 0
union all select 'crosswalk.canonical_id', count(*) from (select c from x where c is not null group by c having count(*) > 1)
union all select 'quarantine.reason_code', count(*) filter (o_orderkey % 6 = 0) from orders union all select 'quarantine.source_system', count(*) filter (o_orderkey % 10 = 7) from orders
union all select 'customer.key', 0 union all select 'customer.source_system', 0 union all select 'customer.business_key', 0 union all select 'customer.full_name', count(*) filter (c_custkey % 4 = 0) from customer
union all select 'invoice.key', count(*) from (select s, k from i group by all having count(*) > 1) union all select 'invoice.source_system', count(*) filter (s is null or s = 'other') from i
union all select 'invoice.business_key', 0 union all select 'invoice.customer_business_key', count(*) filter (o % 9 = 0) from i union all select 'invoice.issue_date', count(*) filter (o % 10 = 3) from i
union all select 'invoice.currency', 0 union all select 'invoice.amount', count(*) filter (o % 11 = 0) from i""")
def q_constraints(spark, sf_dir):
    """Every rule of the target tables with the number of its breaches."""
    crosswalk = table(spark, sf_dir, "customer").selectExpr(
        "if(c_custkey % 8 = 0, 'none', 'customer') as entity_type", "if(c_custkey % 3 = 0, concat('own', c_custkey), concat('C', c_custkey div 2)) as canonical_id", "concat('E', c_custkey) as erp_key", "if(c_custkey % 3 = 0, null, concat('C', c_custkey div 2)) as crm_key")
    quarantine = table(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 6 = 0, 'odd', 'schema_invalid') as reason_code", "if(o_orderkey % 10 = 7, 'odd', 'crm') as source_system")
    return violations(crosswalk, quarantine, _entities(spark, sf_dir))


def _result(spark, sf_dir, invoices=None) -> Result:
    """A run's frames over the tables: customers by key, invoices and payments resolved."""
    none = F.lit(None).cast("string")
    clean, work = {}, Workspace(spark, "result")
    lines = work.keep(_lines(spark, sf_dir), "lines")
    for system, letter in (("erp", "E"), ("crm", "C")):
        clean[system, "customer"] = table(spark, sf_dir, "customer").select(F.lit(system).alias("source_system"), F.concat(F.lit(letter), F.col("c_custkey").cast("string")).alias("business_key"), F.col("c_name").alias("full_name"))
        clean[system, "invoice"] = _invoices(spark, sf_dir, system)
        clean[system, "payment"] = _payments(spark, sf_dir, system, lines)
    # As in a run, what is resolved is written once: each figure of the report would else resolve it all again.
    resolved = work.keep(_resolved(spark, sf_dir)[0], "invoices")
    paid = work.keep(resolve_payments(clean["erp", "payment"], clean["crm", "payment"], resolved)[0], "payments")
    crosswalk = _customers(spark, sf_dir).select("entity_type", F.concat_ws("/", "erp_key", "crm_key").alias("canonical_id"), "erp_key", "crm_key").unionAll(resolved).unionAll(paid)
    bad = validate(_raw_invoices(spark, sf_dir), "invoice", "erp")[1].select("entity_type", "source_system", "reason_code", "stage", "original_data", F.lit(0).alias("__part"), F.lit("").alias("__seq"))
    logs = spark.createDataFrame([], "key_column string, key_value string, row_count long, differing_columns array<string>, __part int, __seq string")
    raw = RawTables({(s, e): clean[s, e].select(none.alias("x")) for s in SYSTEMS for e in ENTITIES})
    return Result(raw, clean, crosswalk, bad, logs, raw.counts())


@query(f"""with {INVOICE_SQL}, {PAYMENT_SQL}
select 'customers' as name, count(*) as n, null::bigint as cents from (select 'E' || c_custkey from customer union select 'C' || c_custkey from customer)
union all select 'invoices', (select count(*) from erp) + (select count(*) from crm), null union all select 'payments', (select count(*) from pe) + (select count(*) from pc), ((select sum(cents) from pe) + (select sum(cents) from pc))::bigint
union all select 'crosswalk', (select count(*) from invoice) + (select count(*) from payment) + (select count(*) from x), null
union all select 'quarantine', count(*) filter (o_orderkey % 13 = 0 or o_orderkey % 19 = 0 or o_orderkey % 11 = 0 or o_orderkey % 17 = 0 or o_orderkey % 23 = 0), null from orders""")
def q_load_targets(spark, sf_dir):
    """A run loaded into target tables twice: rows are merged by key, quarantine is replaced."""
    folder, result = Workspace(spark, "targets").path, _result(spark, sf_dir)
    for _ in range(2):
        persist.load_targets(spark, result, folder)
    out = []
    for name in ("customers", "invoices", "payments", "crosswalk", "quarantine"):
        df = spark.read.parquet(f"{folder}/{name}")
        cents = F.sum(F.col("amount") * 100).cast("long") if name == "payments" else F.lit(None).cast("long")
        out.append(df.agg(F.count("*").alias("n"), cents.alias("cents")).select(F.lit(name).alias("name"), "n", "cents"))
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3]).unionAll(out[4])


@query(f"with {INVOICE_SQL} select 'invoice' as entity_type, erp_key, crm_key from invoice")
def q_crosswalk_store(spark, sf_dir):
    """A crosswalk saved as JSON lines, merged with the same entries again, and read back."""
    path = f"{Workspace(spark, 'store').path}/crosswalk.json"
    result = Result(None, {}, Workspace(spark, "store").keep(_resolved(spark, sf_dir)[0], "invoices"), None, None)
    for _ in range(2):
        persist.save_crosswalk_lines(result, path)
    return read_crosswalk(spark, path, lines=True).select("entity_type", "erp_key", "crm_key")


PERCENT = "case when {b} = 0 then 'n/a' else printf('%.1f%%', 100.0 * {a} / {b}) end"


@query(f"""with {INVOICE_SQL}, {PAYMENT_SQL}, {RAW_SQL},
w as (select 'customer' as t, k::varchar as erp_key, k::varchar as crm_key from x union all select 'invoice', erp_key, crm_key from invoice union all select 'payment', erp_key, crm_key from payment),
rates as (select t, count(*) filter (erp_key is not null and crm_key is not null) as a, count(*) as b from w group by all),
raw_n as (select (select count(*) from customer) as c, (select count(*) from erp) as ei, (select count(*) from crm) as ci, (select count(*) from pe) as ep, (select count(*) from pc) as cp),
total as (select 2 * c + ei + ci + ep + cp as n, (select count(*) from told where reason_code is not null) as bad from raw_n),
d as (select count(*) as n, coalesce(sum(abs(ec - cc)), 0)::bigint as cents from pk where ec <> cc)
select '- Total records ingested: ' || n as line from total union all select '- Success rate (ingested, not quarantined): ' || {PERCENT.format(a='(n - bad)', b='n')} from total union all select '- Records quarantined: ' || bad from total
union all select '| ERP | ' || c || ' | ' || ei || ' | ' || ep || ' |' from raw_n union all select '| CRM | ' || c || ' | ' || ci || ' | ' || cp || ' |' from raw_n
union all select '| ' || t || ' | ' || a || ' | ' || b || ' | ' || {PERCENT.format(a='a', b='b')} || ' |' from rates
union all select '| ' || r.reason_code || ' | ' || count(no) || ' |' from (select unnest({list(REASONS)}) as reason_code) r left join told using (reason_code) group by r.reason_code
union all select 'ERP-only: ' || count(*) filter (erp_key is not null and crm_key is null) from w group by t union all select 'CRM-only: ' || count(*) filter (erp_key is null and crm_key is not null) from w group by t
union all select 'Mismatched payments: ' || n from d union all select 'Duplicate groups collapsed: 0'""")
def q_report(spark, sf_dir):
    """The report's figures, line by line as they are rendered."""
    with brief_shuffles(spark):
        text = report.render(_result(spark, sf_dir))
    heads = ("| Source", "| ---", "| Entity", "| Reason", "- `", "- ...", "Total", "#", "_none_")
    lines = [x for x in text.split("\n") if x and not x.startswith(heads)]
    return spark.createDataFrame([(x,) for x in lines], "line string")
