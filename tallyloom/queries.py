"""Queries of the engine's operators over the driver's tables, with the same in SQL.

Two systems are derived from the tables by arithmetic on keys: ``orders`` as
invoices, aggregated ``lineitem`` as payments, ``customer`` as customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import clean
from .operators.dedupe import collapse
from .operators.resolve import mutual_top, resolve_customers, resolve_invoices, resolve_payments, score_customers
from .operators.upsert import upsert_crosswalk, upsert_rows
from .operators.validate import classify
from .plans import measures
from .plans.generate import suffixed
from .plans.report import _listed
from .schemas import SEQ
from .sources.exports import flatten

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MARKED = "case {k} % 7 when 0 then '' when 1 then 'N/A' when 2 then 'NULL' when 3 then '--' when 4 then 'unknown' when 5 then 'N/A ' else {v} end"
MARK_SQL = "case when {c} in ('', 'N/A', 'NULL', '--', 'unknown') then null else {c} end"


@query(f"select c_custkey, {MARK_SQL.format(c='raw')} as value from (select c_custkey, {MARKED.format(k='c_custkey', v='c_name')} as raw from customer)")
def q_missing_markers(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("c_custkey", MARKED.format(k="c_custkey", v="c_name") + " as raw")
    return raw.select("c_custkey", clean.missing_to_null(F.col("raw")).alias("value"))


DATE_FORMS = ["%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%d %b %Y", "%Y/%m/%d", "%Y%m%d"]
SPARK_FORMS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "yyyy/MM/dd", "yyyyMMdd"]


@query(f"""
select o_orderkey, case when k < 7 then d end as day, k >= 7 as invalid
from (select o_orderkey, o_orderdate::date as d, o_orderkey % 10 as k from orders)""")
def q_parse_dates(spark, sf_dir):
    day = "cast(o_orderdate as date)"
    forms = [f"date_format({day}, '{f}')" for f in SPARK_FORMS] + [f"cast(unix_timestamp(cast({day} as timestamp)) as string)", "'0000-00-00'", "'TBD'", f"date_format({day}, 'yyyy-MM')"]
    cases = " ".join(f"when {i} then {f}" for i, f in enumerate(forms))
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"case o_orderkey % 10 {cases} end as raw")
    parsed = rows.select("o_orderkey", "raw", clean.parse_date(F.col("raw")).alias("day"))
    return parsed.select("o_orderkey", "day", (F.col("raw").isNotNull() & F.col("day").isNull()).alias("invalid"))


@query()
def q_mojibake(spark, sf_dir):
    """The repair of every text read in the wrong encoding; what has no character in the code page stays as it is. Tests hold it against a plain loop."""
    wrong = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), clean._CONTROLS, clean._SPECIALS)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean.repair_mojibake(wrong), 256).alias("fixed"), "n_chars")


@query("""
select doc_id, sha256(text) as fixed from documents
where octet_length(encode(text)) = len(text) or not regexp_matches(hex(encode(text)), '^([0-9A-F]{2})*?(81|8D|8F|90|9D)')""")
def q_mojibake_round_trip(spark, sf_dir):
    """Texts whose bytes all have characters in the code page come back whole."""
    rows = table(spark, sf_dir, "documents").where(~F.hex(F.encode("text", "UTF-8")).rlike("^(..)*?(81|8D|8F|90|9D)"))
    wrong = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), clean._CONTROLS, clean._SPECIALS)
    return rows.select("doc_id", F.sha2(clean.repair_mojibake(wrong), 256).alias("fixed"))


@query("""
select c_custkey, lower(email) as email, regexp_replace(phone, '[^0-9]', '', 'g') as phone
from (select c_custkey, c_name || '@Example.com' as email, '+' || c_nationkey || ' (' || c_custkey || ') x' || (c_custkey % 97) as phone from customer)""")
def q_normalise_contact(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('  ', c_name, '@Example.com\t') as email", "concat('+', c_nationkey, ' (', c_custkey, ') x', c_custkey % 97) as phone")
    return rows.select("c_custkey", clean.normal_email(F.col("email")).alias("email"), clean.normal_phone(F.col("phone")).alias("phone"))


@query("""
select p_partkey, case when p_partkey % 5 = 0 then null else round(p_retailprice * 100)::bigint::decimal(18,2) / 100 end::decimal(14,2) as amount, p_partkey % 5 = 0 as invalid from part""")
def q_decimal_cast(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_partkey % 5 = 0 then concat('x', p_partkey) else concat(' ', cast(cast(round(p_retailprice * 100) as bigint) / 100.0 as decimal(14,2)), ' ') end as raw")
    amount = clean.money(F.col("raw"))
    return rows.select("p_partkey", amount.cast("decimal(14,2)").alias("amount"), amount.isNull().alias("invalid"))


COPIES = "select c_custkey as k, c_name as name, c_mktsegment as segment, copy, c_custkey * 3 + copy as seq, 'C' || c_custkey || case when copy > 0 then '-DUP' || (copy + 1) else '' end as id from customer, (select unnest([0, 1, 2]) as copy) where copy <= c_custkey % 3"
COPY_SQL = f"""
with c as (select *, case when copy = 1 then ' ' || name || ' ' else name end as n, case when copy = 2 then lower(segment) when copy = 0 and k % 2 = 0 then ' ' || segment else segment end as s from ({COPIES}))"""


def _copies(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_name as name", "c_mktsegment as segment", "explode(sequence(0, cast(c_custkey % 3 as int))) as copy")
    return rows.selectExpr(
        "concat('C', k, if(copy > 0, concat('-DUP', copy + 1), '')) as CUST_ID", "if(copy = 1, concat(' ', name, ' '), name) as CUST_NAME",
        "case when copy = 2 then lower(segment) when copy = 0 and k % 2 = 0 then concat(' ', segment) else segment end as REGION", f"k * 3 + copy as {SEQ}")


@query(COPY_SQL + """
select 'C' || k as "CUST_ID", arg_min(n, (n <> trim(n))::int * 1000000000 + (n = upper(n))::int * 100000000 + copy) as "CUST_NAME",
  arg_min(s, (s <> trim(s))::int * 1000000000 + (s = upper(s))::int * 100000000 + copy) as "REGION" from c group by k""")
def q_dedupe(spark, sf_dir):
    return collapse(_copies(spark, sf_dir), "CUST_ID")[0].drop(SEQ)


@query(COPY_SQL + """
select 'CUST_ID' as key_column, 'C' || k as key_value, count(*) as row_count,
  case when count(distinct n) > 1 and count(distinct s) > 1 then 'CUST_NAME,REGION' when count(distinct n) > 1 then 'CUST_NAME' when count(distinct s) > 1 then 'REGION' else '' end as differing
from c group by k having count(*) > 1""")
def q_dup_log(spark, sf_dir):
    log = collapse(_copies(spark, sf_dir), "CUST_ID")[1]
    return log.select("key_column", "key_value", "row_count", F.array_join("differing_columns", ",").alias("differing"))


def _raw_invoices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('INV-', o_orderkey) as INV_NO", "if(o_orderkey % 11 = 0, 'N/A', concat('C', o_custkey)) as CUST_ID",
        "case when o_orderkey % 13 = 0 then 'TBD' when o_orderkey % 17 = 0 then '' else cast(cast(o_orderdate as date) as string) end as ISSUE_DT", "if(o_orderkey % 19 = 0, '0000-00-00', '--') as DUE_DT",
        "'USD' as CURR_CD", "if(o_orderkey % 23 = 0, 'much', cast(cast(o_totalprice as decimal(14,2)) as string)) as AMT", "o_orderstatus as STATUS_CD")


@query("""
select reason_code, stage, count(*) as n from (
  select case when k % 13 = 0 or k % 19 = 0 then 'unparseable_date' when k % 11 = 0 or k % 17 = 0 then 'missing_required_field' when k % 23 = 0 then 'schema_invalid' end as reason_code,
    case when k % 13 = 0 or k % 19 = 0 then 'cleaning' when k % 11 = 0 or k % 17 = 0 or k % 23 = 0 then 'schema_validation' end as stage from (select o_orderkey as k from orders)) group by all""")
def q_validate_reason(spark, sf_dir):
    return classify(_raw_invoices(spark, sf_dir), "invoice", "erp").groupBy("reason_code", "stage").agg(F.count("*").alias("n"))


LINES = "select l_orderkey as o, l_shipdate::date as d, sum(round(l_extendedprice * 100)::bigint)::bigint as cents from lineitem group by all"


@query(f"""
select 'invoice' as entity, o_orderkey, null as payment, c_name, o_orderdate::date as day, c_mktsegment as city, null::bigint as cents from customer join orders on c_custkey = o_custkey
union all select 'payment', o, o || '/' || d, c_name, d, c_mktsegment, cents from ({LINES}) join orders on o = o_orderkey join customer on c_custkey = o_custkey""")
def q_flatten_nested(spark, sf_dir):
    """Payments nested into orders, these into customer documents, and all flattened again."""
    flat = flatten(nested(spark, sf_dir))
    customers = flat["customer"].select("customerId", "customerName", "city")
    invoices = flat["invoice"].join(customers, "customerId")
    payments = flat["payment"].drop(SEQ).join(invoices.select("invoiceNumber", "customerName", "city"), "invoiceNumber")
    none = F.lit(None)
    one = invoices.select(F.lit("invoice").alias("entity"), F.col("invoiceNumber").cast("long").alias("o_orderkey"), none.cast("string").alias("payment"), F.col("customerName").alias("c_name"), F.to_date("issueDate").alias("day"), "city", none.cast("long").alias("cents"))
    two = payments.select(F.lit("payment").alias("entity"), F.col("invoiceNumber").cast("long").alias("o_orderkey"), F.col("paymentNumber").alias("payment"), F.col("customerName").alias("c_name"), F.to_date("paymentDate").alias("day"), "city", (F.col("amount").cast("decimal(14,2)") * 100).cast("long").alias("cents"))
    return one.unionAll(two)


def nested(spark, sf_dir) -> DataFrame:
    """Customer documents of the tables, as the nested export has them."""
    customer, orders, none = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("d")).agg((cents / F.lit(100).cast("decimal(3,0)")).cast("decimal(14,2)").cast("string").alias("amount"))
    paid = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat_ws("/", F.col("l_orderkey").cast("string"), "d").alias("paymentNumber"), F.col("d").alias("paymentDate"), "amount", none.alias("method"))).alias("payments"))
    item = F.struct(F.col("o_orderkey").cast("string").alias("invoiceNumber"), F.col("o_orderdate").cast("date").cast("string").alias("issueDate"), none.alias("dueDate"), F.lit("USD").alias("currency"), F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("amount"), F.col("o_orderstatus").alias("status"), "payments")
    rows = orders.join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.collect_list(item).alias("invoices"))
    address = F.struct(none.alias("street"), F.col("c_mktsegment").alias("city"), none.alias("region"), none.alias("postalCode"), none.alias("country")).alias("address")
    return customer.join(rows, customer.c_custkey == rows.o_custkey, "left").select(F.col("c_custkey").cast("string").alias("customerId"), F.col("c_name").alias("customerName"), none.alias("email"), none.alias("phone"), none.alias("createdAt"), address, "invoices")


# -- resolution: customers pair by key but for every 17th; days are coarse, so that some agree by chance ---------


INVOICE_SQL = """
x as (select c_custkey as k from customer where c_custkey % 17 <> 0),
erp as (select 'I' || o_orderkey as key, o_custkey as p, date_trunc('month', o_orderdate)::date as d, (o_totalprice::bigint // 50000) as a from orders where o_orderkey % 5 <> 0),
crm as (select 'J' || o_orderkey as key, o_custkey as p, date_trunc('month', o_orderdate)::date as d, (o_totalprice::bigint // 50000) as a from orders where o_orderkey % 7 <> 0),
e as (select *, exists (select 1 from x where k = p) as known from erp), c as (select *, exists (select 1 from x where k = p) as known from crm),
ge as (select p, d, a, count(*) as n, min(key) as erp_key from e where known group by all), gc as (select p, d, a, count(*) as n, min(key) as crm_key from c where known group by all),
met as (select ge.p, ge.d, ge.a, ge.n = 1 and gc.n = 1 as sole, erp_key, crm_key from ge join gc on ge.p = gc.p and ge.d = gc.d and ge.a = gc.a),
invoice as (
  select erp_key, crm_key from met where sole
  union all select key, null from e where not known or not exists (select 1 from met where met.p = e.p and met.d = e.d and met.a = e.a)
  union all select null, key from c where not known or not exists (select 1 from met where met.p = c.p and met.d = c.d and met.a = c.a))"""


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 17 <> 0").selectExpr("'customer' as entity_type", "concat('E', c_custkey) as erp_key", "concat('C', c_custkey) as crm_key")


def _invoices(spark, sf_dir, system: str) -> DataFrame:
    prefix, own, drop = ("E", "I", 5) if system == "erp" else ("C", "J", 7)
    return table(spark, sf_dir, "orders").where(f"o_orderkey % {drop} <> 0").selectExpr(
        f"'{system}' as source_system", f"concat('{own}', o_orderkey) as business_key", f"concat('{prefix}', o_custkey) as customer_business_key",
        "cast(date_trunc('month', o_orderdate) as date) as issue_date", "'USD' as currency", "cast(cast(round(o_totalprice) as bigint) div 50000 as decimal(38,18)) as amount")


def _resolved(spark, sf_dir):
    return resolve_invoices(_invoices(spark, sf_dir, "erp"), _invoices(spark, sf_dir, "crm"), _customers(spark, sf_dir))


@query(f"with {INVOICE_SQL} select erp_key, crm_key from invoice")
def q_resolve_invoices(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("erp_key", "crm_key")


@query(f"""with {INVOICE_SQL} select source_system, count(*) as n from (
  select 'erp' as source_system from e where known and exists (select 1 from met where not sole and met.p = e.p and met.d = e.d and met.a = e.a)
  union all select 'crm' from c where known and exists (select 1 from met where not sole and met.p = c.p and met.d = c.d and met.a = c.a)) group by all""")
def q_ambiguous_invoices(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].groupBy("source_system").agg(F.count("*").alias("n"))


PAYMENT_SQL = """
line as (select l_orderkey as o, l_shipdate::date as d, sum(round(l_extendedprice * 100)::bigint)::bigint as cents from lineitem group by all),
pe as (select 'P' || o || '/' || d as key, o, d, cents + case when o % 9 = 0 then 150 else 0 end as cents from line where o % 4 <> 0),
pc as (select 'Q' || o || '/' || d as key, o, d, cents from line where o % 6 <> 0),
xi as (select substr(erp_key, 2)::bigint as oe, substr(crm_key, 2)::bigint as oc from invoice where erp_key is not null and crm_key is not null),
pk as (select pe.key as erp_key, pc.key as crm_key, pe.cents as ec, pc.cents as cc from xi join pe on pe.o = xi.oe join pc on pc.o = xi.oc and pc.d = pe.d),
payment as (select erp_key, crm_key from pk union all select key, null from pe where key not in (select erp_key from pk) union all select null, key from pc where key not in (select crm_key from pk))"""


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_shipdate").cast("date").alias("d")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


def _payments(spark, sf_dir, system: str, lines: DataFrame | None = None) -> DataFrame:
    """``lines``: as ``_lines`` gives them, if they are there already."""
    lines = _lines(spark, sf_dir) if lines is None else lines
    own, parent, drop, more = ("P", "I", 4, "if(o % 9 = 0, 150, 0)") if system == "erp" else ("Q", "J", 6, "0")
    return lines.where(f"o % {drop} <> 0").selectExpr(f"'{system}' as source_system", f"concat('{own}', o, '/', d) as business_key", f"concat('{parent}', o) as invoice_business_key", "d as payment_date", f"cast((cents + {more}) / 100.0 as decimal(38,18)) as amount")


def _paid(spark, sf_dir):
    erp, crm = _payments(spark, sf_dir, "erp"), _payments(spark, sf_dir, "crm")
    return resolve_payments(erp, crm, _resolved(spark, sf_dir)[0])[0], erp, crm


@query(f"with {INVOICE_SQL}, {PAYMENT_SQL} select erp_key, crm_key from payment")
def q_resolve_payments(spark, sf_dir):
    return _paid(spark, sf_dir)[0].select("erp_key", "crm_key")


@query(f"with {INVOICE_SQL}, {PAYMENT_SQL} select count(*) as n, coalesce(sum(abs(ec - cc)), 0)::bigint as cents from pk where ec <> cc")
def q_payment_drift(spark, sf_dir):
    crosswalk, erp, crm = _paid(spark, sf_dir)
    return measures.payment_drift(crosswalk, erp, crm).agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("drift") * 100).cast("long")), F.lit(0)).alias("cents"))


RATES_SQL = "with {i}, {p}, w as (select 'invoice' as entity_type, erp_key, crm_key from invoice union all select 'payment', erp_key, crm_key from payment)"
ENTITIES_SQL = "(select unnest(['customer', 'invoice', 'payment']) as entity_type) t left join w using (entity_type)"


def _walk(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].unionAll(_paid(spark, sf_dir)[0])


@query(RATES_SQL.format(i=INVOICE_SQL, p=PAYMENT_SQL) + f"""
select entity_type, count(*) filter (erp_key is not null and crm_key is not null) as matched, count(*) filter (erp_key is not null or crm_key is not null) as total,
  round(count(*) filter (erp_key is not null and crm_key is not null) / nullif(count(*) filter (erp_key is not null or crm_key is not null), 0), 9) as rate from {ENTITIES_SQL} group by all""")
def q_match_rates(spark, sf_dir):
    return measures.match_rates(_walk(spark, sf_dir)).select("entity_type", "matched", "total", F.round("rate", 9).alias("rate"))


@query(RATES_SQL.format(i=INVOICE_SQL, p=PAYMENT_SQL) + f"""
select entity_type, count(*) filter (erp_key is not null and crm_key is null) as erp_only, count(*) filter (erp_key is null and crm_key is not null) as crm_only from {ENTITIES_SQL} group by all""")
def q_orphans(spark, sf_dir):
    return measures.orphan_counts(_walk(spark, sf_dir)).select("entity_type", "erp_only", "crm_only")


@query(f"with {INVOICE_SQL}" + """, f as (select substr(erp_key, 2)::bigint as k from invoice where erp_key is not null and crm_key is not null and substr(erp_key, 2) = substr(crm_key, 2)),
n as (select (select count(*) from invoice where erp_key is not null and crm_key is not null) as predicted, (select count(*) from orders where o_orderkey % 35 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0) as expected, (select count(*) from f) as hits)
select predicted, expected, hits, round(hits / predicted, 9) as precision, round(hits / expected, 9) as recall, round(2.0 * hits / (predicted + expected), 9) as f1 from n""")
def q_precision_recall(spark, sf_dir):
    truth = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0").selectExpr("'invoice' as entity_type", "concat('I', o_orderkey) as erp_key", "concat('J', o_orderkey) as crm_key")
    return measures.score(_resolved(spark, sf_dir)[0], truth).select("predicted", "expected", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""
with s as (select l_partkey as a, l_suppkey as b, sum(l_quantity)::bigint as score from lineitem group by all),
ma as (select a, max(score) as m from s group by a), mb as (select b, max(score) as m from s group by b),
t as (select s.*, s.score = ma.m as ta, s.score = mb.m as tb from s join ma using (a) join mb using (b)),
n as (select *, count(*) filter (ta) over (partition by a) as na, count(*) filter (tb) over (partition by b) as nb from t)
select a, b, score from n where ta and tb and na = 1 and nb = 1""")
def q_mutual_top(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").cast("long").alias("score"))
    return mutual_top(pairs, "a", "b", "score").where("matched").select("a", "b", "score")


SYLLABLES = ["bako", "duru", "fime", "gopa", "hilu", "jexo", "kyra", "mozi", "nuve", "pwat"]


def _people(spark, sf_dir, system: str) -> DataFrame:
    digits = F.split(F.format_string("%05d", F.col("c_custkey")), "")
    name = F.initcap(F.array_join(F.transform(digits, lambda x: F.element_at(F.array(*[F.lit(s) for s in SYLLABLES]), x.cast("int") + 1)), ""))
    rows = table(spark, sf_dir, "customer").withColumn("name", F.concat_ws(" ", F.col("c_mktsegment"), name))
    rows = rows.where("c_custkey % 5 <> 0" if system == "erp" else "c_custkey % 7 <> 0")
    # In one system some names have a letter too many; some rows have an e-mail or a phone in both.
    full = F.col("name") if system == "erp" else F.when(F.col("c_custkey") % 3 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))
    email = F.when(F.col("c_custkey") % 2 == 0, F.concat("name", F.lit("@example.com")))
    return rows.select(F.lit(system).alias("source_system"), F.concat(F.lit(system), F.col("c_custkey").cast("string")).alias("business_key"), full.alias("full_name"), email.alias("email"), F.lit(None).cast("string").alias("phone"))


@query()
def q_resolve_customers_fuzzy(spark, sf_dir):
    """Names alike, not equal: outside SQL; held against the unpruned nested loop in tests."""
    crosswalk, _ = resolve_customers(_people(spark, sf_dir, "erp"), _people(spark, sf_dir, "crm"))
    return crosswalk.select("erp_key", "crm_key")


@query("""select 'erp' || c_custkey as erp_key, 'crm' || c_custkey as crm_key, 0.95 as score from customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0 and c_custkey % 3 <> 0 and c_custkey % 2 = 0""")
def q_score_customers_exact(spark, sf_dir):
    """At a threshold that only equal names with equal e-mails reach."""
    pairs = score_customers(_people(spark, sf_dir, "erp"), _people(spark, sf_dir, "crm"), 0.93)
    return pairs.where("score > 0.9499").select("erp_key", "crm_key", F.round("score", 2).cast("decimal(3,2)").alias("score"))


@query("""
with old as (select 'customer' as entity_type, 'old' || c_custkey as canonical_id, 'E' || c_custkey as erp_key, case when c_custkey % 3 = 0 then null else 'C' || c_custkey end as crm_key from customer where c_custkey % 2 = 0),
new as (select 'customer' as entity_type, 'new' || c_custkey as canonical_id, 'E' || c_custkey as erp_key, case when c_custkey % 3 = 0 then null else 'C' || c_custkey end as crm_key from customer)
select * from old union all select * from new n where not exists (select 1 from old o where o.entity_type = n.entity_type and o.erp_key is not distinct from n.erp_key and o.crm_key is not distinct from n.crm_key)""")
def q_crosswalk_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    make = lambda df, tag: df.selectExpr("'customer' as entity_type", f"concat('{tag}', c_custkey) as canonical_id", "concat('E', c_custkey) as erp_key", "if(c_custkey % 3 = 0, null, concat('C', c_custkey)) as crm_key")
    return upsert_crosswalk(make(rows, "new").unionAll(make(rows, "new")), make(rows.where("c_custkey % 2 = 0"), "old"))


@query("""
select coalesce(n.source_system, o.source_system) as source_system, coalesce(n.business_key, o.business_key) as business_key, case when n.business_key is not null then n.status else o.status end as status
from (select 'erp' as source_system, o_orderkey as business_key, o_orderstatus as status from orders where o_orderkey % 3 <> 0) o
full join (select 'erp' as source_system, o_orderkey as business_key, case when o_orderkey % 4 = 0 then null else 'new' end as status from orders where o_orderkey % 2 = 0) n on n.business_key = o.business_key""")
def q_target_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    old = rows.where("o_orderkey % 3 <> 0").selectExpr("'erp' as source_system", "o_orderkey as business_key", "o_orderstatus as status")
    new = rows.where("o_orderkey % 2 = 0").selectExpr("'erp' as source_system", "o_orderkey as business_key", "if(o_orderkey % 4 = 0, null, 'new') as status")
    return upsert_rows(new, old, ["source_system", "business_key"])


@query("""
select l_orderkey, l_linenumber, key, count(*) as n from (
  select l_orderkey, l_linenumber, 'L' || l_orderkey || case when row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1 then '-DUP' || row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) else '' end as key from lineitem) group by all""")
def q_dup_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"))
    return suffixed(rows, "key", F.col("o")).groupBy("l_orderkey", "l_linenumber", "key").agg(F.count("*").alias("n"))


@query(f"""with {INVOICE_SQL}, alone as (select erp_key from invoice where crm_key is null), n as (select count(*) as n from alone),
first as (select row_number() over (order by erp_key) as place, '- `erp_key=' || erp_key || '` `crm_key=None`' as line from alone)
select place, line from first where place <= 5 union all select 6, '- ...and ' || (n - 5) || ' more' from n where n > 5 union all select 1, '_none_' from n where n = 0""")
def q_topk_sample(spark, sf_dir):
    """The report's sample of orphans: the first five, and how many more there are."""
    alone = _resolved(spark, sf_dir)[0].where("crm_key is null")
    return spark.createDataFrame(list(enumerate(_listed(alone, alone.count(), 5), 1)), "place long, line string")


from . import queries_exports, queries_generated  # noqa: E402, F401  (they add theirs to the tables above)
