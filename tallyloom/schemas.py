"""Types, enumerations and column maps of the two systems."""

from __future__ import annotations

from pyspark.sql import types as T

SYSTEMS = ("erp", "crm")
ENTITIES = ("customer", "invoice", "payment")
# Reason codes in report order. Fixed values.
REASONS = ("unparseable_date", "unrecoverable_encoding", "missing_required_field", "schema_invalid", "ambiguous_match")

SEQ = "_seq"

#: Raw columns of the flat export, by entity. Fixed values.
ERP_COLUMNS = {
    "customer": ["CUST_ID", "CUST_NAME", "EMAIL_ADDR", "PHONE_NUM", "ADDR_LINE1", "CITY", "REGION", "POSTAL_CD", "COUNTRY", "CREATED_DT"],
    "invoice": ["INV_NO", "CUST_ID", "ISSUE_DT", "DUE_DT", "CURR_CD", "AMT", "STATUS_CD"],
    "payment": ["PMT_NO", "INV_NO", "CUST_ID", "PMT_DT", "AMT", "PMT_METHOD_CD"],
}

#: Canonical fields in order: name, flat column, nested column, required, cleaner. Fixed values.
FIELDS = {
    "customer": [
        ("business_key", "CUST_ID", "customerId", True, None), ("full_name", "CUST_NAME", "customerName", True, "encoding"), ("email", "EMAIL_ADDR", "email", False, None),
        ("phone", "PHONE_NUM", "phone", False, None), ("street", "ADDR_LINE1", "street", False, "encoding"), ("city", "CITY", "city", False, "encoding"),
        ("region", "REGION", "region", False, "encoding"), ("postal_code", "POSTAL_CD", "postalCode", False, None), ("country", "COUNTRY", "country", False, None),
        ("created_at", "CREATED_DT", "createdAt", False, "date"),
    ],
    "invoice": [
        ("business_key", "INV_NO", "invoiceNumber", True, None), ("customer_business_key", "CUST_ID", "customerId", True, None), ("issue_date", "ISSUE_DT", "issueDate", True, "date"),
        ("due_date", "DUE_DT", "dueDate", False, "date"), ("currency", "CURR_CD", "currency", True, None), ("amount", "AMT", "amount", True, "decimal"), ("status", "STATUS_CD", "status", False, None),
    ],
    "payment": [
        ("business_key", "PMT_NO", "paymentNumber", True, None), ("invoice_business_key", "INV_NO", "invoiceNumber", True, None), ("payment_date", "PMT_DT", "paymentDate", True, "date"),
        ("amount", "AMT", "amount", True, "decimal"), ("method", "PMT_METHOD_CD", "method", False, None),
    ],
}

MONEY = T.DecimalType(38, 18)


def raw_column(field: tuple, system: str) -> str:
    return field[1] if system == "erp" else field[2]


def key_column(entity: str, system: str) -> str:
    return raw_column(FIELDS[entity][0], system)


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PAYMENT = text_schema(["paymentNumber", "paymentDate", "amount", "method"])
INVOICE = text_schema(["invoiceNumber", "issueDate", "dueDate", "currency", "amount", "status"]).add("payments", T.ArrayType(PAYMENT))
CUSTOMER = text_schema(["customerId", "customerName", "email", "phone", "createdAt"]).add("address", text_schema(["street", "city", "region", "postalCode", "country"])).add("invoices", T.ArrayType(INVOICE))

CROSSWALK = "entity_type string, canonical_id string, erp_key string, crm_key string"
QUARANTINE = "entity_type string, source_system string, reason_code string, stage string, original_data string"
DUPLICATES = "key_column string, key_value string, row_count long, differing_columns array<string>"
