"""Scalar cleaning as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Markers that mean "no value": exact, case-sensitive, untrimmed. Fixed values.
MISSING = ("", "N/A", "NULL", "--", "unknown")

_SPECIALS = "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
REPLACEMENT = "�"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Windows-1252, read right; null where a character is lost for good."""
    encodable = c.rlike("^[\\x00-\\x7F\\xA0-\\xFF" + _SPECIALS + "]*$")
    again = F.encode(F.translate(c, _SPECIALS, _CONTROLS), "ISO-8859-1").cast("string")
    text = F.when(encodable, F.when(F.is_valid_utf8(again), again).otherwise(c)).otherwise(c)
    return F.when(c.contains(REPLACEMENT) | text.contains(REPLACEMENT), None).otherwise(text)


def parse_date(c: Column) -> Column:
    """The date of a text in any of the known forms, else null; digits alone are seconds in the session's time zone."""
    v = F.regexp_replace(strip(c), r"\s+", " ")

    def form(pattern: str, how: str) -> Column:
        return F.when(v.rlike(pattern), F.try_to_timestamp(v, F.lit(how)).cast("date"))

    seconds = F.when(v.rlike(r"^\d{1,12}$"), F.expr("1") * v.try_cast("bigint"))
    epoch = F.when(seconds <= 253_402_300_799, F.to_date(F.timestamp_seconds(seconds)))
    date = F.coalesce(
        form(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), form(r"^\d{8}$", "yyyyMMdd"), form(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        form(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), form(r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), form(r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), epoch)
    return F.when(date >= F.lit("0001-01-01").cast("date"), date)


def base_key(c: Column) -> Column:
    """A key without one trailing ``-DUP<digits>``."""
    return F.regexp_replace(c, r"(?s)-DUP\d+$", "")


def normal_email(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def normal_phone(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)\D", ""), F.lit(""))


def money(c: Column) -> Column:
    return strip(c).try_cast("decimal(38,18)")
