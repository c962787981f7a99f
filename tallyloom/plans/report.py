"""The Markdown report: figures from Spark, text on the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import ENTITIES, SYSTEMS
from .measures import match_rates, orphan_counts, payment_drift, reason_counts
from .reconcile import Result

# Headings, labels and the order of lines are the report's. Fixed values.
SIDES = {"erp": "crm", "crm": "erp"}


def _share(part: int, whole: int) -> str:
    return f"{part / whole:.1%}" if whole else "n/a"


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows]]


def _listed(df, count: int, size: int) -> list[str]:
    """Bullets of the first keys in order, or a note that there are none."""
    if not count:
        return ["_none_"]
    rows = df.orderBy("erp_key", "crm_key").limit(size).collect()
    return [f"- `erp_key={r.erp_key}` `crm_key={r.crm_key}`" for r in rows] + ([f"- ...and {count - size} more"] if count > size else [])


def render(result: Result, seconds: float | None = None, scores=None, sample: int = 5) -> str:
    """``scores``: a row with precision, recall and f1, if the truth is known."""
    total = sum(result.counts.values())
    reasons = reason_counts(result.quarantine).orderBy("place").collect()
    bad = sum(r.n for r in reasons)
    summary = [f"- Total records ingested: {total}", f"- Success rate (ingested, not quarantined): {_share(total - bad, total)}", f"- Records quarantined: {bad}"]
    if seconds is not None:
        summary.append(f"- Execution time: {seconds:.2f}s")
    parts = [("# Reconciliation Report", []), ("## Executive summary", summary)]
    parts.append(("## Records ingested per source system", _table(["Source", *(f"{e.capitalize()}s" for e in ENTITIES)], [[s.upper(), *(result.counts[s, e] for e in ENTITIES)] for s in SYSTEMS])))
    rates = match_rates(result.crosswalk).orderBy("place").collect()
    parts.append(("## Match rate", _table(["Entity", "Matched", "Total", "Match rate"], [[r.entity_type, r.matched, r.total, _share(r.matched, r.total)] for r in rates])))
    parts.append(("## Quarantine breakdown", [f"Total quarantined: {bad}", "", *_table(["Reason code", "Count"], [[r.reason_code, r.n] for r in reasons])]))
    parts.append(("## Orphans (records with no counterpart in the other system)", []))
    for r in orphan_counts(result.crosswalk).orderBy("place").collect():
        lines = []
        for side, other in SIDES.items():
            df = result.crosswalk.where((F.col("entity_type") == r.entity_type) & F.col(f"{side}_key").isNotNull() & F.col(f"{other}_key").isNull())
            count = r[f"{side}_only"]
            lines += [f"{side.upper()}-only: {count}", "", *_listed(df, count, sample), ""]
        parts.append((f"### {r.entity_type.capitalize()}", lines[:-1]))
    drift = payment_drift(result.crosswalk, result.clean["erp", "payment"], result.clean["crm", "payment"]).agg(F.count("*").alias("n"), F.sum("drift").alias("s")).first()
    amount = f"{drift.s.normalize():f}" if drift.s else "0"
    parts.append(("## Payment amount mismatches", [f"Mismatched payments: {drift.n}", "", f"Total drift: {amount}", ""]))
    groups = result.duplicates.count()
    lines = [f"Duplicate groups collapsed: {groups}", ""]
    if groups:
        logs = result.duplicates.orderBy("__part", F.length("__seq"), "__seq").limit(sample).collect()
        lines += _table(["Key column", "Key value", "Rows merged", "Differing columns"], [[x.key_column, x.key_value, x.row_count, ", ".join(x.differing_columns) or "_none_"] for x in logs])
        lines += ["", f"...and {groups - sample} more", ""] if groups > sample else []
    else:
        lines.append("_none_")
    parts.append(("## Intra-system duplicates collapsed", lines))
    if scores is not None:
        parts.append(("## Precision / recall (against ground truth)", [f"- Precision: {scores.precision:.1%}", f"- Recall: {scores.recall:.1%}", f"- F1: {scores.f1:.1%}"]))
    return "\n\n".join("\n".join([head, *([""] if lines else []), *lines]) for head, lines in parts) + "\n"
