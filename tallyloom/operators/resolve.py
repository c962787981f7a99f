"""Entity resolution across the two systems: mutual, unique top matches.

Customers: every pair that can reach the threshold is scored, and only these.
A pair scores 0.8 * name + 0.15 * same e-mail + 0.05 * same phone. Pairs that
share a signal meet by equi-joins. A pair without one needs a name ratio of
threshold / 0.8, which beyond 0.9 leaves few ways: (1) few inserts and deletes,
so that one of some even pieces of one name stands nearly in place in the other;
(2) the same for the names' sorted tokens; (3) one name's tokens are all in the
other's, so they meet at the rarest of them; (4) very long names whose tokens are
nearly all shared, met at one of the few rarest. Each is an equi-join. At
thresholds of 0.72 and less any pair may match, and pairs are formed by a nested
loop over the smaller side, up to ``NESTED`` pairs. Up to ``SIDE`` names of the smaller
side, letters are counted instead of (1), (2) and (4) (``name_letters``), by tasks that
hold a block of each side: these ways are for sides beyond that.

Invoices and payments: pairs must agree on exact values under a resolved parent,
so counts by these values settle all outcomes and pairs are never formed.

Outcomes: matched, erp_orphan, crm_orphan, ambiguous (to quarantine).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clean import normal_email, normal_phone
from ..functions.similarity import name_similarity
from ..schemas import SEQ
from ..sources.workspace import Workspace
from .name_letters import near_by_letters
from .validate import as_json

NAME, EMAIL, PHONE = 0.8, 0.15, 0.05
THRESHOLD = 0.75
#: Name ratio up to which partial matches count, so that nothing can be pruned.
PARTIAL = 0.9
TOKEN_SCALE = 0.95
#: Pairs that a nested loop may form; beyond, a threshold that prunes nothing is refused.
NESTED = 4_000_000_000
#: Names of the smaller side up to which all are held against the letters of the others'.
SIDE = 1_000_000
#: Pairs that are all scored, as looking for candidates takes longer.
FEW = 100_000
#: Classes of letters whose counts bound a ratio.
BAG = 32
#: White space beyond ASCII, at which names are cut in tokens too. Fixed values.
OTHER_SPACE = r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def canonical_id(*parts: Column) -> Column:
    """An id in UUID form that is the same for the same keys, in every attempt."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def mutual_top(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """``pairs`` with ``matched``: each side's only best partner is the other."""
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    rows = pairs.withColumn("__ma", F.max(score).over(wa)).withColumn("__ta", F.col(score) == F.col("__ma")).withColumn("__na", F.count_if("__ta").over(wa))
    rows = rows.withColumn("__mb", F.max(score).over(wb)).withColumn("__tb", F.col(score) == F.col("__mb")).withColumn("__nb", F.count_if("__tb").over(wb))
    matched = F.col("__ta") & F.col("__tb") & (F.col("__na") == 1) & (F.col("__nb") == 1)
    return rows.withColumn("matched", matched).drop("__ma", "__ta", "__na", "__mb", "__tb", "__nb")


# -- customers -----------------------------------------------------------------


def _near_strings(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose strings ``s`` may have a ratio of ``least`` or more.

    A ratio r of lengths n and m means at most d = (1 - r)(n + m) inserts and
    deletes. The left string is cut in up to 2d + 2 even pieces; all but d of them
    are whole in the right string, moved by no more places than there are edits. So
    d + 1 pieces of each left string are enough, and these are its rarest, which
    keeps common first names and the like from drawing everyone together.
    """
    loss = 1 - least

    def edits(n: Column, m: Column) -> Column:
        return F.floor((n + m) * loss + 1e-9).cast("int")

    def pieces(n: Column) -> Column:
        longest = F.floor(n * (2 - least) / least + 1e-9).cast("int")
        return F.least(2 * edits(n, longest) + 2, n)

    longest = F.floor(F.col("n") * (2 - least) / least + 1e-9).cast("int")
    start = lambda i: F.floor(F.col("n") * i / F.col("k")).cast("int")
    left = a.withColumn("n", F.length("s")).where("n > 0").withColumn("k", pieces(F.col("n"))).withColumn("enough", edits(F.col("n"), longest) + 1)
    left = left.select("id", "n", "s", "k", "enough", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    left = left.withColumn("from", start(F.col("i"))).withColumn("size", start(F.col("i") + 1) - F.col("from"))
    left = left.select("id", "n", "i", "enough", F.expr("substring(s, `from` + 1, size)").alias("piece"))
    often = left.groupBy("n", "i", "piece").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "i"))
    left = left.join(often, ["n", "i", "piece"]).withColumn("r", rank).where("r <= enough").select(F.col("id").alias("a"), "n", "i", "piece")
    right = b.withColumn("m", F.length("s")).where("m > 0")
    shortest = F.ceil(F.col("m") * least / (2 - least) - 1e-9).cast("int")
    most = F.floor(F.col("m") * (2 - least) / least + 1e-9).cast("int")
    right = right.select("id", "s", "m", F.explode(F.sequence(F.greatest(shortest, F.lit(1)), F.greatest(most, F.lit(1)))).alias("n"))
    right = right.withColumn("k", pieces(F.col("n"))).withColumn("d", edits(F.col("n"), F.col("m")))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    right = right.withColumn("from", start(F.col("i"))).withColumn("size", start(F.col("i") + 1) - F.col("from"))
    right = right.select("*", F.explode(F.sequence(-F.col("d"), F.col("d"))).alias("move")).withColumn("at", F.col("from") + F.col("move")).where("at >= 0 and at + size <= m")
    right = right.select(F.col("id").alias("b"), "n", "i", F.expr("substring(s, at + 1, size)").alias("piece")).distinct()
    return left.join(right, ["n", "i", "piece"]).select("a", "b").distinct()


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def _within_tokens(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs where all tokens of one name are among the other's, met at the rarest of them."""
    words = lambda df: df.select("id", F.explode(F.array_distinct(_tokens(F.col("s")))).alias("t"))
    count = words(a).unionAll(words(b)).groupBy("t").agg(F.count("*").alias("f"))
    rare = lambda df: words(df).join(count, "t").groupBy("id").agg(F.min_by("t", F.struct("f", "t")).alias("t"))
    x = rare(a).withColumnRenamed("id", "a").join(words(b).withColumnRenamed("id", "b"), "t")
    y = words(a).withColumnRenamed("id", "a").join(rare(b).withColumnRenamed("id", "b"), "t")
    return x.select("a", "b").unionAll(y.select("a", "b"))


def _near_tokens(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs that share tokens and whose token ratio may be ``least``, where either name has tokens of its own.

    A token of its own costs an edit at least, and a ratio r of lengths n and m
    allows d = (1 - r)(n + m); so n + m >= 1 / (1 - r), and neither is shorter than
    half of r / (1 - r), the lengths being within d of each other. Of a name's
    tokens at most d(its length, the longest partner) are its own or, where only the
    partner has many of its own, so few are the name's; either way one of the d + 1
    rarest tokens of one name is in the other.
    """
    loss = 1 - least
    shortest = math.floor(least / loss / 2 - 1e-9)
    words = lambda df: df.where(F.length("s") >= shortest).select("id", F.length("s").alias("n"), F.explode(F.array_distinct(_tokens(F.col("s")))).alias("t"))
    x, y = words(a), words(b)
    count = x.select("t").unionAll(y.select("t")).groupBy("t").agg(F.count("*").alias("f"))
    most = F.floor(F.col("n") * 2 * loss / least + 1e-9) + 1

    def rare(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "t"))
        return df.join(count, "t").withColumn("r", rank).where(F.col("r") <= most).select("id", "t")

    one = rare(x).withColumnRenamed("id", "a").join(y.select(F.col("id").alias("b"), "t"), "t").select("a", "b")
    return one.unionAll(x.select(F.col("id").alias("a"), "t").join(rare(y).withColumnRenamed("id", "b"), "t").select("a", "b"))


def candidate_pairs(a: DataFrame, b: DataFrame, sizes: tuple[int, int], threshold: float) -> DataFrame:
    """(a, b) keys of every pair that can reach the threshold; frames of id, s (name), email, phone, with so many rows."""
    pair = lambda key: a.where(F.col(key).isNotNull()).select(F.col("id").alias("a"), key).join(b.where(F.col(key).isNotNull()).select(F.col("id").alias("b"), key), key).select("a", "b")
    need = threshold / NAME
    if need <= PARTIAL + 1e-9:
        pairs = math.prod(sizes)
        if pairs > NESTED:
            raise ValueError(f"a threshold of {threshold} leaves {pairs} pairs of names to compare; above {PARTIAL * NAME:g} few are")
        return a.select(F.col("id").alias("a")).crossJoin(b.select(F.col("id").alias("b")))
    ways = [pair("email"), pair("phone")]
    if need <= 1 + 1e-9 and min(sizes) <= SIDE:
        # Letters tell nearly all pairs apart, at some nanoseconds each; no key does where names are made of few syllables.
        need = min(need, 1.0) - 1e-9
        ways.append(near_by_letters(a, b, sizes, a.sparkSession.sparkContext.defaultParallelism, need, TOKEN_SCALE))
        if need <= TOKEN_SCALE:
            ways.append(_within_tokens(a, b))
    elif need <= 1 + 1e-9:
        need = min(need, 1.0) - 1e-12
        ways.append(_near_strings(a, b, need))
        token = need / TOKEN_SCALE
        if token <= 1:
            ordered = lambda df: df.select("id", F.array_join(F.array_sort(_tokens(F.col("s"))), " ").alias("s"))
            ways += [_near_strings(ordered(a), ordered(b), token), _within_tokens(a, b)]
            if token < 1:
                ways.append(_near_tokens(a, b, token))
    return reduce(DataFrame.unionAll, ways).distinct()


def _with_letters(df: DataFrame) -> DataFrame:
    """With ``bag`` (how many letters fall in each of ``BAG`` classes), ``solid`` (letters), ``gaps`` (white space), and of the tokens
    ``tokens``, ``breaks`` (spaces between them) and ``again`` (whether one is repeated)."""
    name = F.coalesce("s", F.lit(""))
    solid = F.regexp_replace(name, r"\s", "")
    marks = F.transform(F.filter(F.split(solid, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(BAG)))
    bag = F.transform(F.sequence(F.lit(0), F.lit(BAG - 1)), lambda k: F.size(F.filter("__marks", lambda c: c == k)))
    rows = df.withColumns({"__marks": marks, "solid": F.length(solid), "tokens": _tokens(name)}).withColumn("bag", bag).drop("__marks")
    count = F.size("tokens")
    return rows.withColumns({"gaps": F.length(name) - F.col("solid"), "breaks": F.greatest(count - 1, F.lit(0)), "again": (count > F.size(F.array_distinct("tokens"))) | name.rlike(OTHER_SPACE)})


def score_customers(erp: DataFrame, crm: DataFrame, threshold: float = THRESHOLD, pruned: bool = True) -> DataFrame:
    """erp_key, crm_key, score of the pairs at or above the threshold."""
    side = lambda df: df.select(F.col("business_key").alias("id"), F.col("full_name").alias("s"), normal_email(F.col("email")).alias("email"), normal_phone(F.col("phone")).alias("phone"))
    a, b = side(erp), side(crm)
    sizes = (a.count(), b.count()) if pruned else (0, 0)
    few = pruned and math.prod(sizes) <= FEW
    counted = pruned and not few and min(sizes) <= SIDE
    pairs = candidate_pairs(a, b, sizes, threshold) if pruned and not few else a.select(F.col("id").alias("a")).crossJoin(b.select(F.col("id").alias("b")))
    need = threshold / NAME - 1e-9
    by_letters = pruned and not counted and need > PARTIAL
    x, y = ((_with_letters(df) if by_letters else df).transform(lambda rows: rows.select(*[F.col(c).alias(f"{side_}_{c}") for c in rows.columns])) for df, side_ in ((a, "a"), (b, "b")))
    rows = pairs.join(x, F.col("a") == F.col("a_id")).join(y, F.col("b") == F.col("b_id"))
    email = F.coalesce((F.col("a_email") == F.col("b_email")).cast("double"), F.lit(0.0))
    phone = F.coalesce((F.col("a_phone") == F.col("b_phone")).cast("double"), F.lit(0.0))
    # What lengths and signals allow, before the name is looked at.
    la, lb = F.length("a_s"), F.length("b_s")
    stretch = F.greatest(la, lb) / F.greatest(F.least(la, lb), F.lit(1))
    bound = F.when(stretch < 1.5, F.greatest(2.0 * F.least(la, lb) / F.greatest(la + lb, F.lit(1)), F.lit(TOKEN_SCALE))).when(stretch <= 8, F.lit(0.9)).otherwise(F.lit(0.6))
    rows = rows.where(NAME * bound + EMAIL * email + PHONE * phone >= threshold - 1e-9)
    # What their letters allow, for pairs that have but their names. Both ratios, of the names and of their sorted tokens,
    # need common letters; one that compares the tokens that both have with either name needs nearly all of one name.
    # Where candidates were found by letters, only these are left.
    if by_letters:
        common = F.aggregate(F.zip_with("a_bag", "b_bag", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        ratio = lambda more, n, m: 2.0 * (F.col("__common") + more) / F.greatest(n + m, F.lit(1))
        solid, gaps, tokens = ([F.col(f"{x}_{name}") for x in "ab"] for name in ("solid", "gaps", "breaks"))
        raw = ratio(F.least(*gaps), la, lb)
        by_token = ratio(F.least(*tokens), solid[0] + tokens[0], solid[1] + tokens[1])
        share = need / TOKEN_SCALE / (2 - need / TOKEN_SCALE)
        inside = F.arrays_overlap("a_tokens", "b_tokens") & (F.col("__common") >= F.least(*[share * s - (1 - share) * t for s, t in zip(solid, tokens)]) - 1e-6)
        alone = (email + phone == 0) & ~F.col("a_again") & ~F.col("b_again")
        rows = rows.withColumn("__common", F.when(alone, common))
        rows = rows.where(~alone | (raw >= need) | (TOKEN_SCALE * by_token >= need) | inside)
    rows = rows.withColumn("score", (NAME * name_similarity("a_s", "b_s") + EMAIL * email) + PHONE * phone)
    return rows.where(F.col("score") >= threshold).select(F.col("a").alias("erp_key"), F.col("b").alias("crm_key"), "score")


def ambiguous_candidates(pairs: DataFrame) -> DataFrame:
    """source_system, business_key, candidate, score: the top candidates of every record that has some and no match.

    ``pairs`` as ``mutual_top`` gives them; a row for each candidate, so ties of any number are held by no task.
    """
    out = []
    for system, key, other in (("erp", "erp_key", "crm_key"), ("crm", "crm_key", "erp_key")):
        best = pairs.groupBy(key).agg(F.max("score").alias("__top"), F.bool_or("matched").alias("__done")).where("not __done")
        tops = pairs.join(best, key).where(F.col("score") == F.col("__top"))
        out.append(tops.select(F.lit(system).alias("source_system"), F.col(key).alias("business_key"), F.col(other).alias("candidate"), "score"))
    return out[0].unionAll(out[1])


def _entries(entity: str, matched: DataFrame, orphans_erp: DataFrame, orphans_crm: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = matched.select("erp_key", "crm_key").unionAll(orphans_erp.select("erp_key", none.alias("crm_key"))).unionAll(orphans_crm.select(none.alias("erp_key"), "crm_key"))
    return rows.select(F.lit(entity).alias("entity_type"), canonical_id(F.lit(entity), F.col("erp_key"), F.col("crm_key")).alias("canonical_id"), "erp_key", "crm_key")


def _ambiguous(entity: str, rows: DataFrame) -> DataFrame:
    """Quarantine entries of clean rows."""
    kept = [c for c in rows.columns if c not in (SEQ, "matched")]
    return rows.select(F.lit(entity).alias("entity_type"), "source_system", F.lit("ambiguous_match").alias("reason_code"), F.lit("resolution").alias("stage"), as_json(rows, kept).alias("original_data"))


def outcomes(entity: str, erp: DataFrame, crm: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crosswalk, quarantine) of pairs (erp_key, crm_key, matched) at or above the threshold."""
    matched = pairs.where("matched")
    entries, bad = {}, []
    for system, df in (("erp", erp), ("crm", crm)):
        key = f"{system}_key"
        seen = pairs.groupBy(F.col(key).alias("business_key")).agg(F.bool_or("matched").alias("matched"))
        rows = df.join(seen, "business_key", "left")
        entries[system] = rows.where("matched is null").select(F.col("business_key").alias(key))
        bad.append(_ambiguous(entity, rows.where("matched = false").select(*df.columns)))
    return _entries(entity, matched, entries["erp"], entries["crm"]), bad[0].unionAll(bad[1])


def resolve_customers(erp: DataFrame, crm: DataFrame, threshold: float = THRESHOLD, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(crosswalk, quarantine). ``scored``: pairs scored before at this threshold or a lower one.

    Pairs are written as soon as they are scored: what follows reads them several times.
    """
    pairs = kept_scores(erp, crm, threshold) if scored is None else scored.where(F.col("score") >= threshold)
    return outcomes("customer", erp, crm, mutual_top(pairs, "erp_key", "crm_key", "score"))


def kept_scores(erp: DataFrame, crm: DataFrame, threshold: float) -> DataFrame:
    return Workspace(erp.sparkSession, "customers").keep(score_customers(erp, crm, threshold), "scored")


# -- children of resolved parents ----------------------------------------------


def resolve_children(entity: str, erp: DataFrame, crm: DataFrame, parents: DataFrame, parent: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(crosswalk, quarantine) of rows that must agree on ``values`` under a matched parent."""
    known = parents.where("erp_key is not null and crm_key is not null")
    both = {}
    for system, df in (("erp", erp), ("crm", crm)):
        link = known.select(F.col(f"{system}_key").alias(parent), F.col("crm_key").alias("__p"))
        both[system] = df.join(link, parent, "left")
    group = ["__p", *values]
    count = lambda s: both[s].where("__p is not null").groupBy(*group).agg(F.count("*").alias(f"__n_{s}"), F.min("business_key").alias(f"{s}_key"))
    met = count("erp").join(count("crm"), group)
    sole = (F.col("__n_erp") == 1) & (F.col("__n_crm") == 1)
    entries, bad = {}, []
    for system, df in (("erp", erp), ("crm", crm)):
        rows = both[system].join(met.select(*group, sole.alias("matched")), group, "left")
        entries[system] = rows.where("matched is null").select(F.col("business_key").alias(f"{system}_key"))
        bad.append(_ambiguous(entity, rows.where("matched = false").select(*df.columns)))
    return _entries(entity, met.where(sole), entries["erp"], entries["crm"]), bad[0].unionAll(bad[1])


def resolve_invoices(erp: DataFrame, crm: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolve_children("invoice", erp, crm, customers.where("entity_type = 'customer'"), "customer_business_key", ["issue_date", "currency", "amount"])


def resolve_payments(erp: DataFrame, crm: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolve_children("payment", erp, crm, invoices.where("entity_type = 'invoice'"), "invoice_business_key", ["payment_date"])
