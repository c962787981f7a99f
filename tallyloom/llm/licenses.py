"""Licence scans by Dice coefficient over word bigrams.

Units of a text are its lines and the whole text. A unit is normalised (lower
case, runs of anything but letters, digits and dots become one space, a dot at
a word's end falls away) and compared to each licence template by the Dice
coefficient of the sets of word bigrams, 2 * common / (a + b); a lone word
counts as one bigram of itself. A coefficient of t needs a set size between
``b * t / (2 - t)`` and ``b * (2 - t) / t``, so a unit is first held against
these bounds, and only against the templates that they leave. Before that, a
prefix filter: a match leaves out few of a template's bigrams, so it holds one
of any larger choice of them; a unit without any word of such choices is not
normalised at all, and runs (see below) are looked for only in texts with enough
different words of one template. Everything is one narrow DataFrame expression: no join, no
shuffle.

Lines are not how licences are laid out, so ``runs`` adds units: a run is any
stretch of consecutive pieces, which are the lines cut at sentence ends, and it
is held against the statements, the standard notices and the full texts. For
each template and first piece the best end is found in one pass, by counting the
bigrams that do not occur earlier in the run. A run counts if it shares more
bigrams with its template than any matched line or whole text that it overlaps;
of overlapping runs of one template the best coefficient counts, of those of
several templates the most shared bigrams. The unit of a run is its first line.

Defined results: a null or empty text has no match; a template found in several
units of a text counts once for each line; among templates with equal
coefficients for one unit, the first by name wins; repeated rows are each
scanned; columns of the input named like an output are replaced by it.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.7
LOWERED = "__lowered"

#: Licence statements and notices: name and text. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}


_DISTRIBUTED = " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details. You should have received a copy of the GNU {1} General Public License along with {2}."
_FREE = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."

#: Standard notices that go into each file: name and text. Fixed values.
NOTICES = {
    "AGPL-3.0-notice": _FREE.format("This program", ":", "Affero", ",", "3") + _DISTRIBUTED.format("This program", "Affero", "this program"),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-notice": _FREE.format("This program", ";", "", ";", "2") + _DISTRIBUTED.format("This program", "", "this program"),
    "GPL-3.0-notice": _FREE.format("This program", ":", "", ",", "3") + _DISTRIBUTED.format("This program", "", "this program"),
    "LGPL-2.1-notice": _FREE.format("This library", ";", "Lesser", ";", "2.1") + _DISTRIBUTED.format("This library", "Lesser", "this library"),
    "LGPL-3.0-notice": _FREE.format("This library", ":", "Lesser", ",", "3") + _DISTRIBUTED.format("This library", "Lesser", "this library"),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: Where a line is cut into sentences.
SENTENCE_END = "(?<=[.!?][\"')\\]]?)\\s+"


@functools.cache
def wide_templates() -> dict[str, str]:
    """The standard notices, and the full texts of the folder beside this file."""
    return NOTICES | {f"{p.stem}-text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.sub(r"[^a-z0-9.]+", " ", text.lower()).split(" ")]
    words = [w.rstrip(".") for w in words]
    words = [w for w in words if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


#: ``[^a-z0-9.]+`` by what it takes: Java's matcher is some ten times slower with the class of what it leaves out.
_BETWEEN = r"[\x00-\x2d/:-`{-\x{10ffff}]+"


def _words(unit: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(unit), _BETWEEN, " "), r"\.+(?= |$)", "")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and greatest set size that can reach the threshold with a set of ``n``."""
    fits = [m for m in range(1, int(2 * n / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n)]
    return min(fits), max(fits)


def _telling_words(table: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every match of any template contains one."""
    need = {}
    for name, grams in table.items():
        # Common bigrams c of a match with a set of m: 2c >= t (m + b) and m >= low.
        need[name] = len(grams) - _least_common(len(grams), threshold) + 1
    chosen: list[str] = []
    holds = lambda w, g: w in g.split(" ")
    while True:
        left = {n: [g for g in grams if not any(holds(w, g) for w in chosen)] for n, grams in table.items()}
        open_ = {n for n, grams in table.items() if len(grams) - len(left[n]) < need[n]}
        if not open_:
            return chosen
        words = sorted({w for n in open_ for g in left[n] for w in g.split(" ")})
        chosen.append(max(words, key=lambda w: (min(len(w), 7), sum(any(holds(w, g) for g in left[n]) for n in open_), w)))


def _least_common(n: int, threshold: float) -> int:
    """Least number of bigrams that a match shares with a template of ``n``."""
    low, _ = _size_bounds(n, threshold)
    return next(c for c in range(1, n + 1) if 2 * c >= threshold * (max(low, c) + n) - 1e-9)


def _least_words(grams: list[str], common: int) -> int:
    """Least number of different words in any ``common`` of the bigrams."""
    firsts, held = sorted(Counter(g.split(" ")[0] for g in grams).values(), reverse=True), 0
    for k, n in enumerate(firsts, 1):
        held += n
        if held >= common:
            return k
    return len(firsts)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once though lambdas within use it often."""
    return F.transform(F.array(value), use).getItem(0)


def _listed(items: list[str]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit("\n".join(items)), "\n")


def _apart(rows: Column, kind: str) -> Column:
    """Of runs in their order, those that overlap no run taken before."""
    taken = lambda acc, r: F.exists(acc, lambda q: (q["s"] <= r["e"]) & (r["s"] <= q["e"]))
    return F.aggregate(rows, F.array().cast(kind), lambda acc, r: F.when(taken(acc, r), acc).otherwise(F.concat(acc, F.array(r)).cast(kind)))


def _runs(text: Column, found: Column, table: dict[str, list[str]], threshold: float) -> Column:
    """Matches of runs of pieces as (unit, name, dice); ``found`` has the matches of lines and the whole text."""
    kind = "array<struct<c:int,dice:double,name:string,s:int,e:int,l0:int,l1:int>>"
    sizes = {name: _size_bounds(len(g), threshold)[1] for name, g in table.items()}
    known = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("b"), F.lit(sizes[name]).alias("high"), F.lit(_least_common(len(g), threshold)).alias("need"), _listed(g).alias("grams"))
        for name, g in table.items()])
    pieces = F.flatten(F.transform(F.split(text, "\n"), lambda x, l: F.transform(F.split(x, SENTENCE_END), lambda p: F.struct(l.alias("l"), _words(p).alias("w")))))
    words = F.flatten(F.transform(F.filter(pieces, lambda a: F.size(a["w"]) > 0), lambda a, k: F.transform(a["w"], lambda w, x: F.struct(w.alias("w"), k.alias("k"), x.alias("x"), a["l"].alias("l")))))

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        both = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("g"), a["k"].alias("s"), b["k"].alias("e"), a["x"].alias("x"), a["l"].alias("l0"), b["l"].alias("l1")))
        return F.transform(both, lambda r, p: F.struct(r["g"].alias("g"), p.alias("p"), *[r[c].alias(c) for c in ("s", "e", "x", "l0", "l1")]))

    def with_earlier(by_gram: Column) -> Column:
        """The bigrams in place, each with the piece where it occurred last before, or -1, and whether it is its piece's last."""
        n = F.greatest(F.size(by_gram) - 1, F.lit(0))
        before = F.concat(F.array(F.lit(None).cast("struct<g:string,p:int,s:int,e:int,x:int,l0:int,l1:int>")), F.slice(by_gram, F.lit(1), n))
        rows = F.zip_with(by_gram, before, lambda a, b: F.when(a.isNotNull(), F.struct(a["p"].alias("p"), *[a[c].alias(c) for c in ("g", "s", "e", "x", "l0", "l1")], F.when(a["g"] == b["g"], b["s"]).otherwise(-1).alias("prev"))))
        rows = F.array_sort(F.filter(rows, lambda r: r.isNotNull()))
        following = lambda r: F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))
        return _bound(rows, lambda r: F.zip_with(r, following(r), lambda a, b: F.struct(*[a[c].alias(c) for c in ("p", "g", "s", "e", "x", "l0", "l1", "prev")], F.coalesce(a["e"] != b["e"], F.lit(True)).alias("last"))))

    def best_from(start: Column, marked: Column, t: Column) -> Column:
        zero = F.struct(F.lit(0).alias("m"), F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(0).alias("e"), F.lit(0).alias("l1"))

        def step(acc: Column, r: Column) -> Column:
            fresh = (r["prev"] < start["s"]).cast("int")
            m, n = acc["m"] + fresh, acc["n"] + fresh * r["hit"].cast("int")
            dice = F.when(r["last"] & (m <= t["high"]), 2.0 * n / (m + t["b"])).otherwise(0.0)
            better = dice > acc["dice"]
            new = F.struct(m.alias("m"), n.alias("n"), F.when(better, n).otherwise(acc["c"]).alias("c"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, r["e"]).otherwise(acc["e"]).alias("e"), F.when(better, r["l1"]).otherwise(acc["l1"]).alias("l1"))
            return F.when(acc["m"] > t["high"], acc).otherwise(new)

        rest = F.slice(marked, start["at"] + 1, F.size(marked))
        return F.aggregate(rest, zero, step, lambda a: F.struct(a["c"].alias("c"), a["dice"].alias("dice"), t["name"].alias("name"), start["s"].alias("s"), a["e"].alias("e"), start["l0"].alias("l0"), a["l1"].alias("l1")))

    def of_template(t: Column, rows: Column, here: Column, old: Column) -> Column:
        common = F.array_intersect(here, t["grams"])
        marked = _bound(common, lambda h: F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in ("p", "s", "e", "x", "l0", "l1", "prev", "last")], F.array_contains(h, r["g"]).alias("hit"))))

        def candidates(m: Column) -> Column:
            starts = F.array_distinct(F.transform(F.filter(m, lambda r: r["hit"]), lambda r: F.struct(r["s"].alias("s"), (r["p"] - r["x"]).alias("at"), r["l0"].alias("l0"))))
            every = F.filter(F.transform(starts, lambda s: best_from(s, m, t)), lambda r: r["dice"] >= threshold)
            return F.filter(every, lambda r: ~F.exists(old, lambda f: (f["common"] >= r["c"]) & ((f["unit"] == -1) | f["unit"].between(r["l0"], r["l1"]))))

        ordered = F.transform(F.array_sort(F.transform(_bound(marked, candidates), lambda r: F.struct((-r["dice"]).alias("a"), (-r["s"]).alias("b"), r.alias("r")))), lambda x: x["r"])
        return _apart(ordered, kind)

    def of_text(rows: Column, old: Column) -> Column:
        here = F.array_distinct(F.transform(rows, lambda r: r["g"]))
        each = _bound(here, lambda h: F.flatten(F.transform(F.filter(known, lambda t: F.size(F.array_intersect(h, t["grams"])) >= t["need"]), lambda t: of_template(t, rows, h, old))))
        ordered = F.transform(F.array_sort(F.transform(each, lambda r: F.struct((-r["c"]).alias("a"), (-r["dice"]).alias("b"), r["name"].alias("n"), r["s"].alias("s"), r.alias("r")))), lambda x: x["r"])
        return F.transform(_apart(ordered, kind), lambda r: F.struct(r["l0"].alias("unit"), r["name"].alias("name"), r["dice"].alias("dice")))

    rows = _bound(words, lambda w: _bound(F.array_sort(pairs(w)), with_earlier))
    return _bound(found, lambda old: _bound(rows, lambda r: of_text(r, old)))


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, runs: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``licences``: array of (unit, name, dice); unit is a line's number from 0, or -1 for the whole text of many lines.

    ``runs`` has further templates, with which and the others runs of pieces are compared.
    """
    table = {name: template_bigrams(text) for name, text in sorted((templates or TEMPLATES).items())}
    table = {name: grams for name, grams in table.items() if grams}
    sizes = {name: _size_bounds(len(g), threshold) for name, g in table.items()}
    low, high = min(a for a, _ in sizes.values()), max(b for _, b in sizes.values())

    told = _telling_words(table, threshold)

    def tells(text: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in told])

    lines = F.split(F.col(text_col), "\n")
    units = F.transform(lines, lambda x, i: F.struct(i.alias("unit"), x.alias("text")))
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("unit"), F.translate(F.col(text_col), "\n", " ").alias("text")))).otherwise(F.array().cast("array<struct<unit:int,text:string>>"))
    candidates = F.filter(F.concat(units, whole), lambda u: tells(F.lower(u["text"])))
    sets = F.transform(candidates, lambda u: F.struct(u["unit"].alias("unit"), _bound(_words(u["text"]), _bigrams).alias("grams")))
    sets = F.filter(sets, lambda u: F.size(u["grams"]).between(low, high))

    def match(u: Column) -> Column:
        scored = []
        for name, grams in table.items():
            a, b = sizes[name]
            n = F.size(u["grams"])
            common = F.size(F.array_intersect(u["grams"], F.array(*[F.lit(g) for g in grams])))
            scored.append(F.when(n.between(a, b), _bound(common, lambda c: F.struct((2.0 * c / (n + len(grams))).alias("dice"), F.lit(name).alias("name"), c.alias("common")))))
        scored = F.filter(F.array(*scored), lambda s: s["dice"] >= threshold)
        top = F.aggregate(scored, F.lit(None).cast("struct<dice:double,name:string,common:int>"), lambda acc, s: F.when(acc.isNull() | (s["dice"] > acc["dice"]), s).otherwise(acc))
        return _bound(top, lambda t: F.struct(u["unit"].alias("unit"), t["name"].alias("name"), t["dice"].alias("dice"), t["common"].alias("common")))

    found = F.filter(F.transform(sets, match), lambda m: m["name"].isNotNull())
    none = F.array().cast("array<struct<unit:int,name:string,dice:double,common:int>>")
    rows = docs.drop("licences", LOWERED).withColumn(LOWERED, F.lower(text_col))
    told_any = tells(F.col(LOWERED))
    found = F.when(told_any, F.coalesce(found, none)).otherwise(none)
    shown = lambda rows: F.transform(rows, lambda m: F.struct(m["unit"].alias("unit"), m["name"].alias("name"), m["dice"].alias("dice")))
    if runs is None:
        return rows.withColumn("licences", shown(found)).drop(LOWERED)
    wide = {name: grams for name, text in sorted(runs.items()) if (grams := template_bigrams(text))}
    known = [(sorted({w for g in grams for w in g.split(" ")}), _least_words(grams, _least_common(len(grams), threshold))) for grams in (table | wide).values()]
    held = F.array_intersect(_words(F.col(text_col)), _listed(sorted({w for words, _ in known for w in words})))
    needs = F.array(*[F.struct(F.lit(n).alias("least"), _listed(words).alias("words")) for words, n in known])
    enough = lambda h: F.exists(needs, lambda t: (F.size(h) >= t["least"]) & (F.size(F.array_intersect(h, t["words"])) >= t["least"]))
    both = lambda old: F.concat(shown(old), _runs(F.col(text_col), old, table | wide, threshold))
    return rows.withColumn("licences", F.when(_bound(held, enough), _bound(found, both)).otherwise(shown(found))).drop(LOWERED)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: matches, the names found, and the best coefficient."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, runs=wide_templates())
    names = F.array_sort(F.array_distinct(F.col("licences.name")))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licence_names"),
        F.round(F.coalesce(F.array_max("licences.dice"), F.lit(0.0)), 6).alias("best_dice"))


def _sql() -> str:
    rows = ", ".join("('{}', [{}], {}, {})".format(n, ", ".join("'" + g.replace("'", "''") + "'" for g in template_bigrams(t)), *_size_bounds(len(template_bigrams(t)), THRESHOLD)) for n, t in sorted(TEMPLATES.items()))
    return f"""
with template(name, grams, low, high) as (values {rows}),
unit as (
  select doc_id, rid, unnest(list_concat(lines, case when len(lines) > 1 then [replace(text, chr(10), ' ')] else [] end)) as line,
    unnest(range(len(lines) + case when len(lines) > 1 then 1 else 0 end)) as unit
  from (select doc_id, text, row_number() over () as rid, string_split(text, chr(10)) as lines from documents)),
word as (
  select doc_id, rid, unit, list_filter(string_split(regexp_replace(regexp_replace(lower(line), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' '), lambda w: w <> '') as w
  from unit),
gram as (
  select doc_id, rid, unit, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as g from word),
pair as (
  select doc_id, rid, unit, name, 2.0 * len(list_intersect(g, grams))::double / (len(g) + len(grams)) as dice
  from gram join template on len(g) between low and high),
hit as (
  select doc_id, rid, unit, arg_max(name, dice) as any_name, max(dice) as dice from pair where dice >= {THRESHOLD} group by all),
named as (
  select h.doc_id, h.rid, h.unit, h.dice, min(p.name) as name from hit h join pair p on h.rid = p.rid and h.unit = p.unit and p.dice = h.dice group by all),
doc as (select doc_id, row_number() over () as rid from documents)
select d.doc_id, count(n.name)::bigint as n_matches, coalesce(string_agg(distinct n.name, ',' order by n.name), '') as licence_names, round(coalesce(max(n.dice), 0.0), 6) as best_dice
from doc d left join named n on d.rid = n.rid group by d.rid, d.doc_id
"""


ORACLE_SQL = _sql()
