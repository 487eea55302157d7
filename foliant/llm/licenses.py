"""Operator 1: licence scans, in DataFrame functions only.

Texts are normalised (lower case, runs of other characters than letters and digits
become a space).  Units are the whole text, each of its lines, and windows of its words
that are as long as a template, so licences that are wrapped over lines, or stand in
other prose, are compared whole too.  A unit matches a template by the Dice coefficient
of their sets of word bigrams.

Pruning.  A coefficient of at least t needs |A| between |B| t / (2 - t) and
|B| (2 - t) / t, so a unit meets only the templates in a list by its number of bigrams,
and units with more distinct words than any list allows are dropped before their bigrams are
made.  Texts and lines are looked at only if they hold one of some words that no match can go
without (``unit_words``; the SQL asks for parts of words, ``unit_keys``); it takes one pass over
a text's words, whatever their number.  Windows begin where one of up to
``ANCHORS`` bigrams of a template with such a word, spread over it, stands in the text, less its place
in the template.  Templates and lists are constants of the plan: there is no join and no
shuffle.

A row is a unit with a match: its best template, ties to the first by name, or the window's
own template.  Null and empty texts, and
units of one word, match nothing.  Very long texts are read whole.  Repeated rows each
give theirs.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text

THRESHOLD = 0.8

#: Grants and notices by which well-known licences are given.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-line": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-line": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

#: Whole standard texts, without title or copyright lines of the short ones.
TEMPLATES |= {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def bigrams_of(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def sizes_allowed(n: int, threshold: float) -> range:
    """Numbers of bigrams that allow a coefficient of ``threshold`` with n of them."""
    return range(*(k for k in _bounds(n, threshold)))


def _bounds(n: int, t: float) -> tuple[int, int]:
    fits = [k for k in range(1, int(n * (2 - t) / t) + 2) if 2.0 * min(k, n) / (k + n) >= t]
    return fits[0], fits[-1] + 1


#: Parts of words, one of which stands in every licence.
KEYS = ["copyright", "licen", "permission", "software"]
ANCHORS = 8


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def needed(n: int, threshold: float) -> int:
    """Bigrams of a template of n that any match has."""
    return next(c for c in range(n + 1) if 2.0 * c / (c + n) >= threshold)


def keys_of(templates: dict[str, str]) -> list[str]:
    """``KEYS``, and the longest word of each template that has none of them."""
    rest = [_words(t) for t in templates.values() if not any(k in t.lower() for k in KEYS)]
    return sorted({*KEYS, *(max(w, key=lambda x: (len(x), x)) for w in rest if w)})


def unit_keys(grams: list[list[str]], threshold: float, keys: list[str]) -> list[str]:
    """``keys`` and as many words more that every unit with a match holds one of them.

    A match has ``needed`` bigrams of its template; so many never go without a key.  Words that
    cover most of what does are added first, long ones before short ones.
    """
    found = list(keys)
    for own in sorted(grams, key=len, reverse=True):
        bare = [g for g in own if not any(k in g for k in found)]
        while len(bare) >= needed(len(own), threshold):
            words = sorted({w for g in bare for w in g.split(" ")})
            best = max(words, key=lambda w: (sum(w in g for g in bare) * max(0, len(w) - 3), len(w), w))
            found.append(best)
            bare = [g for g in bare if best not in g]
    return sorted(found)


#: Words of any prose: they tell little, so others are asked for where those do.
EVERYDAY = frozenset(
    "a all an and any are as at be been by can de do does each for from had has have he here if in into is it its may mit must no not of on one only or other our "
    "out own shall she so some such than that the their them then there these they this those to under up use used was we were what when where which who will with "
    "work would you your".split()
)


def unit_words(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which every unit with a match holds one: of each template, fewer bigrams are
    without any than a match has.  Those that stand in most bigrams first."""
    found: set[str] = set()
    for own in sorted(grams, key=len):
        bare = [g for g in (set(x.split(" ")) for x in own) if not g & found]
        while len(bare) >= needed(len(own), threshold):
            times = Counter(w for g in bare for w in g)
            best = max(times, key=lambda w: (w not in EVERYDAY, times[w], len(w), w))
            found.add(best)
            bare = [g for g in bare if best not in g]
    return sorted(found)


def anchors(text: str, keys: list[str], most: int = ANCHORS) -> list[tuple[str, int]]:
    """Bigrams that hold a key, with their first places in a template, spread over it; those that stand once if any do."""
    words = _words(text)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    held = [k for k, g in enumerate(grams) if grams.index(g) == k and any(x in g for x in keys)]
    held = [k for k in held if grams.count(grams[k]) == 1] or held
    step = max(1.0, len(held) / most)
    return [(grams[k], k) for k in (held[int(n * step)] for n in range(min(most, len(held))))]


def _plan(templates: dict[str, str], threshold: float) -> tuple[list, dict[int, list[int]], list[str], dict[str, list[tuple[int, int]]], list[int]]:
    """Templates with their bigrams, lists by size, keys, anchors with (template, place), words of templates."""
    grams = sorted((name, own) for name, text in templates.items() if (own := bigrams_of(text)))
    by_size: dict[int, list[int]] = {}
    for k, (_, own) in enumerate(grams):
        for n in sizes_allowed(len(own), threshold):
            by_size.setdefault(n, []).append(k)
    keys, at = keys_of(templates), {}
    for k, (name, _) in enumerate(grams):
        for gram, place in anchors(templates[name], keys):
            at.setdefault(gram, []).append((k, place))
    return grams, by_size, unit_keys([own for _, own in grams], threshold, keys), at, [len(_words(templates[name])) for name, _ in grams]


def _constant(value: object, kind: str) -> Column:
    """Folds to a literal when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit (0 the whole text, n its n-th line, -1 a window), first_word (of a
    window, from 0), license, n_bigrams, common, dice."""
    grams, by_size, _, at, sizes = _plan(templates or TEMPLATES, threshold)
    most = max(by_size, default=0)
    known = _constant([{"license": name, "own": own} for name, own in grams], "array<struct<license:string,own:array<string>>>")
    allowed = _constant([by_size.get(n, []) for n in range(most + 1)], "array<array<int>>")
    # a window's anchor holds a key in one of its words
    anchored = {next(w for w in gram.split(" ") if any(k in w for k in keys_of(templates or TEMPLATES))) for gram in at}
    asked = _constant(sorted({*unit_words([own for _, own in grams], threshold), *anchored}), "array<string>")

    # distinct bigrams of two words or more
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1))))
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n")
    # each explode also keeps what it makes from being made again by what follows
    split = lambda u: F.array_remove(F.split(u, " "), "")
    plains = id_and_text(docs, id_col, text_col).select("doc_id", F.explode(F.array(plain)).alias("plain"))
    chosen = plains.select("doc_id", "plain", F.explode(F.array(split(F.translate("plain", "\n", " ")))).alias("w")).where(F.arrays_overlap("w", asked))
    # words of the whole text, then of its lines; null where none of the words asked for stands
    of_lines = F.transform(F.transform(F.split("plain", "\n"), split), lambda u: F.when(F.arrays_overlap(u, asked), u))
    units = chosen.select("doc_id", F.explode(F.array(F.concat(F.array("w"), of_lines))).alias("u"))

    # distinct words are at most one more than distinct bigrams: a cheaper bound than making those
    fits = lambda w: (F.size(w) > 1) & (F.size(F.array_distinct(w)) <= most + 1)
    numbers = F.transform("u", lambda w, i: F.struct(F.when(fits(w), i).alias("unit"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("s")))
    w, least = F.get("u", F.lit(0)), _constant([needed(len(own), threshold) for _, own in grams], "array<int>")
    keys, places = _constant(list(at), "array<string>"), _constant([[{"k": k, "place": n} for k, n in x] for x in at.values()], "array<array<struct<k:int,place:int>>>")
    lengths = _constant(sizes, "array<int>")
    found = F.transform(w, lambda a, i: F.struct(i.alias("i"), F.coalesce(F.array_position(keys, F.concat(a, F.lit(" "), F.get(w, i + 1))), F.lit(0)).cast("int").alias("key")))
    starts = F.transform(F.filter(found, lambda x: x["key"] > 0), lambda x: F.transform(F.get(places, x["key"] - 1), lambda y: F.struct(F.lit(-1).alias("unit"), y["k"].alias("k"), F.greatest(x["i"] - y["place"], F.lit(0)).alias("s"))))
    windows = F.filter(F.array_distinct(F.flatten(starts)), lambda x: F.least(F.size(w) - x["s"], F.get(lengths, x["k"])) > F.get(least, x["k"]))
    each = units.select("doc_id", "u", F.explode(F.concat(F.filter(numbers, lambda x: x["unit"].isNotNull()), windows)).alias("x"))

    words = F.when(F.col("x.k").isNull(), F.get("u", F.col("x.unit"))).otherwise(F.slice(w, F.col("x.s") + 1, F.get(lengths, F.col("x.k"))))
    sized = each.select("doc_id", "x", F.explode(F.array(pairs(words))).alias("b")).withColumn("n_bigrams", F.size("b"))
    lists = F.get(allowed, F.col("n_bigrams"))
    sized = sized.withColumn("with", F.when(F.col("x.k").isNull(), lists).otherwise(F.filter(lists, lambda k: k == F.col("x.k")))).where(F.size("with") > 0)

    def rate(k):
        own = F.get(known, k)
        common = F.size(F.array_intersect(own["own"], F.col("b")))
        return F.struct((-2.0 * common / (F.col("n_bigrams") + F.size(own["own"]))).alias("less"), own["license"].alias("license"), common.alias("common"))

    return (
        sized.select("doc_id", "x", "n_bigrams", F.explode(F.array(F.array_min(F.transform("with", rate)))).alias("best"))
        .where(F.col("best.less") <= -threshold)
        .select("doc_id", "x.unit", F.col("x.s").alias("first_word"), "best.license", "n_bigrams", "best.common", (-F.col("best.less")).alias("dice"))
    )


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same over ``documents``, for DuckDB."""
    grams, _, key_words, at, sizes = _plan(TEMPLATES, threshold)
    holds = lambda text: " or ".join(f"contains({text}, '{k}')" for k in key_words)
    own = ", ".join(f"('{name}', {own!r}, {n})" for (name, own), n in zip(grams, sizes, strict=True))
    places = ", ".join(f"('{grams[k][0]}', '{gram}', {n})" for gram, x in at.items() for k, n in x)
    return rf"""
with t(license, own, n_words) as (values {own}),
a(license, gram, place) as (values {places}),
plain as (
  select doc_id, row_number() over () as r, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') as p from documents where {holds("lower(text)")}
), u as (
  select doc_id, r, 0 as unit, translate(p, chr(10), ' ') as u from plain
  union all
  select doc_id, r, cast(generate_subscripts(l, 1) as integer) as unit, unnest(l) as u from (select doc_id, r, string_split(p, chr(10)) as l from plain)
), w as (
  select doc_id, r, unit, list_filter(string_split(u, ' '), lambda x: x <> '') as w from u where unit = 0 or {holds("u")}
), spot as (
  select r, license, greatest(i - 1 - place, 0) as s
  from (select r, w, unnest(range(1, len(w))) as i, unnest(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) as gram from w where unit = 0 and len(w) > 1) join a using (gram)
  group by all
), x as (
  select doc_id, unit, cast(null as bigint) as s, cast(null as varchar) as own_license, w, row_number() over () as n from w where len(w) > 1
  union all
  select doc_id, -1, s, license, w[s + 1:s + n_words], -row_number() over () from spot join t using (license) join w using (r) where unit = 0 and least(len(w) - s, n_words) > 1
), b as (
  select n, doc_id, unit, s, own_license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from x
), s as (
  select n, doc_id, unit, s, t.license, cast(len(b) as integer) as n_bigrams, cast(len(list_intersect(b, own)) as integer) as common, len(own) as n_own
  from b join t on 2.0 * least(len(b), len(own)) / (len(b) + len(own)) >= {threshold} and (own_license is null or own_license = t.license)
), d as (
  select n, doc_id, unit, s, license, n_bigrams, common, 2.0::double * common / (n_bigrams + n_own) as dice from s
), q as (
  select *, row_number() over (partition by n order by dice desc, license) as k from d
)
select doc_id, unit, cast(s as integer) as first_word, license, n_bigrams, common, dice from q where k = 1 and dice >= {threshold}
"""
