"""Licence scans: passages against licence templates by Dice coefficient over word bigrams.

A passage is a line, a paragraph (lines up to a blank line) or the whole text. Passages and templates
are normalised to lower-case words of letters and digits, and compared as sets of word bigrams. Two
sets of sizes a and b can reach a coefficient t only if b lies between a t / (2 - t) and
a (2 - t) / t; templates outside are never compared. All of it is one expression on a row, with DataFrame
functions only: nothing is shuffled.

Windows find a template wherever it stands in the text, over blank lines and inside a line. A window is
any run of words up to (2 - t) / t times the template's length; the best one begins and ends with a
bigram of the template, so only those are compared. They need b t / (2 - t) of its bigrams in so many
words, else a beginning is passed over. Bigrams of the template count once in a window, others each
time. The best window of each template is kept, unless it lies in the one of a larger template.
The licence is that of the best passage or window; its coefficient that of its best passage, or of its
window if no passage matches.

Defined cases: null and empty texts, and passages of fewer than two words, match nothing. Among equal
coefficients the template first in name order wins. Repeated rows each get their row. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# The wording of licence notices and licence texts in common use.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-line": "This software is released under the BSD License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs(tokens: Column) -> Column:
    """Hashes of neighbouring words in order; none for fewer than two words."""
    hashes = F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(tokens) > 1, hashes).otherwise(F.array().cast("array<bigint>"))


def bigrams(tokens: Column) -> Column:
    """Distinct hashes of neighbouring words."""
    return F.array_distinct(pairs(tokens))


def _template_pairs(docs: DataFrame, templates: dict[str, str]) -> list[tuple[str, list[int]]]:
    """The templates' bigrams in order, by name; as many rows as templates are given."""
    rows = docs.sparkSession.createDataFrame(sorted(templates.items()), "name string, text string")
    listed = rows.select("name", pairs(words(F.col("text"))).alias("pairs")).where(F.size("pairs") > 0)
    return [(r["name"], r["pairs"]) for r in sorted(listed.collect(), key=lambda r: r["name"])]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _window(grams: Column, name: str, template: list[int], least: float) -> Column:
    """The best window of a template as (word, last, size, license, dice), or null; ``grams`` are the
    text's bigrams in order."""
    own = sorted(set(template))
    need = math.ceil(len(own) * least / (2 - least) - 1e-9)
    span = math.floor(len(template) * (2 - least) / least + 1e-9)
    known = F.lit(own).cast("array<bigint>")

    def numbered(hits: Column) -> Column:
        """Each hit's place, and the number of the hit before it with the same bigram (-1 for none)."""

        def one(keys: Column) -> Column:
            def back(m: Column, key: Column) -> Column:
                before = F.slice(keys, F.greatest(m - span, F.lit(0)) + 1, F.least(m, F.lit(span)))
                return F.array_position(F.reverse(before), key).cast("int")

            return F.transform(
                hits,
                lambda h, m: F.struct(
                    h["at"].alias("at"),
                    _let(back(m, h["key"]), lambda d: F.when(d > 0, m - d).otherwise(-1)).alias("again"),
                ),
            )

        return _let(F.transform(hits, lambda h: h["key"]), one)

    def from_hit(hits: Column, k: Column, first: Column) -> Column:
        def step(acc: Column, h: Column) -> Column:
            new = F.when(h["again"] < k, 1).otherwise(0)
            shared, count = acc["shared"] + new, acc["count"] + 1
            size = h["at"] - first + 1 - (count - shared)
            dice = F.lit(2.0) * shared / (size + len(own))
            better = dice > acc["dice"]
            return F.when(
                h["at"] - first < span,
                F.struct(
                    shared.alias("shared"),
                    count.alias("count"),
                    F.when(better, dice).otherwise(acc["dice"]).alias("dice"),
                    F.when(better, h["at"]).otherwise(acc["last"]).alias("last"),
                ),
            ).otherwise(acc)

        zero = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("count"), F.lit(0.0).alias("dice"), first.alias("last"))
        return F.aggregate(
            F.slice(hits, k + 1, span), zero, step, lambda acc: F.struct(acc["dice"].alias("dice"), (-first).alias("word"), acc["last"].alias("last"))
        )

    def best(hits: Column) -> Column:
        tried = F.transform(
            hits, lambda h, k: F.when(F.get(hits, k + (need - 1))["at"] - h["at"] < span, from_hit(hits, k, h["at"]))
        )
        return F.array_max(F.filter(tried, lambda w: w["dice"] >= least))

    hits = F.filter(
        F.transform(grams, lambda g, i: F.struct(i.alias("at"), g.alias("key"))), lambda h: F.array_contains(known, h["key"])
    )
    return _let(
        _let(_let(hits, numbered), best),
        lambda w: F.when(
            w.isNotNull(),
            F.struct(
                (-w["word"]).alias("word"),
                (w["last"] + 1).alias("last"),
                F.lit(len(own)).alias("size"),
                F.lit(name).alias("license"),
                w["dice"].alias("dice"),
            ),
        ),
    )


def _windows(text: Column, templates: list[tuple[str, list[int]]], least: float) -> Column:
    """The best window of each template that has one, in name order."""
    every = F.lit(sorted({g for _, t in templates for g in t})).cast("array<bigint>")

    def searched(grams: Column) -> Column:
        def one(known: Column, name: str, template: list[int]) -> Column:
            own = sorted(set(template))
            shared = F.size(F.array_intersect(known, F.lit(own).cast("array<bigint>")))
            return F.when(shared >= len(own) * least / (2 - least) - 1e-9, _window(grams, name, template, least))

        found = _let(
            F.array_intersect(grams, every),
            lambda known: F.when(F.size(known) > 0, F.filter(F.array(*[one(known, *t) for t in templates]), lambda w: w.isNotNull())),
        )

        def inside(w: Column, other: Column) -> Column:
            return (other["size"] > w["size"]) & (other["word"] <= w["word"]) & (other["last"] >= w["last"])

        return _let(found, lambda all_: F.filter(all_, lambda w: ~F.exists(all_, lambda other: inside(w, other))))

    kept = _let(_let(words(text), pairs), searched)
    return F.coalesce(kept, F.array().cast("array<struct<word:int,last:int,size:int,license:string,dice:double>>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, least: float = LEAST_DICE) -> DataFrame:
    """One row for each document: doc_id, matches (passage number, licence and dice of every passage
    that matches, in order), windows (first and last word, licence's size in bigrams, licence and dice),
    n_passages that match, license and dice of the best of both, else null."""
    listed = _template_pairs(docs, templates)
    sets = [(name, sorted(set(grams))) for name, grams in listed]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    passages = F.array_distinct(F.concat(lines, paragraphs, F.array(text)))
    low = min((len(b) for _, b in sets), default=0) * least / (2 - least)
    high = max((len(b) for _, b in sets), default=0) * (2 - least) / least

    def compared(passage: Column) -> Column:
        """The best template of a passage's bigrams, as (dice, name) or null."""

        def one(name: str, own: list[int]) -> Column:
            size = F.size(passage)
            possible = size.between(len(own) * least / (2 - least), len(own) * (2 - least) / least)
            shared = F.size(F.array_intersect(passage, F.lit(own).cast("array<bigint>")))
            dice = 2.0 * shared / (size + len(own))
            return F.when(possible & (dice >= least), F.struct(dice.alias("dice"), F.lit(name).alias("name")))

        every = F.filter(F.array(*[one(*t) for t in sets]), lambda m: m.isNotNull())
        return F.aggregate(
            every,
            F.lit(None).cast("struct<dice:double,name:string>"),
            lambda best, m: F.when(best.isNull() | (m["dice"] > best["dice"]), m).otherwise(best),
        )

    sized = F.transform(
        F.transform(passages, words),
        lambda tokens: F.when(F.size(tokens) > low, bigrams(tokens)).otherwise(F.array().cast("array<bigint>")),
    )
    if not sets:
        matched = F.array().cast("array<struct<passage:int,license:string,dice:double>>")
        windows = F.array().cast("array<struct<word:int,last:int,size:int,license:string,dice:double>>")
    else:
        windows = _windows(text, listed, least)
        matched = F.filter(
            F.transform(
                sized,
                lambda b, i: F.struct(
                    i.alias("passage"), F.when(F.size(b).between(low, high), compared(b)).alias("found")
                ),
            ),
            lambda m: m["found"].isNotNull(),
        )
        matched = F.transform(
            matched, lambda m: F.struct(m["passage"].alias("passage"), m["found"]["name"].alias("license"), m["found"]["dice"].alias("dice"))
        )
    of_both = F.concat(
        *[F.transform(F.col(c), lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))) for c in ("matches", "windows")]
    )
    best = F.col("best")
    of_passage = F.array_max(
        F.transform(F.filter("matches", lambda m: m["license"] == best["license"]), lambda m: m["dice"])
    )
    return (
        docs.select("doc_id", matched.alias("matches"), windows.alias("windows"))
        .select("*", F.array_min(of_both).alias("best"))
        .select(
            "doc_id",
            "matches",
            "windows",
            F.size("matches").alias("n_passages"),
            best["license"].alias("license"),
            F.coalesce(of_passage, -best["d"]).alias("dice"),
        )
    )
