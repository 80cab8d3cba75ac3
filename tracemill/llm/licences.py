"""Licence scans in DataFrame expressions: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, every run of characters other than letters and digits a space) and cut into word bigrams,
whatever lines they stand on.  For each template a text's passages are compared:

* the places where a bigram of the template stands, with gaps of at most `gap` places, form runs; a run of at least `run`
  such places is solid;
* a passage goes from the start of one solid run to the end of the same or a later one, over at most `longest` places.

With a distinct bigrams in the passage, b in the template and c in both, Dice is 2c / (a + b).  Bounds by size prune before
any passage is made: c is at least `least` = t * b / (2 - t) for a threshold t, so a template with fewer places in a text
is out, and a passage with fewer too; `longest` lies beyond what the threshold allows an undoubled passage.  Everything is
one projection of the scan: no shuffle, no join, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.expressions import let, unused

#: Notices by which licences are commonly granted, under their SPDX names.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)
#: Full texts, in files named by their SPDX names.
TEXTS = Path(__file__).with_name("licence_texts")


def words_of(text: str) -> list[str]:
    """A template's normalised words, as normalised() and word splitting give them for ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


@dataclass(frozen=True)
class Template:
    licence: str
    text: str
    threshold: float = 0.8

    @cached_property
    def bigrams(self) -> list[str]:
        return bigrams_of(self.text)

    @property
    def least(self) -> int:
        return max(1, math.ceil(self.threshold * len(self.bigrams) / (2 - self.threshold) - 1e-9))

    @property
    def gap(self) -> int:
        return 1 + min(3, len(self.bigrams) // 5)

    @property
    def run(self) -> int:
        return 1 + len(self.bigrams) // 20

    @property
    def longest(self) -> int:
        return int(len(words_of(self.text)) * (2 - self.threshold) / self.threshold)

    @property
    def reach(self) -> int:
        """Solid runs that a passage can hold: each takes `run` places and the gap behind it, at least."""
        return self.longest // (self.run + self.gap) + 1


def templates(threshold: float = 0.8) -> list[Template]:
    full = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    return [Template(name, text, threshold) for name, text in (*NOTICES, *full)]


def bigrams(text: Column) -> Column:
    """Word bigrams of a text in order."""
    low = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return let(
        F.filter(F.split(low, " "), lambda w: w != ""),
        lambda words: F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))),
    )


def _among(bigrams: list[str]) -> str:
    """SQL list of bigrams, which hold letters, digits and one space alone."""
    return ", ".join(f"'{b}'" for b in bigrams)


def _parameters(known: list[Template]) -> Column:
    """The templates' numbers, as an array."""
    numbers = ("least", "gap", "run", "longest", "reach")
    return F.expr("array(" + ", ".join(f"struct('{t.licence}' AS licence, {len(t.bigrams)} AS b, " + ", ".join(f"{getattr(t, n)} AS {n}" for n in numbers) + ")" for t in known) + ")")


def _best(own: Column, t: Column, grams: Column, threshold: float) -> Column:
    """The best passage for a template as (dice, -place, licence, bigrams), or null; own: its bigrams in the text."""
    at = lambda i: F.get(own, i)["p"]
    starts = F.filter(F.transform(own, lambda h, i: F.when((i == 0) | (h["p"] - at(i - 1) > t["gap"]), i)), lambda i: i.isNotNull())
    runs = let(starts, lambda s: F.transform(s, lambda i, k: F.struct(i.alias("lo"), (F.coalesce(F.get(s, k + 1), F.size(own)) - 1).alias("hi"))))
    solid = F.filter(runs, lambda r: r["hi"] - r["lo"] + 1 >= t["run"])
    spans = let(solid, lambda s: F.flatten(F.transform(s, lambda r, k: F.transform(F.slice(s, k + 1, t["reach"]), lambda e: F.struct(r["lo"].alias("lo"), e["hi"].alias("hi"))))))
    near = F.filter(spans, lambda x: (at(x["hi"]) - at(x["lo"]) + 1 <= t["longest"]) & (x["hi"] - x["lo"] + 1 >= t["least"]))

    def scored(x: Column) -> Column:
        lo, hi = at(x["lo"]), at(x["hi"])
        a = F.size(F.array_distinct(F.slice(grams, lo + 1, hi - lo + 1)))
        c = F.size(F.array_distinct(F.transform(F.slice(own, x["lo"] + 1, x["hi"] - x["lo"] + 1), lambda h: h["g"])))
        return F.struct((2.0 * c / (a + t["b"])).alias("dice"), (-lo).alias("place"), t["licence"].alias("licence"), (hi - lo + 1).alias("size"))

    return F.when(F.size(own) >= t["least"], F.array_max(F.filter(F.transform(near, scored), lambda s: s["dice"] >= threshold)))


def scan(docs: DataFrame, text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """All rows and columns of docs with licences (distinct names, ascending, joined by commas), and licence, dice,
    licence_place and licence_bigrams of the best passage: its first word, from 0, and its length.

    Each template keeps its best passage, of equal Dice the first; over all templates the greatest Dice wins, of equal ones
    the first passage, then the later name.  Null and empty texts, and texts of one word, match nothing: no licences (empty)
    and nulls.  Long texts are read whole; repeated rows are answered alike; no rows give no rows.  Columns of docs with the
    names above are replaced; others may have any names.
    """
    known = templates() if known is None else known
    docs = docs.drop("licences", "licence", "dice", "licence_place", "licence_bigrams")
    grams, hits, each, found = (unused(docs.columns, c) for c in ("licence_grams", "licence_hits", "licence_each", "licence_found"))
    every = _among(sorted({b for t in known for b in t.bigrams}))
    out = docs.withColumn(grams, bigrams(F.coalesce(docs[text_col], F.lit(""))))
    out = out.withColumn(hits, F.expr(f"filter(transform({grams}, (g, i) -> struct(g as g, i as p)), h -> h.g in ({every}))"))
    # every template's own bigrams, and then one expression for all of them
    out = out.withColumn(each, F.expr("array(" + ", ".join(f"filter({hits}, h -> h.g in ({_among(t.bigrams)}))" for t in known) + ")"))
    parameters, threshold = _parameters(known), known[0].threshold
    matches = F.transform(each, lambda o, k: let(F.get(parameters, k), lambda t: _best(o, t, F.col(grams), threshold)))
    out = out.withColumn(found, F.filter(matches, lambda m: m.isNotNull()))
    best = F.array_max(found)
    return out.select(
        *docs.columns, F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["licence"]))), ",").alias("licences"), best["licence"].alias("licence"),
        best["dice"].alias("dice"), (-best["place"]).alias("licence_place"), best["size"].alias("licence_bigrams"),
    )
