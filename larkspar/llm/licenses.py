"""License scans with DataFrame functions only: Dice coefficient over word bigrams against templates.

Units are the whole text, its paragraphs and its lines, lower-cased and reduced to ASCII letters and digits. A
unit of b distinct bigrams can reach coefficient t only against templates of b*t/(2-t) to b*(2-t)/t bigrams; that
bound, and the number of its bigrams that occur in any template, prune units and templates before any comparison.
The unit then also holds at least t/(2-t) of the template's bigrams, so it has one of any words that occur in more
than the rest of them: texts without such a word are done at once. Texts of which no unit reaches t are searched for
windows: any words in a row, across lines and paragraphs, of at most b*(2-t)/t bigrams, that begin and end with
bigrams of a template of b. All of it happens within the row: no shuffle.

Defined cases: null or empty text has no licence; ties go to the earlier template; repeated rows each give a row;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short statements and standard notices of common licences, in order of preference.
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def telling_words(known: list[list[str]], share: float) -> list[str]:
    """Words of which every unit that matches one of the bigram lists has at least one: long words first."""
    out: list[str] = []
    for b in known:
        need = len(b) - math.ceil(share * len(b) - 1e-9) + 1
        left = [x for x in b if not set(x.split()) & set(out)]
        while len(b) - len(left) < need:
            words = sorted({w for x in left for w in x.split()})
            out.append(max(words, key=lambda w: (min(len(w), 6), sum(w in x.split() for x in left), len(w), w)))
            left = [x for x in left if out[-1] not in x.split()]
    return out


def license_scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None, windows: bool = False) -> DataFrame:
    """Per row: doc_id, license (null: none), dice of the best unit (or, without one, window) and template, n_units: units that reached the threshold."""
    known = [(name, b) for name, t in templates or TEMPLATES if (b := bigrams(t))]
    every = sorted({x for _, b in known for x in b})
    share = threshold / (2 - threshold)
    low, high = math.ceil(min(len(b) for _, b in known) * share - 1e-9), math.floor(max(len(b) for _, b in known) / share + 1e-9)
    lower = F.lower(F.coalesce("text", F.lit("")))
    telling = F.lit(False)
    for w in telling_words([b for _, b in known], share):
        telling = telling | F.contains(lower, F.lit(w))
    # a column of its own, as expressions that stand in several places are computed in each
    docs = docs.select("doc_id", F.when(telling, F.regexp_replace(lower, r"[^a-z0-9\n]+", " ")).alias("norm"))
    norm = F.col("norm")
    lines = F.split(norm, "\n")
    units = F.when(F.contains(norm, F.lit("\n")), F.concat(F.array(norm), F.split(norm, r"\n[ \n]*\n"), lines)).otherwise(F.array(norm))
    words = F.transform(units, lambda u: F.filter(F.split(u, r"[ \n]+"), lambda w: w != ""))
    words = F.filter(words, lambda w: F.size(w) > low)
    pairs = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    pairs = F.filter(pairs, lambda p: F.size(p).between(low, high))
    # of a unit's bigrams, a share must be bigrams of templates
    pairs = F.filter(pairs, lambda p: F.size(F.filter(p, lambda x: x.isin(every))) >= F.size(p) * F.lit(share - 1e-9))

    def best(p: Column) -> Column:
        scores = []
        for i, (_, b) in enumerate(known):
            dice = F.lit(2.0) * F.size(F.array_intersect(p, F.array(*map(F.lit, b)))) / (F.size(p) + F.lit(len(b)))
            fits = F.size(p).between(math.ceil(len(b) * share - 1e-9), math.floor(len(b) / share + 1e-9))
            scores.append(F.struct(F.when(fits, dice).otherwise(F.lit(0.0)).alias("dice"), F.lit(-i).alias("rank")))
        return F.array_max(F.array(*scores))

    hits = F.filter(F.transform(pairs, best), lambda x: x["dice"] >= threshold)
    hits = F.when(norm.isNotNull(), hits).otherwise(F.array().cast("array<struct<dice:double,rank:int>>"))
    # without such a unit, windows over the words of the whole text
    array = lambda kind: F.array().cast(f"array<{kind}>")
    flat = F.filter(F.split(norm, r"[ \n]+"), lambda w: w != "")
    flat = F.zip_with(F.slice(flat, 1, F.greatest(F.size(flat) - 1, F.lit(0))), F.slice(flat, 2, F.size(flat)), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = docs.select("doc_id", "norm", hits.alias("hits"))
    rows = rows.select("doc_id", "hits", F.when(norm.isNotNull() & (F.size("hits") == 0), flat).otherwise(array("string")).alias("all_"))
    met = F.filter(F.transform("all_", lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda p: p["x"].isin(every))
    rows = rows.select("*", met.alias("met"))
    of = lambda b: F.filter("met", lambda p: p["x"].isin(b))
    rows = rows.select("doc_id", "hits", "all_", *[of(b).alias(f"met{i}") for i, (_, b) in enumerate(known)])

    def window(i: int, n: int) -> Column:
        """The best window of template i that begins and ends with bigrams of it."""
        m, need, most = F.col(f"met{i}"), math.ceil(n * share - 1e-9), math.floor(n / share + 1e-9)

        def ends(k: Column) -> Column:
            last = F.filter(F.sequence(k + (need - 1), F.least(F.size(m) - 1, k + (most - 1))), lambda e: F.get(m, e)["j"] - F.get(m, k)["j"] < most)
            same = lambda e: F.size(F.array_distinct(F.transform(F.slice(m, k + 1, e - k + 1), lambda p: p["x"])))
            size = lambda e: F.size(F.array_distinct(F.slice("all_", F.get(m, k)["j"] + 1, F.get(m, e)["j"] - F.get(m, k)["j"] + 1)))
            return F.array_max(F.transform(last, lambda e: F.lit(2.0) * same(e) / (size(e) + F.lit(n))))

        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(m) - need, F.lit(0))), lambda k: F.get(m, k + (need - 1))["j"] - F.get(m, k)["j"] < most)
        dice = F.when(F.size(m) >= need, F.array_max(F.transform(starts, ends)))
        return F.struct(F.coalesce(dice, F.lit(0.0)).alias("dice"), F.lit(-i).alias("rank"))

    found = F.filter(F.array(*[window(i, len(b)) for i, (_, b) in enumerate(known)]), lambda x: x["dice"] >= threshold) if windows else F.col("hits")
    names = F.array(*[F.lit(n) for n, _ in known])
    out = rows.select("doc_id", "hits", F.when(F.size("hits") > 0, F.array_max("hits")).otherwise(F.array_max(found)).alias("top"))
    return out.select("doc_id", F.when(F.col("top").isNotNull(), F.element_at(names, 1 - F.coalesce(F.col("top.rank"), F.lit(0)))).alias("license"), F.col("top.dice").alias("dice"), F.size("hits").cast("long").alias("n_units"))


def license_report(docs: DataFrame) -> DataFrame:
    """The scan with units and windows."""
    return license_scan(docs, windows=True)
