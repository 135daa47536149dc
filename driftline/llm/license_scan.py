"""License scans: normalised texts, their lines and spans of words, compared to licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least Dice coefficient that counts as a match.
THRESHOLD = 0.8

# Notices and texts of licences, under their SPDX names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]

# Full texts, each a file under its SPDX name.
TEMPLATES += [(f.name.removesuffix(".txt"), " ".join(f.read_text(encoding="utf-8").split())) for f in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


def prepared(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """Name, bigrams with their counts, size, and the sizes of texts that can reach the threshold.

    Two bags of bigrams of sizes a and b share min(a, b) at most, so the coefficient 2 x shared / (a + b)
    can reach t only if a lies between b x t / (2 - t) and b x (2 - t) / t.
    """
    out = []
    for name, text in templates:
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        grams = Counter(map(" ".join, zip(words, words[1:], strict=False)))
        size = len(words) - 1
        if size < 1:
            raise ValueError(f"the template of {name} needs two words")
        out.append({"name": name, "grams": grams, "size": size, "low": math.ceil(size * threshold / (2 - threshold) - 1e-9), "high": math.floor(size * (2 - threshold) / threshold + 1e-9)})
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, license_id, dice, matches.

    The whole text and each of its lines is compared, in lower case, words being runs of letters and digits.
    If the whole text does not reach the threshold, each stretch of lines that do not reach it either is searched
    for its best span of consecutive words, which may begin and end anywhere and go over lines.
    matches counts lines, stretches and the whole text (if it has several lines) that reach the threshold;
    license_id and dice are those of the best, of equal ones the template named first. Without a match, as for null,
    empty and one-word texts, both are null and matches 0. No row is shuffled; an empty table gives an empty result.
    """
    known = prepared(templates, threshold)
    least, most = min(t["low"] for t in known), max(t["high"] for t in known)
    kinds = [{"i": i, **{k: t[k] for k in ("size", "low", "high")}, "spare": t["size"] - len(t["grams"]), "grams": list(t["grams"]), "ns": list(t["grams"].values())} for i, t in enumerate(known)]
    table = F.from_json(F.lit(json.dumps(kinds)), "array<struct<i: int, size: int, low: int, high: int, spare: int, grams: array<string>, ns: array<int>>>")
    every = [F.lit(g) for g in sorted({g for t in known for g in t["grams"]})]
    names = F.array(*[F.lit(t["name"]) for t in known])
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")

    def words(text: Column) -> Column:
        return F.filter(F.split(text, " "), lambda w: w != "")

    def bigrams(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def enough(own: Column, t: Column) -> Column:
        """Whether bigrams may be shared ``low`` times, without which no text of any size reaches the threshold."""
        return F.when(F.size(own) >= t["low"], F.size(F.array_intersect(own, t["grams"])) + t["spare"] >= t["low"]).otherwise(False)

    def top(near: Column, dice: Callable[[Column], Column]) -> Column:
        scores = F.transform(near, lambda t: F.struct(dice(t).alias("dice"), (-t["i"]).alias("i")))
        return F.array_max(F.filter(scores, lambda x: x["dice"] >= threshold))

    def shared(unit: Column, t: Column) -> Column:
        return F.aggregate(F.zip_with(t["grams"], t["ns"], lambda g, n: F.least(n, F.size(F.filter(unit, lambda x: x == g)))), F.lit(0), lambda a, n: a + n)

    def of_unit(unit: Column, own: Column) -> Column:
        near = F.filter(table, lambda t: F.size(unit).between(t["low"], t["high"]) & enough(own, t))
        return top(near, lambda t: 2.0 * shared(own, t) / (F.size(unit) + t["size"]))

    def of_spans(unit: Column, own: Column) -> Column:
        """The best span begins and ends with bigrams of the template, as others at its ends only make it longer."""

        def dice(t: Column) -> Column:
            at = F.filter(F.transform(unit, lambda g, p: F.struct(p.alias("at"), F.array_position(t["grams"], g).cast("int").alias("gram"))), lambda x: x["gram"] > 0)

            def spans(at: Column) -> Column:
                # a bigram counts in a span that begins after the n-th before it of its kind, n being the template's number;
                # no span that reaches the threshold has more bigrams than ``high``
                def last(x: Column, k: Column) -> Column:
                    return let(F.filter(F.slice(at, F.greatest(k - t["high"], F.lit(0)) + 1, F.least(k, t["high"])), lambda y: y["gram"] == x["gram"]), lambda before: first_of(before, F.element_at(t["ns"], x["gram"])))

                def first_of(before: Column, n: Column) -> Column:
                    return F.when(F.size(before) >= n, F.element_at(before, -n)["at"]).otherwise(-1)

                return let(F.transform(at, lambda x, k: F.struct(x["at"].alias("at"), last(x, k).alias("last"))), best_of)

            def best_of(marks: Column) -> Column:
                start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("dice"))

                def longer(s: Column, x: Column, a: Column) -> Column:
                    n = s["n"] + F.when(x["last"] < a["at"], 1).otherwise(0)
                    return F.struct(n.alias("n"), F.greatest(s["dice"], 2.0 * n / (x["at"] - a["at"] + 1 + t["size"])).alias("dice"))

                return F.array_max(F.transform(marks, lambda a, k: F.aggregate(F.slice(marks, k + 1, t["high"]), start, lambda s, x: longer(s, x, a), lambda s: s["dice"])))

            return let(at, spans)

        return top(F.filter(table, lambda t: enough(own, t)), dice)

    def scored(text: Column, score: Callable[[Column, Column], Column], fits: Callable[[Column], Column]) -> Column:
        """The score of a text, null where too few of its bigrams are those of any template."""
        by_own = lambda g: let(F.filter(g, lambda x: x.isin(every)), lambda own: F.when(F.size(own) >= least, score(g, own)))
        return let(words(text), lambda w: F.when(fits(F.size(w)), let(bigrams(w), by_own)))

    rows = docs.select(F.col(id_col), clean.alias("_clean")).select(id_col, F.split("_clean", "\n").alias("_lines"))
    units = F.when(F.size("_lines") > 1, F.concat("_lines", F.array(F.array_join("_lines", " ")))).otherwise(F.col("_lines"))
    rows = rows.withColumn("_units", F.transform(units, lambda u: scored(u, of_unit, lambda n: (n > least) & (n <= most + 1))))
    # no text has this character any more
    rest = F.split(F.array_join(F.transform("_lines", lambda x, k: F.when(F.get("_units", k).isNull(), x).otherwise(F.lit("\r"))), " "), "\r")
    rest = F.when((F.size("_lines") > 1) & F.element_at("_units", -1).isNotNull(), F.array().cast("array<string>")).otherwise(rest)
    rows = rows.select(id_col, "_units", rest.alias("_rest"))
    rows = rows.select(id_col, F.concat("_units", F.transform("_rest", lambda u: scored(u, of_spans, lambda n: n > least))).alias("_found"))
    rows = rows.select(id_col, F.filter("_found", lambda x: x.isNotNull()).alias("_found"))
    best = rows.select(id_col, F.array_max("_found").alias("_top"), F.size("_found").cast("long").alias("matches"))
    return best.select(id_col, F.try_element_at(names, 1 - F.col("_top.i")).alias("license_id"), F.col("_top.dice").alias("dice"), "matches")
