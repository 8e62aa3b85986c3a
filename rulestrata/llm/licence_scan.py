"""Licence scans: normalised text against licence templates by the Dice coefficient of word
bigrams.

A whole text is normalised (lower case, runs of other characters than a-z, 0-9 and dots
inside numbers become one space), so line ends, comment marks and what surrounds a notice
do not matter. Windows slide over its words: a template of b bigrams meets every window of
up to b * (2 - t) / t bigrams, and matches where 2 * common / (a + b) >= t = ``LEAST``, for
the distinct bigrams of both. Bounds prune without loss. Only windows that begin and end
with a bigram of the template are tried, as others at the ends only lower the coefficient.
A window needs b * t / (2 - t) of the template's bigrams: where so many are not within
reach, none is tried. A text with none of the anchors - words chosen so that fewer of a
template's bigrams are without any of them - can't match.

Of each first bigram and template the best window counts, the shortest of equal ones; of
windows that overlap, from the left, the one with more bigrams in common stays (a whole
licence, not its first sentence), then the better one, the earlier, the first template by
name. DataFrame functions only.

Defined cases: null, empty and short texts have no notice (n_notices 0, licences empty,
best_dice null); a notice that comes twice counts twice; repeated rows and null ids keep a
row each; very long texts are read whole; other columns, whatever their names, are not
read; an empty table gives an empty result."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."
#: Notices as they are commonly written, and whole licence texts: fixed values.
TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-notice": "This program " + _GNU.format("Affero General", 3) + _GNU_END.format("Affero General"),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause-text": _BSD + _BSD_END,
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-3-clause-text": _BSD + _BSD_3 + _BSD_END,
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-notice": "This program " + _GNU.format("General", 2) + _GNU_END.format("General"),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program " + _GNU.format("General", 3) + _GNU_END.format("General"),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-3.0-notice": "This library " + _GNU.format("Lesser General", 3) + _GNU_END.format("Lesser General").replace("program", "library"),
    "mit": "Released under the MIT License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "public-domain": "This work is dedicated to the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def normalise(s: str) -> list[str]:
    return re.sub(r"[^a-z0-9.]+|\.(?![0-9])", " ", s.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words of which any line that reaches ``least`` must have one."""
    sets = {k: bigrams(normalise(v)) for k, v in templates.items()}
    common = {"the", "of", "and", "to", "in", "is", "with", "or", "for", "this", "are", "that", "any", "a", "under", "all", "by"}
    chosen: list[str] = []
    for b in sets.values():
        need = math.ceil(least * len(b) / (2 - least) - 1e-9)
        free = [g for g in b if not set(g.split()) & set(chosen)]
        for w in sorted({w for g in b for w in g.split()}, key=lambda w: (w in common, -len(w), w)):
            if len(free) < need:
                break
            chosen.append(w)
            free = [g for g in free if w not in g.split()]
    return sorted(set(chosen))


def _line_words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(line), F.lit(r"[^a-z0-9.]+|\.(?![0-9])"), F.lit(" "))), " +")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row: doc_id, n_notices, licences (names, by name), best_dice."""
    templates = TEMPLATES if templates is None else templates
    sets = {k: bigrams(normalise(v)) for k, v in sorted(templates.items())}
    most = {k: int(len(v) * (2 - least) / least + 1e-9) for k, v in sets.items()}
    every = sorted({g for v in sets.values() for g in v})
    marked = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, anchors(templates, least))) + r")(?![a-z0-9])"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    item = "struct<i:int,fewer:int,worse:double,name:string,j:int>"
    bound = lambda value, then: F.transform(F.array(value), then).getItem(0)
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("grams"), F.lit(most[k]).alias("most"), F.lit(math.ceil(least * len(v) / (2 - least) - 1e-9)).alias("need")) for k, v in sets.items()])

    def of_grams(g: Column) -> Column:
        """Places of bigrams, each with the place before of the same bigram (-1: none)."""
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        prior = lambda o: F.array_sort(F.transform(o, lambda x, k: F.struct(x["i"].alias("i"), F.when(F.get(o, k - 1)["g"] == x["g"], F.get(o, k - 1)["i"]).otherwise(-1).alias("prev"))))
        near = F.filter(F.transform(g, lambda x, i: F.struct(i.alias("i"), x.alias("g"))), lambda x: x["g"].isin(every))
        met = lambda n, p: F.flatten(F.transform(known, lambda t: bound(F.transform(F.filter(n, lambda x: F.array_contains(t["grams"], x["g"])), lambda x: F.get(p, x["i"])), lambda hits: of_template(p, t, hits))))
        return bound(near, lambda n: F.when(F.size(n) > 0, bound(bound(ordered, prior), lambda p: met(n, p))).otherwise(F.array().cast(f"array<{item}>")))

    def of_template(p: Column, t: Column, hits: Column) -> Column:
        def best(x: Column, k: Column) -> Column:
            # A bigram is new in a window if its place before is not in it: new bigrams are
            # counted by their order, so each window is read once, whatever its ends. Ends at
            # bigrams that are not new are no better; fewer than ``need`` hits can't match.
            reach = lambda y: (y["i"] - x["i"] < t["most"]) & (y["prev"] < x["i"])
            ends = F.filter(F.slice(hits, k + 1, t["most"]), reach)
            new = F.transform(F.filter(F.slice(p, x["i"] + 1, t["most"]), reach), lambda y: y["i"])

            def tried(n: Column, e: Column) -> Column:
                one = lambda y, m: F.struct((-2.0 * (m + t["need"]) / (F.array_position(n, y["i"]) + F.size(t["grams"]))).alias("worse"), y["i"].alias("j"), (-(m + t["need"])).alias("fewer"))
                return F.array_min(F.transform(F.slice(e, t["need"], F.size(e)), one))

            found = bound(ends, lambda e: F.when(F.size(e) >= t["need"], bound(new, lambda n: tried(n, e))))
            enough = F.coalesce(F.get(hits, k + t["need"] - 1)["i"] - x["i"] < t["most"], F.lit(False))
            return bound(F.when(enough, found), lambda b: F.struct(x["i"].alias("i"), b["fewer"].alias("fewer"), b["worse"].alias("worse"), t["name"].alias("name"), b["j"].alias("j")))

        return F.filter(F.transform(hits, best), lambda f: f["worse"] <= -least)

    def settle(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(f))
        return F.when(F.size(kept) == 0, F.array(f)).when(f["i"] > last["j"], F.concat(kept, F.array(f))).when((f["fewer"] < last["fewer"]) | (f["fewer"] == last["fewer"]) & (f["worse"] < last["worse"]), swapped).otherwise(kept)

    def of_words(w: Column) -> Column:
        grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
        return bound(grams, of_grams)

    none = F.array().cast(f"array<{item}>")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = F.when(F.col("text").rlike(marked), bound(_line_words(F.col("text")), of_words).cast(f"array<{item}>")).otherwise(none)
    settled = bound(F.sort_array(found), lambda s: F.aggregate(s, none, settle))
    names = lambda k: F.array_join(F.array_sort(F.array_distinct(F.transform(k, lambda x: x["name"]))), ",")
    result = bound(settled, lambda k: F.struct(F.size(k).cast("long").alias("n_notices"), names(k).alias("licences"), (-F.array_min(F.transform(k, lambda x: x["worse"]))).alias("best_dice")))
    return d.select("doc_id", result.alias("r")).select("doc_id", "r.*")


def duckdb_sql(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    norm = "regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9.]+', ' ', 'g'), '\\.([^0-9]|$)', ' \\1', 'g')), ' +')"
    grams = "[w[i] || ' ' || w[i + 1] for i in range(1, len(w))]"
    return f"""
WITH t AS (SELECT name, list_distinct({grams}) AS g FROM (SELECT name, {norm.format('body')} AS w FROM (VALUES {rows}) v(name, body))),
d AS (SELECT row_number() OVER () AS id, doc_id, {norm.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT id, {grams} AS g FROM d),
u AS (SELECT id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM b),
h AS (SELECT id, name, i FROM u JOIN (SELECT name, unnest(g) AS gram FROM t) USING (gram)),
p AS (SELECT x.id, x.name, x.i, y.i AS j FROM h x JOIN h y ON x.id = y.id AND x.name = y.name AND y.i >= x.i JOIN t ON t.name = x.name AND y.i - x.i < floor(len(t.g) * {(2 - least) / least} + 1e-9)),
r AS (SELECT p.*, t.g AS tg, list_distinct(list_slice(b.g, p.i, p.j)) AS run FROM p JOIN b USING (id) JOIN t USING (name)),
c AS (SELECT *, len(list_intersect(run, tg)) AS common FROM r),
s AS (SELECT id, name, i, j, -CAST(common AS INT) AS fewer, -2.0 * common / (len(run) + len(tg)) AS worse FROM c),
f AS (SELECT id, name, i, j, fewer, worse FROM s WHERE worse <= {-least} QUALIFY row_number() OVER (PARTITION BY id, name, i ORDER BY worse, j) = 1),
l AS (SELECT id, list([{{'i': i, 'fewer': fewer, 'worse': worse, 'name': name, 'j': j}}] ORDER BY i, fewer, worse, name, j) AS l FROM f GROUP BY id),
k AS (SELECT id, list_reduce(l, lambda a, x: CASE WHEN x[1].i > a[-1].j THEN list_concat(a, x) WHEN x[1].fewer < a[-1].fewer OR x[1].fewer = a[-1].fewer AND x[1].worse < a[-1].worse THEN list_concat(list_slice(a, 1, len(a) - 1), x) ELSE a END) AS k FROM l)
SELECT d.doc_id, CAST(coalesce(len(k), 0) AS BIGINT) AS n_notices, coalesce(array_to_string(list_sort(list_distinct([x.name for x in k])), ','), '') AS licences, -list_min([x.worse for x in k]) AS best_dice
FROM d LEFT JOIN k USING (id)
"""
