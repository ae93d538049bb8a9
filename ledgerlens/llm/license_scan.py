"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Texts and templates are lower-cased words (runs of letters and digits); five words make a shingle. Windows
of shingles overlap, by half from two shingles on, and come in the sizes of SCALES: a template is looked for by the
largest size of which it holds a window and a half, so license texts go by windows of 16 shingles, notices of a line
by windows of 4 or 2, and a notice of five words by its one shingle. Templates have the same windows at every
place, so wherever a text quotes a template over a window and a half, one of its windows starts where a template
window starts. A window has MinHash values of one row each, one for each band; equal values in any band retrieve the
template. For windows of 16 there are six bands: at 80 % of shingles in common they have a Jaccard similarity near
0.67 and meet with probability 0.998, and a quoted template has several windows. For smaller ones a single band meets
for certain: one word changed inside costs five shingles, more than a template of fewer than 24 may lose, so what
passes has lost some at its ends only and keeps whole windows unchanged. Every retrieved template is then
verified: the share of its distinct shingles that the text holds must reach `containment`. Of templates that share
half of their shingles, as licenses of one family do, only the best contained are reported.

Scale. One narrow pass over the texts, no shuffle, no Python: all steps are array functions over the row.
Templates travel as literals, in blocks of about BLOCK_SHINGLES shingles that are looked up one after another in
the same pass.

Edge cases. Null, empty and short texts (under five words) match nothing, nor do templates of under five
words. Repeated rows give repeated rows. Rows without doc_id are scanned like any other. A template quoted
twice is one match; templates contained equally well are all reported. Extra columns are ignored. An empty
table or no templates give no rows."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
SCALES = (1, 2, 4, 16)
#: Bands of windows of the largest scale, and of the smaller ones.
BANDS, SMALL_BANDS = 6, 1
#: Templates that share this part of the smaller one's shingles are rivals.
RIVAL_SHARE = 0.5
BLOCK_SHINGLES = 20_000
_SPLIT = r"[^\p{L}\p{N}]+"

# Notices, headers and license texts as their publishers word them.
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)


def _gnu_header(license_name: str, version: str, pronoun: str = "This program") -> str:
    """The notice that the GNU licenses ask for in each file."""
    subject = pronoun.lower()
    return (
        f"{pronoun} is free software: you can redistribute it and/or modify it under the terms of the {license_name} "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) "
        f"any later version. {pronoun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"{license_name} for more details. You should have received a copy of the {license_name} along with {subject}."
    )


TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-distributed": "Distributed under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-project": "This project is licensed under the terms of the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": _BSD_START + _BSD_END,
    "BSD-3-Clause-text": _BSD_START + _BSD_NAMES + _BSD_END,
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and "
        "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law."
    ),
    "WTFPL-text": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION "
        "0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-header": _gnu_header("GNU General Public License", "2"),
    "GPL-3.0-header": _gnu_header("GNU General Public License", "3"),
    "LGPL-2.1-header": _gnu_header("GNU Lesser General Public License", "2.1", "This library"),
    "LGPL-3.0-header": _gnu_header("GNU Lesser General Public License", "3"),
    "AGPL-3.0-header": _gnu_header("GNU Affero General Public License", "3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at http://www.eclipse.org/legal/epl-2.0"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


def word_list(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def let(value, body):
    """body(value) with the value computed once for each row, wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words):
    """Hashes of the five-word shingles of an array of words, in order; none under five words."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + n) for n in range(1, SHINGLE)]))
    return F.slice(hashed, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))


def _seeds(bands: int) -> list[int]:
    """One 64-bit value for each band; a set's MinHash is its element nearest to the value by exclusive or."""
    return [int.from_bytes(hashlib.md5(f"band {b}".encode()).digest()[:8], "big", signed=True) for b in range(bands)]


def _least(window, seed: int):
    """MinHash of a window of shingle hashes in the band of the seed."""
    return F.array_min(F.transform(window, lambda s: s.bitwiseXOR(F.lit(seed))))


def _bands_of(window: int, scales: Sequence[int], bands: int) -> list[int]:
    return _seeds(bands if window == max(scales) else SMALL_BANDS)


def _longs(values):
    return F.from_json(F.lit(str(list(values))), "array<long>")


def _look_up(keys, values):
    return lambda v: F.get(values, F.array_position(keys, v).cast("int") - 1)


def scale_of(shingle_count: int, scales: Sequence[int] = SCALES) -> int:
    """The window size that looks for a template: the largest of which it holds a window and a half."""
    return max((w for w in scales if 2 * shingle_count >= 3 * w), default=scales[0])


class Index:
    """The templates' distinct shingles, their rivals, and the band values of their windows, in blocks."""

    def __init__(self, spark: SparkSession, templates: Mapping[str, str], scales: Sequence[int], bands: int, block: int):
        listed = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in templates.items()]))
        rows = spark.range(1).select(listed.alias("x"))
        hashed = let(word_list(F.col("x.t")), shingles).alias("s")
        found = {r["n"]: r["s"] for r in rows.select("x.n", hashed).collect()}
        self.names = [n for n in templates if found[n]]
        self.sets = [list(dict.fromkeys(found[n])) for n in self.names]
        holders: dict[int, list[int]] = {}
        for number, own in enumerate(self.sets):
            for s in own:
                holders.setdefault(s, []).append(number)
        shared = Counter((a, b) for held in holders.values() for a, b in permutations(held, 2))
        size = [len(own) for own in self.sets]
        self.rivals: list[list[int]] = [[] for _ in self.names]
        for (a, b), n in sorted(shared.items()):
            if n >= RIVAL_SHARE * min(size[a], size[b]):
                self.rivals[a].append(b)
        #: For each block of templates: its first number, its end, and by window size the templates of each band value.
        self.blocks: list[tuple[int, int, dict[int, dict[int, set[int]]]]] = []
        self.scales, self.bands = scales, bands
        first, held = 0, 0
        for number, name in enumerate(self.names):
            if held and held + size[number] > block:
                first, held = number, 0
            if not held:
                self.blocks.append((first, first, {}))
            held += size[number]
            start, _, tables = self.blocks[-1]
            own = found[name]
            window = scale_of(len(own), scales)
            table = tables.setdefault(window, {})
            for at in range(len(own) - window + 1):
                for seed in _bands_of(window, scales, bands):
                    table.setdefault(min(s ^ seed for s in own[at : at + window]), set()).add(number)
            self.blocks[-1] = (start, number + 1, tables)


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
    scales: Sequence[int] = SCALES,
    bands: int = BANDS,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """doc_id, license, n_shared, n_template, first_word: one row per row of docs and template found in it.
    first_word is the number (from 1) of the text's first word that starts a shared shingle."""
    schema = "array<struct<license:string,n_shared:int,n_template:int,first_word:long>>"
    index = Index(docs.sparkSession, templates, scales, bands, block) if templates else None
    if index is None or not index.names:
        found = F.array().cast(schema)
    else:
        found = let(word_list(F.col("text")), lambda w: let(shingles(w), _matches(index, containment)))
    # The condition always holds; it keeps the optimizer from repeating the scan in a filter on its result.
    once = F.when(F.monotonically_increasing_id() >= 0, found)
    rows = docs.select("doc_id", once.alias("found")).select("doc_id", F.explode("found").alias("m"))
    return rows.select("doc_id", "m.license", "m.n_shared", "m.n_template", "m.first_word")


def _matches(index: Index, containment: float):
    """From the shingles of a text: the templates that share a band value with it and pass the exact check."""

    def retrieve(values, table: dict[int, set[int]]):
        keys, held = zip(*sorted(table.items()))
        numbers = F.expr("array(" + ",".join(f"array({','.join(map(str, sorted(h)))})" for h in held) + ")")
        hits = F.filter(values, lambda v: v.isin(list(keys)))
        return F.flatten(F.transform(hits, _look_up(_longs(keys), numbers)))

    def window_values(sh, window: int):
        """Band values of the windows of a text."""
        seeds = _bands_of(window, index.scales, index.bands)
        starts = F.sequence(F.lit(0), F.greatest(F.size(sh) - window, F.lit(0)), F.lit(max(1, window // 2)))
        if len(seeds) == 1:
            (seed,) = seeds
            own = lambda i: [F.get(sh, i + n).bitwiseXOR(F.lit(seed)) for n in range(window)]
            return F.transform(starts, lambda i: F.least(*own(i)) if window > 1 else own(i)[0])
        cut = F.transform(starts, lambda s: F.slice(sh, s + 1, window))
        return F.flatten(F.transform(cut, lambda w: F.array(*[_least(w, seed) for seed in seeds])))

    def verified(sh, number, first: int, sets, names):
        return let(
            F.get(sets, number - first),
            lambda own: let(
                F.array_intersect(sh, own),
                lambda shared: F.struct(
                    F.get(names, number - first).alias("license"),
                    F.size(shared).alias("n_shared"),
                    F.size(own).alias("n_template"),
                    F.array_min(F.transform(shared, lambda s: F.array_position(sh, s))).alias("first_word"),
                    number.alias("number"),
                ),
            ),
        )

    def of_block(sh, first: int, end: int, tables):
        sets = F.array(*map(_longs, index.sets[first:end]))
        names = F.array(*map(F.lit, index.names[first:end]))
        found = [retrieve(window_values(sh, window), table) for window, table in sorted(tables.items())]
        checked = F.transform(F.array_distinct(F.concat(*found)), lambda n: verified(sh, n, first, sets, names))
        return F.filter(checked, lambda m: m["n_shared"] >= F.lit(containment) * m["n_template"])

    listed = ",".join(f"array({','.join(map(str, r))})" if r else "cast(array() as array<int>)" for r in index.rivals)
    rivals = F.expr(f"array({listed})")

    def better(o, m):
        """Whether o is a rival of m and contained in a larger part."""
        return F.array_contains(F.get(rivals, m["number"]), o["number"]) & (
            o["n_shared"].cast("long") * m["n_template"] > m["n_shared"].cast("long") * o["n_template"]
        )

    def matches(sh):
        passed = F.concat(*[of_block(sh, *block) for block in index.blocks])
        best = let(passed, lambda all_: F.filter(all_, lambda m: ~F.exists(all_, lambda o: better(o, m))))
        return F.transform(best, lambda m: F.struct(*[m[c].alias(c) for c in ("license", "n_shared", "n_template", "first_word")]))

    return matches


def oracle() -> str:
    """DuckDB SQL of the query: containment of every template in every text, without retrieval."""
    values = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in TEMPLATES.items())

    def cut(source: str, key: str, text: str) -> str:
        plain = f"regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        words = f"string_split(trim({plain}), ' ')"
        return (
            f"select {key}, i, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') as s from "
            f"(select {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 1))) as i from "
            f"(select {key}, {words} as w from {source}))"
        )

    return (
        f"with t as (select * from (values {values}) v(license, t)), "
        f"ts as (select distinct license, s from ({cut('t', 'license', 't')})), "
        "n as (select license, count(*) as n_template from ts group by license), "
        "d as (select row_number() over () as r, doc_id, text from documents), "
        f"ds as (select r, s, min(i) as i from ({cut('d', 'r', 'text')}) group by r, s), "
        "h as (select r, license, count(*) as n_shared, min(i) as first_word from ds join ts using (s) group by r, license), "
        f"p as (select * from h join n using (license) where n_shared >= {CONTAINMENT} * n_template), "
        "v as (select a.license as m, b.license as o from ts a join ts b on a.s = b.s and a.license <> b.license "
        "group by a.license, b.license having count(*) >= "
        f"{RIVAL_SHARE} * (select min(n_template) from n where n.license in (a.license, b.license))) "
        "select d.doc_id, p.license, cast(n_shared as integer) as n_shared, cast(n_template as integer) as n_template, "
        "cast(first_word as bigint) as first_word from p join d using (r) where not exists (select 1 from p q join v "
        "on v.m = p.license and v.o = q.license where q.r = p.r and q.n_shared * p.n_template > p.n_shared * q.n_template)"
    )
