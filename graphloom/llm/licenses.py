"""License scans, in DataFrame functions only.

A text is lower-cased and all but a-z and 0-9 becomes a space; what is compared are the bigrams of its
words, across line ends. A license has several templates: its text or customary header, and notices by which
it is referred to. A template of n bigrams is compared with every window of n bigrams of the whole
text (the windows at the end are cut there) by the Dice coefficient, repeats counted:
2 * common / (size of the window + n), at least MIN_DICE to be a match. The best window begins with a
bigram of the template, so only those are looked at.

Two bounds prune templates without losing a match, as Dice >= t needs t / (2 - t) * n common
bigrams: a text must have that many bigrams, and that many of the template's. All templates' bigrams are
first met at once, in a Bloom filter, so most texts are compared with no template at all.
Templates are a fixed list, so they are literals of the plan; no join, no shuffle.

Defined results: a null, empty or wordless text matches nothing (license null, dice 0.0); ties
go to the license that comes first by name; repeated rows and null ids are scanned row by
row; without templates nothing matches; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import _in, bloom, filter_bits

MIN_DICE = 0.8

_AS_IS = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. ' + _AS_IS
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_FREE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"

#: The texts of public licenses or their customary headers, and notices that refer to them.
TEMPLATES = {
    "AGPL-3.0": [_GNU.format(name="Affero General Public License", v=3)],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [f"{_BSD_HEAD} {_BSD_TWO} {_BSD_END}"],
    "BSD-3-Clause": [_BSD_HEAD, f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}"],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', "Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format(name="General Public License", v=2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format(name="General Public License", v=3)],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-2.1": [_GNU.format(name="Lesser General Public License", v="2.1")],
    "LGPL-3.0": [_GNU.format(name="Lesser General Public License", v=3)],
    "MIT": [
        "Released under the MIT License.",
        f'{_FREE} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        _FREE,
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def bigrams(text: str) -> list[tuple[str, str]]:
    words = normal(text).split()
    return list(zip(words, words[1:], strict=False))


def _listed(templates: dict[str, list[str]]) -> list[tuple[str, Counter]]:
    """(license, bigrams) of the templates that have any, by name."""
    return [(name, own) for name, texts in sorted(templates.items()) for t in texts if (own := Counter(bigrams(t)))]


def _hash(bigram: tuple[str, str]) -> int:
    """As xxhash64(a, b) in SQL."""
    h = 42
    for word in bigram:
        h = xxhash.xxh64_intdigest(word.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def _dice(own: Counter, min_dice: float) -> str:
    """SQL for the best Dice coefficient of a template, 0 if it is pruned. hits: an array of (i, h), the
    places and hashes of the text's bigrams that the filter let through; n: its number of bigrams."""
    size = sum(own.values())
    need = min_dice / (2 - min_dice) * size - 1e-9
    held = ", ".join(f"{_hash(b)}L" for b in own)
    more = "".join(f" + greatest(least(size(filter(v, x -> x = {_hash(b)}L)), {c}) - 1, 0)" for b, c in own.items() if c > 1)
    dice = f"2.0D * (size(array_distinct(v)) + 0{more}) / (least({size}, n - at) + {size})"
    window = f"transform(filter(slice(own, j, {size}), x -> x.i < own[j - 1].i + {size}), x -> x.h)"
    # arrays of one element bind what is used more than once
    each = f"transform(array(struct({window} as v, own[j - 1].i as at)), b -> if(size(b.v) < {need}D, 0.0D, {dice.replace('(v', '(b.v').replace('- at', '- b.at')}))[0]"
    best = f"if(size(own) < {need}D, 0.0D, array_max(transform(sequence(1, size(own)), j -> {each})))"
    return f"if(n < {need}D, 0.0D, transform(array(filter(hits, x -> array_contains(array({held}), x.h))), own -> {best})[0])"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id, license (the best match), dice, licenses (all, by name, comma-joined)."""
    listed = _listed(templates)
    if not listed:
        return docs.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("dice"), F.lit("").alias("licenses"))
    hashes = sorted({_hash(b) for _, own in listed for b in own})
    bits = filter_bits(len(hashes))
    known = docs.sparkSession.range(1).select(F.expr(f"explode(array({', '.join(f'{h}L' for h in hashes)}))").alias("term"))
    least = min(min_dice / (2 - min_dice) * sum(own.values()) - 1e-9 for _, own in listed)
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^a-z0-9]+", " ")), " ")
    rows = docs.select("doc_id", words.alias("w")).withColumn("f", bloom(known, bits))
    # the last word's hash is of no bigram
    rows = rows.select("doc_id", "f", (F.size("w") - 1).alias("n"), F.expr("transform(w, (a, i) -> xxhash64(a, get(w, i + 1)))").alias("h"))
    rows = rows.withColumn("few", F.expr(f"filter(h, t -> {_in('f', bits)})"))
    hits = "filter(transform(h, (t, i) -> struct(i as i, t as h)), x -> array_contains(few, x.h))"
    rows = rows.select("doc_id", "n", F.expr(f"if(size(few) < {least}D, array(), {hits})").alias("hits"))
    found = [f"struct({_dice(own, min_dice)} as dice, '{name}' as name)" for name, own in listed]
    rows = rows.select("doc_id", F.expr(f"if(size(hits) = 0, array(), filter(array({', '.join(found)}), m -> m.dice >= {min_dice}D))").alias("found"))
    best = F.expr("reduce(found, named_struct('dice', 0.0D, 'name', cast(null as string)), (a, m) -> if(m.dice > a.dice, m, a))")
    return rows.select("doc_id", best["name"].alias("license"), best["dice"].alias("dice"), F.array_join(F.array_distinct(F.transform("found", lambda m: m["name"])), ",").alias("licenses"))


def oracle(templates: dict[str, list[str]] = TEMPLATES, min_dice: float = MIN_DICE) -> str:
    """The definition in SQL: every template at every place of one of its bigrams."""
    values = ", ".join(f"({k}, '{name}', '{' '.join(b)}', {c}, {sum(own.values())})" for k, (name, own) in enumerate(_listed(templates)) for b, c in own.items())
    return f"""
WITH t(k, name, bigram, c, size) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT r, len(w) - 1 AS n, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM d),
h AS (SELECT * FROM b JOIN t USING (bigram)),
c AS (SELECT r, k FROM h GROUP BY r, k, size HAVING count(*) >= {min_dice / (2 - min_dice)}::DOUBLE * size - 1e-9),
s AS (SELECT h.* FROM h SEMI JOIN c USING (r, k)),
x AS (SELECT s.r, s.k, s.name, s.i, s.n, s.size, e.bigram, least(count(*), e.c) AS common FROM s JOIN s e ON e.r = s.r AND e.k = s.k AND e.i >= s.i AND e.i < s.i + s.size GROUP BY s.r, s.k, s.name, s.i, s.n, s.size, e.bigram, e.c),
m AS (SELECT r, name, 2.0::DOUBLE * sum(common) / (least(size, n - i + 1) + size) AS dice FROM x GROUP BY r, k, name, i, n, size),
f AS (SELECT r, name, max(dice) AS dice FROM m WHERE dice >= {min_dice}::DOUBLE GROUP BY r, name),
g AS (SELECT r, arg_max(name, (dice, -rank)) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses
      FROM (SELECT *, row_number() OVER (ORDER BY name) AS rank FROM f) GROUP BY r)
SELECT doc_id, license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN g USING (r)"""
