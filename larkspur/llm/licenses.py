"""Licence scans by the Dice coefficient over word bigrams, in DataFrame expressions only.

A text is lower-cased and everything but letters and digits becomes a space.
A template is compared with every window of its length in a text, cut where the
text begins or ends, so notices are found inside prose and long lines, full texts
across paragraphs, and edits cost only what they change.  Two bounds pass over
what can't reach the threshold, and lose nothing: of a template's ``m`` distinct
bigrams, a window needs ``m t / (2 - t)``, and so does its text.

Windows are taken best first (of equal ones, those of the earlier template, then
the first), and those that overlap one taken before go, so a text of one licence
isn't reported as its relatives too.  A text may hold several licences: each is
one row.

Null texts have no words; an empty table gives no rows; repeated rows each get
their result, as do rows of null id.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.quality import let

THRESHOLD = 0.8

# Licence texts and notices as published, by SPDX name.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU = (
    "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of "
    "the License, or (at your option) any later version."
)
TEXTS: dict[str, list[str]] = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ],
    "AGPL-3.0": [_GNU.format("This program", "Affero ", "3")],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": [_TWO_CLAUSES + _DISCLAIMER],
    "BSD-3-Clause": [
        _TWO_CLAUSES + _THIRD_CLAUSE + _DISCLAIMER,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to "
        "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished "
        "to do so, all subject to the following:"
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "GPL-2.0": [_GNU.format("This program", "", "2"), "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [_GNU.format("This program", "", "3"), "This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS."
    ],
    "LGPL-2.1": [_GNU.format("This library", "Lesser ", "2.1")],
    "LGPL-3.0": [_GNU.format("This library", "Lesser ", "3")],
    "MIT": [
        f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}",
        _MIT_GRANT,
        _MIT_WARRANTY,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
}
#: How licences are called in a sentence.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3"], "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"], "BSL-1.0": ["Boost Software License, Version 1.0"], "EPL-2.0": ["Eclipse Public License 2.0"], "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"], "ISC": ["ISC License"], "LGPL-2.1": ["GNU Lesser General Public License version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License version 3"],
    "MIT": ["MIT License"], "MPL-2.0": ["Mozilla Public License 2.0"],
}
SAID = ("Licensed", "Released", "Distributed", "Available")
TEMPLATES: dict[str, list[str]] = {
    name: [*texts, *(f"{verb} under the {x}" for x in NAMES.get(name, ()) for verb in SAID), f"SPDX-License-Identifier: {name}"] for name, texts in sorted(TEXTS.items())
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def templates() -> list[tuple[str, list[str]]]:
    """Licence and words of each template, in order of name."""
    return [(name, normal_words(text)) for name, texts in TEMPLATES.items() for text in texts]


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def needed(pairs: int, threshold: float) -> int:
    """Of so many distinct bigrams of a template, those that a window must hold."""
    return max(1, math.ceil(pairs * threshold / (2 - threshold) - 1e-9))


def _listed(items: list[str]) -> Column:
    """A constant array of texts."""
    return F.split(F.lit("|".join(items)), r"\|")


def found_licenses(text: Column, threshold: float = THRESHOLD) -> Column:
    """``array<struct<license, dice, place>>`` of a text, one entry a licence, in order of name."""
    known = templates()
    held = [sorted(set(bigrams(words))) for _, words in known]
    pairs_of, every = F.array(*map(_listed, held)), _listed(sorted(set().union(*held)))
    names, lengths = _listed([name for name, _ in known]), F.array(*[F.lit(len(words)) for _, words in known])
    need, numbers = F.array(*[F.lit(needed(len(x), threshold)) for x in held]), F.array(*[F.lit(t) for t in range(len(known))])

    def score(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
        return let(pairs, lambda pairs: let(F.array_intersect(pairs, every), lambda some: scored(pairs, some)))

    def scored(pairs: Column, some: Column) -> Column:
        likely = F.filter(numbers, lambda t: (F.size(some) >= F.get(need, t)) & (F.size(F.array_intersect(some, F.get(pairs_of, t))) >= F.get(need, t)))

        def windows(t: Column) -> Column:
            """Those that hold enough of the template's bigrams, each found from the first that it holds."""
            at = F.transform(pairs, lambda b, i: F.when(F.array_contains(F.get(pairs_of, t), b), i))
            return let(F.filter(at, lambda i: i.isNotNull()), lambda at: F.flatten(F.transform(at, lambda i, k: starts(t, at, i, k))))

        def starts(t: Column, at: Column, i: Column, k: Column) -> Column:
            low = F.greatest(F.get(at, k + F.get(need, t) - 1) - F.get(lengths, t) + 2, F.coalesce(F.get(at, k - 1) + 1, F.lit(-(1 << 30))))
            some = F.when(F.get(at, k + F.get(need, t) - 1).isNotNull() & (low <= i), F.sequence(low, i)).otherwise(F.array().cast("array<int>"))
            return F.transform(some, lambda s: F.struct(t.alias("t"), s.alias("start")))

        def dice(x: Column) -> Column:
            begin, length = F.greatest(x["start"], F.lit(0)), F.get(lengths, x["t"]) + F.least(x["start"], F.lit(0))
            own = F.array_distinct(F.slice(pairs, begin + 1, F.greatest(length - 1, F.lit(0))))

            def ratio(p: Column, q: Column) -> Column:
                fits = F.size(p) >= F.size(q) * F.lit(threshold / (2 - threshold))
                return F.when(fits, F.lit(2.0) * F.size(F.array_intersect(p, q)) / (F.size(p) + F.size(q))).otherwise(0.0)

            return F.struct(x["t"].alias("t"), begin.alias("begin"), (begin + length).alias("end"), let(own, lambda p: let(F.get(pairs_of, x["t"]), lambda q: ratio(p, q))).alias("dice"))

        return best(F.filter(F.flatten(F.transform(likely, lambda t: F.transform(windows(t), dice))), lambda h: h["dice"] >= threshold))

    def best(hits: Column) -> Column:
        by = F.sort_array(F.transform(hits, lambda h: F.struct((-h["dice"]).alias("less"), h["t"], h["begin"], h["end"])))
        none = F.array().cast("array<struct<less double, t int, begin int, end int>>")
        free = lambda kept, h: ~F.exists(kept, lambda g: (g["begin"] < h["end"]) & (h["begin"] < g["end"]))
        taken = F.aggregate(by, none, lambda kept, h: F.when(free(kept, h), F.concat(kept, F.array(h))).otherwise(kept))
        kept = F.transform(taken, lambda h: F.struct(F.get(names, h["t"]).alias("license"), h["less"], h["begin"].alias("at")))
        # in order of licence, then the best and first of its windows
        first = lambda k, x, i: (i == 0) | (x["license"] != F.get(k, i - 1)["license"])
        return let(F.sort_array(kept), lambda k: F.transform(F.filter(k, lambda x, i: first(k, x, i)), lambda x: F.struct(x["license"], F.round(-x["less"], 6).alias("dice"), x["at"].cast("long").alias("place"))))

    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return let(F.split(clean, " "), score)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``license``, its best ``dice`` and ``place``, the word where that window begins, from 0:
    one row for each licence of a text, and one with nulls for a text without any."""
    found = found_licenses(F.coalesce(F.col("text"), F.lit("")), threshold)
    return docs.select("doc_id", F.explode_outer(found).alias("f")).select("doc_id", "f.license", "f.dice", "f.place")
